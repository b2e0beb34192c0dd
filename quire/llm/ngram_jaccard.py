"""N-gram Jaccard join with token-combination prefixes.

The tokens of a document are its distinct word shingles. Two sets whose similarity reaches the
threshold have at least need = ceil(threshold * size) tokens in common, so they share tokens among
the first ones of any order of all tokens. Three steps make use of that, each on what the last left:

1. In the order of hashes a set and its partner share at least ``sure`` tokens of their prefixes. A
   set of whose prefix fewer tokens occur in any other set has no partner and is done. A short prefix
   of every set is looked at first, then a longer one of the sets that are left: chance alone leaves
   ever more sets of a growing corpus after the short one.
2. The whole sets of the others are counted token by token, exactly. Fewer than ``need`` tokens that
   occur in another of these sets: no partner.
3. The tokens that do, the rarest first, give the extended prefix of size - need + 2 tokens, of which
   partners share two. Rare tokens are indexed one by one and frequent ones in pairs: either a rare
   token or a pair of frequent ones is shared. Long documents would have too many pairs and index
   their frequent tokens one by one; lengths near the limit do both.

Sizes, the places of a key in both prefixes and parity bits of both sets bound the overlap within
the join on keys; what passes is checked on the whole sets of 64-bit hashes. Each document is first
compared with the representative of its keys that has the fewest tokens of its own; only documents
that are not in one component by then are compared with each other, so a group of near copies
costs its size and not the square of it. Steps 1 and 2 move each token once, by its hash, to count it
and to tell its sets of it; what they put on disk does not depend on what Spark would broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_ids, scratch_of, small, spread_join, without_rows, written
from .components import components

#: Common tokens of the short and the long prefixes, in halves of the difference allowed.
SHORT, LONG = 1, 4
#: Sets in which a token occurs up to which it is rare.
RARE = 8
#: Tokens of an extended prefix up to which frequent tokens are indexed in pairs.
PAIRED = 16
#: Words of 64 parity bits of a set.
PARITY_WORDS = 8
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: pd.Series, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word shingles of each text, A-Z in lower case; of the
    whole sequence if it is shorter; none without words."""
    split = [(t or "").encode("utf-8", "surrogatepass").lower().split() if isinstance(t, str) else [] for t in texts]
    flat = [w for ws in split for w in ws]
    hashed = pd.util.hash_array(np.array(flat, dtype=object), categorize=True) if flat else np.empty(0, np.uint64)
    at = 0
    for ws in split:
        n = len(ws)
        h, at = hashed[at : at + n], at + n
        if not n:
            yield np.empty(0, np.uint64)
            continue
        m = min(n, k)
        x = np.full(n - m + 1, m, np.uint64)
        for i in range(m):
            x = _mixed(x * _M1 + h[i : n - m + 1 + i])
        yield np.unique(x)


def _pieces(batches: Iterator[pd.DataFrame], chars: int = 1_000_000) -> Iterator[pd.DataFrame]:
    """The batches cut where their texts are long in sum, to bound what is hashed at once."""
    for batch in batches:
        size = batch["text"].str.len().fillna(0).cumsum().to_numpy() // chars
        for _, part in batch.groupby(size, sort=False):
            yield part


def least_overlap(n: int, percent: int) -> int:
    """Tokens that a set of n has in common with any partner."""
    return -(-percent * n // 100)


def _sure(n: int, percent: int, halves: int) -> int:
    """Common tokens of two prefixes if the smaller set has n tokens, in halves of the difference allowed."""
    need = least_overlap(n, percent)
    return min(need, max(min(2, need), n * (100 - percent) * halves // 200))


def _signature(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _indexing(k: int, percent: int) -> Callable:
    """Size, signature and long prefix in the order of hashes of each set, of which the first ``short``
    tokens are the short one; ``least`` is the number of tokens of each prefix that any partner has in
    its own."""

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _pieces(batches):
            rows = []
            for s in shingle_sets(batch["text"], k):
                n = len(s)
                need = least_overlap(n, percent)
                short, long = (n - need + _sure(n, percent, x) for x in (SHORT, LONG))
                rows.append((_signature(s) if n else None, n, short, _sure(need, percent, SHORT), _sure(need, percent, LONG), s[:long].view(np.int64)))
            sig, n, short, least_short, least_long, keys = zip(*rows, strict=True)
            ids = {"doc_id": batch["doc_id"].to_numpy(), "text_hash": batch["text_hash"].to_numpy()}
            yield pd.DataFrame(ids | {"sig": sig, "n": n, "short": short, "least_short": least_short, "least_long": least_long, "keys": keys})

    return index


def parity(s: np.ndarray) -> np.ndarray:
    """Parity bits of a set by its low hash bits: two sets differ in at least as many elements as
    their parities differ in bits."""
    width = 64 * PARITY_WORDS
    return np.packbits(np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).view(np.int64)


def _sets(k: int) -> Callable:
    """Whole sets and parities of the texts of nodes."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _pieces(batches):
            found = list(shingle_sets(batch["text"], k))
            same = [_signature(s) == bytes(g) for s, g in zip(found, batch["sig"], strict=True)]
            found = [s for s, ok in zip(found, same, strict=True) if ok]
            yield pd.DataFrame({"node": batch["node"].to_numpy()[same], "tokens": [s.view(np.int64) for s in found], "bits": [parity(s) for s in found]})

    return make


def _enough(a: Column, b: Column, percent: int) -> Column:
    """Sizes that allow the similarity."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _overlaps(overlap: Column, a: Column, b: Column, percent: int) -> Column:
    """An overlap, or a bound of it, that reaches the similarity: 100 * overlap >= percent * union."""
    return (100 + percent) * overlap >= percent * (a + b)


def _parities(a: Column, b: Column) -> Column:
    """Bits in which two parities differ."""
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(1, PARITY_WORDS)), F.bit_count(a[0].bitwiseXOR(b[0])))


def _alike(bits_a: Column, bits_b: Column, a: Column, b: Column, percent: int) -> Column:
    return (100 + percent) * _parities(bits_a, bits_b) <= (100 - percent) * (a + b)


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity. Tokens that no other set has are left out of
    ``nodes``; they cannot be in common."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"t_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.filter(_overlaps(F.size(F.array_intersect("t_a", "t_b")), F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def _meeting(full: DataFrame, length: Column, least: str) -> DataFrame:
    """The rows of ``full`` of whose first ``length`` keys at least ``least`` occur in those of another set."""
    posts = full.select("row", F.xxhash64("sig").alias("h"), F.explode(F.slice("keys", F.lit(1), length)).alias("key"))
    by = Window.partitionBy("key")
    shared = posts.select("row", F.min("h").over(by).alias("lo"), F.max("h").over(by).alias("hi")).filter("lo <> hi")
    met = shared.groupBy("row").agg(F.count("*").alias("met"))
    return full.select("row", "doc_id", "text_hash", least).join(met, "row").filter(F.col("met") >= F.col(least)).select("row", "doc_id", "text_hash")


def _partners(full: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """Steps 1 and 2: the nodes that may have a partner, with their size n, parity bits and their
    tokens that occur in other ones, the rarest first."""
    some = written(_meeting(full, F.col("short"), "least_short"), "jaccard-some")
    left = full.join(small(some.select("row")), "row", "left_semi")
    alive = written(_meeting(left, F.size("keys"), "least_long"), "jaccard-alive")
    same = nodes["rep.doc_id"].eqNullSafe(alive["doc_id"]) & (nodes["rep.text_hash"] == alive["text_hash"])
    reps = written(nodes.join(alive, same, "left_semi").select(F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"), "node", "sig"), "jaccard-reps")
    rows = docs.join(small(reps), docs["doc_id"].eqNullSafe(F.col("rep_id")) & (F.xxhash64(docs["text"]) == F.col("rep_hash")))
    sets = written(rows.select("node", "sig", "text").mapInPandas(_sets(k), "node long, tokens array<long>, bits array<long>"), "jaccard-sets")
    if sets.count() > reps.count():  # repeated rows
        sets = written(sets.dropDuplicates(["node"]), "jaccard-sets")
    tokens = sets.select("node", F.explode("tokens").alias("key"))
    counted = tokens.select("node", "key", F.count("*").over(Window.partitionBy("key")).alias("df")).filter("df > 1")
    ranked = counted.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("ranked"))
    n = sets.select("node", "bits", F.size("tokens").alias("n"))
    return n.join(ranked, "node").filter(100 * F.size("ranked") >= percent * F.col("n")).select("node", "n", "bits", F.col("ranked.key").alias("tokens"), F.col("ranked.df").alias("dfs"))


def _posts(nodes: DataFrame, percent: int) -> DataFrame:
    """Step 3: (key, node, n, m, pos) for the keys of each node. m is the number of its shared tokens;
    partners whose first common key is at ``pos`` have m - pos tokens in common at most."""
    m = F.size("tokens")
    length = m - F.ceil(percent * F.col("n") / 100).cast("int") + 2
    prefix = F.slice(F.transform(F.arrays_zip("tokens", "dfs"), lambda x, i: F.struct(x["tokens"].alias("key"), i.alias("pos"), x["dfs"].alias("df"))), 1, F.least(m, length))
    limit = PAIRED * 100 // (100 - percent)
    paired, single = percent * F.col("n") <= 100 * limit, 100 * F.col("n") >= percent * limit
    none = F.array().cast("array<struct<key:bigint,pos:int>>")
    one = F.transform(F.filter("prefix", lambda x: (x["df"] <= RARE) | single), lambda x: F.struct(x["key"].alias("key"), x["pos"].alias("pos")))
    often = F.filter("prefix", lambda x: x["df"] > RARE)
    # of the first two common tokens the second is at pos + 1
    two = F.flatten(F.transform("often", lambda x: F.transform(F.filter("often", lambda y: y["pos"] > x["pos"]), lambda y: F.struct(F.xxhash64(x["key"], y["key"]).alias("key"), (y["pos"] - 1).alias("pos")))))
    keyed = nodes.select("node", "n", m.alias("m"), prefix.alias("prefix")).select("node", "n", "m", one.alias("one"), F.when(paired, often).otherwise(F.array().cast("array<struct<key:bigint,pos:int,df:bigint>>")).alias("often"))
    return keyed.select("node", "n", "m", F.explode(F.concat("one", F.coalesce(two, none))).alias("k")).select("k.key", "node", "n", "m", "k.pos")


def _star(posts: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Links of nodes with the likeliest of the representatives of their keys. The representative of a
    key is the node with the least share of tokens of its own."""
    best = F.min_by(F.struct("node", "n", "m", "pos"), F.struct((F.col("n") - F.col("m")) / F.col("n"), F.col("node")))
    lists = posts.groupBy("key").agg(best.alias("rep"), F.count("*").alias("many")).filter("many > 1").select("key", "rep")
    bound = F.least(F.col("m") - F.col("pos"), F.col("rep.m") - F.col("rep.pos"))
    met = posts.join(lists, "key").filter((F.col("node") != F.col("rep.node")) & _enough(F.col("n"), F.col("rep.n"), percent) & _overlaps(bound, F.col("n"), F.col("rep.n"), percent))
    pairs = met.select(F.col("rep.node").alias("a"), F.col("node").alias("b"), F.col("rep.n").alias("n_a"), F.col("n").alias("n_b")).distinct()
    bits = nodes.select("node", "bits")
    seen = pairs.join(bits.select(F.col("node").alias("a"), F.col("bits").alias("bits_a")), "a").join(bits.select(F.col("node").alias("b"), F.col("bits").alias("bits_b")), "b")
    may = seen.filter(_alike(F.col("bits_a"), F.col("bits_b"), F.col("n_a"), F.col("n_b"), percent))
    first = may.groupBy("b").agg(F.min_by("a", F.struct(_parities(F.col("bits_a"), F.col("bits_b")), F.col("a"))).alias("a"))
    return _verified(written(first.select("a", "b"), "jaccard-first"), nodes, percent)


def _labelled(posts: DataFrame, label: DataFrame) -> DataFrame:
    own = posts.join(label.select(F.col("node").alias("of_node"), "label"), F.col("node") == F.col("of_node"), "left")
    return own.select("key", "node", "n", "m", "pos", F.coalesce("label", "node").alias("comp"))


def _mixed_keys(own: DataFrame) -> DataFrame:
    """Rows under keys at which nodes of different components meet; ``apart`` is outside the
    component that has the most nodes under the key."""
    sizes = own.groupBy("key", "comp").agg(F.count("*").alias("many"))
    mixed = sizes.groupBy("key").agg(F.max_by("comp", F.struct("many", "comp")).alias("main"), F.count("*").alias("comps")).filter("comps > 1").select("key", "main")
    return own.join(mixed, "key").withColumn("apart", F.col("comp") != F.col("main")).drop("main")


def _met_again(rest: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that met under a key and that sizes, places and parities allow."""
    rest = written(rest.join(nodes.select("node", "bits"), "node"), "jaccard-apart")
    one = rest.filter("apart").select("key", *[F.col(c).alias(f"{c}_s") for c in ("node", "n", "m", "pos", "comp", "bits")])
    bound = F.least(F.col("m") - F.col("pos"), F.col("m_s") - F.col("pos_s"))
    other = (F.col("comp") != F.col("comp_s")) & (~F.col("apart") | (F.col("node") < F.col("node_s")))
    near = _enough(F.col("n"), F.col("n_s"), percent) & _overlaps(bound, F.col("n"), F.col("n_s"), percent) & _alike(F.col("bits"), F.col("bits_s"), F.col("n"), F.col("n_s"), percent)
    met = one.join(rest.withColumnRenamed("key", "other_key"), (F.col("key") == F.col("other_key")) & other & near)
    return met.select(F.least("node", "node_s").alias("a"), F.greatest("node", "node_s").alias("b"))


def _links(nodes: DataFrame, percent: int) -> DataFrame:
    """Enough links (a, b) between ``nodes`` to join all nodes that links reach."""
    posts = written(_posts(nodes, percent), "jaccard-posts")
    links = written(_star(posts, nodes, percent), "jaccard-links")
    rest = _mixed_keys(_labelled(posts, components(links)))
    pairs = written(_met_again(rest, nodes, percent).distinct(), "jaccard-pairs")
    return links.unionByName(_verified(pairs, nodes, percent))


def _components_of(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and, for documents with shingles, the doc_id and
    text_hash of the row of the component that comes first (``first``)."""
    if not 50 < percent <= 100:
        raise ValueError("the similarity is above 50 and at most 100 percent")
    docs = docs.select("doc_id", "text")
    made = map_ids(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), _indexing(k, percent), "text_hash long, sig binary, n long, short int, least_short int, least_long int, keys array<long>")
    # rows and nodes are numbered as they are written; all later reads see the same numbers
    index = written(made.withColumn("row", F.monotonically_increasing_id()), "jaccard-index")
    full = index.filter("n > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    nodes = written(full.groupBy("sig").agg(first.alias("rep"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()), "jaccard-nodes")
    with scratch_of(docs.sparkSession, keep=1):
        may = written(_partners(full, docs, nodes, k, percent), "jaccard-may")
    with scratch_of(docs.sparkSession, keep=1):
        links = written(_links(may, percent), "jaccard-links")
    label = components(links)
    marked = nodes.join(label.withColumnRenamed("node", "of_node"), F.col("node") == F.col("of_node"), "left").withColumn("label", F.coalesce("label", "node"))
    least = marked.groupBy("label").agg(F.min("rep").alias("first"))
    of = written(marked.join(least, "label").select("sig", "copies", "first"), "jaccard-of")
    narrow = full.select("doc_id", "text_hash", "n", "sig")
    linked = spread_join(narrow, of, "sig", "copies").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"), "first")
    return linked.unionByName(index.filter("n = 0").select("doc_id", "text_hash", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast(linked.schema["first"].dataType).alias("first")))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of ``docs`` (doc_id, text).

    Documents link when the Jaccard similarity of their k-word shingle sets is ``percent`` / 100
    or more; component_id is the least doc_id that links reach, the own one included. Documents
    without words (null, empty, only white space) have no shingles and no links. Equal sets are one
    node; repeated rows share a component. A component without any doc_id has a null id. An empty
    table gives no rows; other columns are not looked at. Shingles are compared by 64-bit hashes.
    """
    return _components_of(docs, k, percent).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` with one document, that of the least doc_id, of each component; all columns.

    Documents without words stay, also null and empty ones; of wholly repeated rows with words one
    stays. Of rows with one doc_id and different texts each goes or stays by its own text; in one
    component the one with the least text hash stays. A null doc_id comes after all others. Extra
    columns may have any names. An empty table gives none.
    """
    rows = _components_of(docs, k, percent).filter("n_shingles > 0")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    marks = rows.groupBy("doc_id", "text_hash").agg(F.bool_or(stays).alias("stays"), F.count("*").alias("rows"))
    marks = written(marks.filter("not stays or rows > 1"), "jaccard-gone")
    return without_rows(docs, marks.filter("not stays"), marks.filter("stays"))
