"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text is cut into pieces of a public vocabulary with the greatest sum of scores. Giant documents
are split into chunks. A piece may hang over the end of a chunk, so a chunk has a boundary state:
how many characters of it the piece before it takes. Each chunk yields the matrix of best scores
from every entry state to every exit state; matrices combine associatively under (max, +); then the
states at all boundaries are known and each chunk is backtraced alone.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import repeat
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_ids, written

#: Code points of a chunk at most, and how far back from there a place is looked for that no piece crosses.
CHUNK, LOOK_BACK = 32_768, 4_096
#: Matrices that are combined at once.
FAN = 16
SPACE = "▁"
#: Words of the vocabulary remembered with their segmentation, and the longest word that is.
HELD, LONGEST = 600_000, 256
#: Characters of the texts whose new words are segmented together, most words of one length at once, and fewest.
TOGETHER, ROWS, FEW = 2_000_000, 8_192, 24
WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
OUT = "chunk int, start long, n_ids long, score double, ids binary, round_trip boolean"
_LOADED: dict[str, Pieces] = {}


def _steps(node: dict) -> tuple[Callable, float | None]:
    """A node of the trie as the lookup of its children by character, and the score of the piece that ends there."""
    score = node.pop("", None)
    return {c: _steps(child) for c, child in node.items()}.get, score


class Pieces:
    """Pieces and scores of a model file with byte fallback. A character that is no piece costs the
    least score less 10 and becomes its bytes."""

    def __init__(self, path: str):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i) or p.is_byte(i))]
        self.score = {p.id_to_piece(i): (p.get_score(i), i) for i in plain}
        self.byte = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.text = {i: s for s, (_, i) in self.score.items()}
        self.of_byte = {i: b for b, i in enumerate(self.byte)}
        self.longest = max(map(len, self.score))
        trie: dict = {}
        for piece, (x, _) in self.score.items():
            node = trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = x
        self.unknown = min(s for s, _ in self.score.values()) - 10.0
        if any(re.search(f"[^{SPACE}]{SPACE}", s) for s in self.score):
            raise ValueError("pieces go on behind a space")
        self.pairs = {s[i : i + 2] for s in self.score for i in range(len(s) - 1)}  # neighbours within a piece
        self.known: dict[str, tuple[bytes, float, bool]] = {}
        self.table(trie)
        self.trie = _steps(trie)[0]

    def table(self, trie: dict) -> None:
        """The trie as arrays, for many words at once: a child is found by its parent and its character,
        as a number in the sorted characters of all pieces, among the sorted ``keys``."""
        self.alphabet = np.array(sorted({ord(c) for piece in self.score for c in piece}), "<u4")
        number = {chr(c): i for i, c in enumerate(self.alphabet.tolist())}
        keys, children, scores, ids, todo = [], [], [-np.inf], [-1], [(0, trie, "")]
        for parent, node, prefix in todo:
            for c, child in node.items():
                if c:
                    keys.append(parent * len(number) + number[c])
                    children.append(len(scores))
                    x, i = self.score.get(prefix + c, (-np.inf, -1))
                    scores.append(x)
                    ids.append(i)
                    todo.append((children[-1], child, prefix + c))
        order = np.argsort(keys)
        self.keys, self.children = np.array(keys, "int64")[order], np.array(children, "int64")[order]
        self.node_score, self.node_id = np.array(scores), np.array(ids, "int64")

        self.pair_keys = np.array([number[a] * len(number) + number[b] for a, b in self.pairs], "int64")

    def numbers(self, s: str) -> np.ndarray:
        """The number of each character in the alphabet of the pieces, -1 if it is in none."""
        code = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4")
        at = np.minimum(np.searchsorted(self.alphabet, code), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == code, at, -1)

    def child(self, nodes: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``nodes`` have a child by their character (numbers, -1 if in no piece), and these children."""
        key = np.where(chars < 0, -1, nodes * len(self.alphabet) + chars)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = np.flatnonzero(self.keys[at] == key)
        return found, self.children[at[found]]

    def columns(self, words: list[str]) -> Iterator[tuple[list[int] | None, float]]:
        """Ids and score of words of one length, as ``traced`` gives them; no ids where a character is no piece.
        The program of ``forward`` goes over all words at once: by place, then by length of the piece from there."""
        n, size = len(words), len(words[0])
        chars = self.numbers("".join(words)).reshape(n, size).T
        best, back, piece = np.full((size + 1, n), -np.inf), np.zeros((size + 1, n), "int64"), np.full((size + 1, n), -1, "int64")
        best[0] = 0.0
        for i in range(size):
            live, nodes = np.arange(n), np.zeros(n, "int64")
            single = np.zeros(n, bool)
            for j in range(i + 1, min(size, i + self.longest) + 1):
                found, nodes = self.child(nodes, chars[j - 1][live])
                live = live[found]
                if not len(live):
                    break
                score = self.node_score[nodes]
                if j == i + 1:
                    single[live] = score > -np.inf
                cost = best[i][live] + score
                better = np.flatnonzero(cost > best[j][live])
                to = live[better]
                best[j, to], back[j, to], piece[j, to] = cost[better], i, self.node_id[nodes[better]]
            to = np.flatnonzero(~single & (best[i] + self.unknown > best[i + 1]))
            best[i + 1, to], back[i + 1, to], piece[i + 1, to] = best[i, to] + self.unknown, i, -1
        ids, place, known = np.zeros((n, size), "int64"), np.full(n, size), np.ones(n, bool)
        steps = np.zeros(n, "int64")
        for k in range(size):
            live = np.flatnonzero(place > 0)
            if not len(live):
                break
            end = place[live]
            ids[live, size - 1 - k] = piece[end, live]
            known[live] &= piece[end, live] >= 0
            place[live] = back[end, live]
            steps[live] += 1
        for row, k, whole, score in zip(ids.tolist(), steps.tolist(), known.tolist(), best[size].tolist(), strict=True):
            yield row[size - k :] if whole else None, score

    def learn(self, words: set[str]) -> None:
        """Segment and remember those of ``words`` that are not known, all parts of one length together."""
        known = self.known
        if len(known) >= HELD:
            known.clear()
        new = [w for w in words.difference(known) if len(w) <= LONGEST]
        if not new:
            return
        s = "".join(new)
        chars, starts = self.numbers(s), np.cumsum([0, *map(len, new)])
        cut = ~np.isin(np.where(np.minimum(chars[:-1], chars[1:]) < 0, -1, chars[:-1] * len(self.alphabet) + chars[1:]), self.pair_keys)
        cut[starts[1:-1] - 1] = True
        edges = [0, *(np.flatnonzero(cut) + 1).tolist(), len(s)]
        parts = [s[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        by_size: dict[int, list[str]] = {}
        for w in set(parts).difference(known):
            by_size.setdefault(len(w), []).append(w)
        for size, some in by_size.items():
            for a in range(0, len(some), ROWS * 32 // max(32, size)):
                part = some[a : a + ROWS * 32 // max(32, size)]
                for w, (ids, score) in zip(part, self.columns(part) if len(part) >= FEW else repeat((None, 0.0)), strict=False):
                    if ids is None:
                        ids, score = self.traced(w, 0, size, size)
                    known[w] = (array("I", ids).tobytes(), score, self.decode(ids) == w.replace(SPACE, " "))
        first = np.searchsorted(edges, starts).tolist()
        for w, a, b in zip(new, first[:-1], first[1:], strict=True):
            if b - a > 1:
                ids, scores, same = zip(*map(known.__getitem__, parts[a:b]), strict=True)
                known[w] = (b"".join(ids), sum(scores), all(same))

    @classmethod
    def load(cls, path: str) -> Pieces:
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def forward(self, s: str, entry: int, inner: int) -> tuple[list[float], list[int]]:
        """Best score of each position from ``entry``, and where its last piece starts. Pieces start
        before ``inner``; the text behind it is only looked at. The longest of tied pieces wins."""
        n, none, root, unknown, longest = len(s), -np.inf, self.trie, self.unknown, self.longest
        best, back = [none] * (n + 1), [-1] * (n + 1)
        best[entry] = 0.0
        for i in range(entry, inner):
            at = best[i]
            if at == none:
                continue
            step, single, j = root, True, i
            for c in s[i : i + longest]:
                found = step(c)
                if found is None:
                    break
                step, x = found
                j += 1
                if x is not None:
                    if j == i + 1:
                        single = False
                    if at + x > best[j]:
                        best[j], back[j] = at + x, i
            if single and at + unknown > best[i + 1]:
                best[i + 1], back[i + 1] = at + unknown, i
        return best, back

    def ids_of(self, s: str) -> list[int]:
        found = self.score.get(s)
        return [found[1]] if found else [self.byte[b] for b in s.encode("utf-8", "surrogatepass")]

    def traced(self, s: str, entry: int, end: int, inner: int) -> tuple[list[int], float]:
        best, back = self.forward(s, entry, inner)
        cuts, at = [], end
        while at > entry:
            cuts.append(at)
            at = back[at]
        ids: list[int] = []
        for j in reversed(cuts):
            ids += self.ids_of(s[at:j])
            at = j
        return ids, best[end]

    def word(self, w: str) -> tuple[bytes, float, bool]:
        """Ids, score and whether they decode to it, of a text between two places that no piece
        crosses. No piece crosses a place between two characters that are neighbours in none."""
        found = self.known.get(w)
        if found is None:
            if self.pairs.issuperset(map(add, w, w[1:])):
                return self.part(w)
            cuts = [i for i in range(1, len(w)) if w[i - 1 : i + 1] not in self.pairs]
            edges = zip([0, *cuts], [*cuts, len(w)], strict=True)
            parts = [self.known.get(w[a:b]) or self.part(w[a:b]) for a, b in edges]
            found = self.keep(w, (b"".join([p[0] for p in parts]), sum([p[1] for p in parts]), all([p[2] for p in parts])))
        return found

    def part(self, w: str) -> tuple[bytes, float, bool]:
        """``word`` of a text of which all neighbours stand side by side in some piece."""
        ids, score = self.traced(w, 0, len(w), len(w))
        return self.keep(w, (array("I", ids).tobytes(), score, self.decode(ids) == w.replace(SPACE, " ")))

    def keep(self, w: str, found: tuple[bytes, float, bool]) -> tuple[bytes, float, bool]:
        if len(w) <= LONGEST:
            if len(self.known) >= HELD:
                self.known.clear()
            self.known[w] = found
        return found

    def words(self, s: str) -> tuple[bytes, float, bool]:
        """Ids, score and round trip of an escaped text that starts and ends where no piece crosses."""
        return self.joined(WORDS.findall(s))

    def joined(self, words: list[str]) -> tuple[bytes, float, bool]:
        try:
            found = list(map(self.known.__getitem__, words))
        except KeyError:  # a long one
            found = [self.known.get(w) or self.word(w) for w in words]
        ids, scores, same = zip(*found, strict=True) if found else ((), (), ())
        return b"".join(ids), sum(scores), all(same)

    def texts(self, texts: Iterable[str]) -> Iterator[tuple[bytes, float, bool]]:
        """``words`` of each text; the new words of texts of TOGETHER characters in sum are segmented at once."""
        some: list[list[str]] = []
        size = 0
        for s in texts:
            some.append(WORDS.findall(s))
            size += len(s)
            if size >= TOGETHER:
                self.learn(set().union(*some))
                yield from map(self.joined, some)
                some, size = [], 0
        self.learn(set().union(*some))
        yield from map(self.joined, some)

    def decode(self, ids: list[int]) -> str:
        """The text of ids, spaces restored; bytes are joined before they are decoded."""
        try:
            return "".join(map(self.text.__getitem__, ids)).replace(SPACE, " ")
        except KeyError:  # there are bytes
            pass
        out, held = [], bytearray()
        for i in ids:
            if i in self.of_byte:
                held.append(self.of_byte[i])
                continue
            if held:
                out.append(held.decode("utf-8", "surrogatepass"))
                held.clear()
            out.append(self.text[i])
        return ("".join(out) + held.decode("utf-8", "surrogatepass")).replace(SPACE, " ")


def _free(s: str, inner: int) -> tuple[int, int] | None:
    """The first and the last place in (0, inner] that no piece crosses: before a space behind another character."""
    first = re.search(f"[^{SPACE}]({SPACE})", s[:inner])
    if not first:
        return None
    last = first.start(1)
    for m in re.finditer(f"[^{SPACE}]({SPACE})", s[max(0, inner - 4096) : inner]):
        last = max(last, max(0, inner - 4096) + m.start(1))
    return first.start(1), last


def transfer(p: Pieces, s: str, inner: int) -> np.ndarray:
    """Best scores from each entry state to each exit state of a chunk of ``inner`` characters, of
    which ``s`` also has what follows as far as a piece can reach."""
    size = p.longest
    out = np.full((size, size), -np.inf)
    free = _free(s, inner)
    ends = range(inner, min(len(s), inner + size - 1) + 1)
    if free is None:
        for a in range(min(size, inner + 1)):
            best, _ = p.forward(s, a, inner)
            for e in ends:
                out[a, e - inner] = best[e]
        for a in range(inner + 1, size):  # a piece that reaches over a whole chunk
            if a <= len(s):
                out[a, a - inner] = 0.0
        return out
    first, last = free
    head = [p.forward(s[:first], a, first)[0][first] if a <= first else -np.inf for a in range(size)]
    middle = p.words(s[first:last])[1]
    tail, _ = p.forward(s[last:], 0, inner - last)
    for a in range(size):
        for e in ends:
            out[a, e - inner] = head[a] + middle + tail[e - last]
    return out


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The matrix of two neighbouring stretches under (max, +)."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def segment(p: Pieces, s: str, inner: int, entry: int, leave: int) -> tuple[np.ndarray, float]:
    """Ids and score of a chunk between two boundary states."""
    free = _free(s, inner)
    if free is None or entry > free[0]:
        ids, score = p.traced(s, entry, inner + leave, inner) if entry <= inner else ([], 0.0)
        return np.array(ids, "<u4"), score
    first, last = free
    a, x = p.traced(s[:first], entry, first, first)
    b, y, _ = p.words(s[first:last])
    c, z = p.traced(s[last:], 0, inner + leave - last, inner - last)
    return np.concatenate([np.array(a, "<u4"), np.frombuffer(b, "<u4"), np.array(c, "<u4")]), x + y + z


def _escaped(text: str) -> str:
    return SPACE + text.replace(" ", SPACE)


def _direct(path: str) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = Pieces.load(path)
        for batch in batches:
            escaped = (_escaped(t) if isinstance(t, str) and t else "" for t in batch["text"])
            rows = [(0, 0, len(ids) // 4, float(score), ids, same) for ids, score, same in p.texts(escaped)]
            yield pd.concat([batch.drop(columns="text").reset_index(drop=True), pd.DataFrame(rows, columns=["chunk", "start", "n_ids", "score", "ids", "round_trip"])], axis=1)

    return run


def bounds(p: Pieces, s: str, chunk: int) -> list[int]:
    """Ends of chunks of at most ``chunk`` characters: at the last place that no piece crosses, if there is one in the
    last LOOK_BACK characters; else within a piece, if need be."""
    ends, at = [], 0
    while len(s) - at > chunk:
        end = at + chunk
        free = next((i for i in range(end, max(at, end - LOOK_BACK), -1) if s[i - 1 : i + 1] not in p.pairs), end)
        ends.append(free)
        at = free
    return [*ends, len(s)]


def _split(path: str, chunk: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = Pieces.load(path)
        for batch in batches:
            for doc_id, row, t in zip(batch["doc_id"], batch["row"], batch["text"], strict=True):
                s, at = _escaped(t), 0
                for k, end in enumerate(bounds(p, s, chunk)):
                    yield pd.DataFrame({"doc_id": [doc_id], "row": [row], "chunk": [k], "at": [at], "inner": [end - at], "body": [s[at : end + p.longest - 1]]})
                    at = end

    return run


def _matrices(path: str) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = Pieces.load(path)
        for batch in batches:
            yield batch[["row"]].assign(at=batch["chunk"].astype("int64"), matrix=[transfer(p, s, n).ravel() for s, n in zip(batch["body"], batch["inner"], strict=True)])

    return run


def boundary_states(matrices: list[np.ndarray], entry: int = 0, leave: int = 0) -> list[tuple[int, int]]:
    """Entry and exit state of each stretch between the states at both ends: prefix products forward,
    then the best states backward. Nothing hangs over the ends of a document."""
    prefix = np.full(matrices[0].shape[0], -np.inf)
    prefix[entry] = 0.0
    seen = []
    for m in matrices:
        seen.append(prefix)
        prefix = (prefix[:, None] + m).max(axis=0)
    states = []
    for before, m in zip(reversed(seen), reversed(matrices), strict=True):
        entry = int(np.argmax(before + m[:, leave]))
        states.append((entry, leave))
        leave = entry
    return states[::-1]


def _square(matrix) -> np.ndarray:
    m = np.asarray(matrix)
    return m.reshape(int(len(m) ** 0.5), -1)


def _products(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The matrix of up to FAN neighbouring stretches."""
    whole = reduce(combined, map(_square, rows.sort_values("at")["matrix"]))
    return pd.DataFrame({"row": [key[0]], "at": [key[1]], "matrix": [whole.ravel()]})


def _states(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The states of up to FAN neighbouring stretches from those of the stretch that they make up."""
    rows = rows.sort_values("at")
    states = boundary_states([_square(m) for m in rows["matrix"]], int(rows["entry"].iloc[0]), int(rows["leave"].iloc[0]))
    return pd.DataFrame({"row": rows["row"].to_numpy(), "at": rows["at"].to_numpy(), "entry": [a for a, _ in states], "leave": [b for _, b in states]})


def chunk_states(matrices: DataFrame, fan: int = FAN) -> DataFrame:
    """(row, at, entry, leave) of each chunk of ``matrices`` (row, at, matrix). Products of ``fan`` neighbours
    are taken level by level until one is left of each document; then states go down the same
    tree, so no task holds more than ``fan`` matrices of a document."""
    up = (F.col("at") / fan).cast("long").alias("up")
    levels, most = [matrices], matrices.agg(F.max("at")).first()[0] or 0
    while most > 0:
        below = levels[-1].select("row", up, "at", "matrix")
        levels.append(written(below.groupBy("row", "up").applyInPandas(_products, "row long, at long, matrix array<double>"), "pieces-level"))
        most //= fan
    states = levels[-1].select("row", "at", F.lit(0).alias("entry"), F.lit(0).alias("leave"))
    for level in reversed(levels[:-1]):
        above = states.select("row", F.col("at").alias("up"), "entry", "leave")
        below = level.select("row", up, "at", "matrix").join(above, ["row", "up"])
        states = written(below.groupBy("row", "up").applyInPandas(_states, "row long, at long, entry int, leave int"), "pieces-states")
    return states


def _backtrace(path: str) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = Pieces.load(path)
        for batch in batches:
            rows = []
            for s, n, k, at, a, b in zip(batch["body"], batch["inner"], batch["chunk"], batch["at"], batch["entry"], batch["leave"], strict=True):
                ids, score = segment(p, s, n, a, b)
                rows.append((k, at + a, len(ids), score, ids.tobytes(), p.decode(ids.tolist()) == s[a : n + b].replace(SPACE, " ")))
            yield pd.concat([batch[["doc_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=["chunk", "start", "n_ids", "score", "ids", "round_trip"])], axis=1)

    return run


def encode_pieces(docs: DataFrame, model: str, chunk: int = CHUNK) -> DataFrame:
    """doc_id, chunk, start, n_ids, score, ids and round_trip for each chunk of each row of ``docs``
    (doc_id, text).

    ``ids`` are little-endian, 32 bits each. ``start`` counts in the text with its leading space mark; a piece belongs to the chunk where it
    starts; the ids of a document are those of its chunks in order. Null and empty texts have one
    chunk without ids. Of tied segmentations the one whose last piece is longest wins, then the one before it, and so
    on; where LOOK_BACK characters before the end of a chunk have no place that no piece crosses, it is one of them. Repeated rows are
    encoded each; an empty table gives no rows; other columns are not looked at.
    ``model`` is a path that every worker can read.
    """
    long = F.length(F.coalesce("text", F.lit(""))) > chunk
    small = map_ids(docs.filter(~long).select("doc_id", "text"), _direct(model), OUT)
    rows = docs.filter(long).select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    chunks = written(map_ids(rows, _split(model, chunk), "row long, chunk int, at long, inner int, body string").repartition("row", "chunk"), "pieces-chunks")
    matrices = chunks.select("row", "chunk", "inner", "body").mapInPandas(_matrices(model), "row long, at long, matrix array<double>")
    states = chunk_states(written(matrices, "pieces-level")).select("row", F.col("at").cast("int").alias("chunk"), "entry", "leave")
    large = map_ids(chunks.join(states, ["row", "chunk"]).select("doc_id", "body", "inner", "chunk", "at", "entry", "leave"), _backtrace(model), OUT)
    return small.unionByName(large)


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, chunk and the text of each chunk of ``encoded`` (doc_id, chunk, ids); the first chunk
    of a document loses the space mark that encoding put before it. Null ids decode to an empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = Pieces.load(model)
        for batch in batches:
            texts = [p.decode(np.frombuffer(i or b"", "<u4").tolist()) for i in batch["ids"]]
            yield batch[["doc_id", "chunk"]].assign(text=[t[1:] if k == 0 else t for t, k in zip(texts, batch["chunk"], strict=True)])

    return map_ids(encoded.select("doc_id", "chunk", "ids"), run, "chunk int, text string")
