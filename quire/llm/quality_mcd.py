"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Text statistics are transformed to four shares, whose centre and scatter are estimated for each
language and source from the documents with the smallest covariance determinant (concentration
steps from a coordinate-wise median start): half of them first, which up to half of junk cannot
reach, then three quarters in groups that the half shows to be mostly clean. A document far from
that centre by Mahalanobis distance is rejected. Everything is DataFrame expressions; the features are
held as integers so that sums, and with them the verdicts, do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, let, without_rows, words_of, written

WINDOW = 8
FEATURES = ("word_length", "symbol_share", "dup_line_share", "repeat_share")
#: Integer steps to a unit of a feature.
SCALE = 1024
#: Least standard deviation of each feature: shares are zero in most clean documents. Those of repeats hold for long documents; see _features.
FLOOR = (0.05, 0.05, 0.1, 0.1)
#: Share of the documents of a group that the estimates are taken from, if at most 1 - TRUSTED of the group is junk by the estimates from its half.
SUBSET = 0.75
HALF = 0.5
TRUSTED = 0.8
#: Makes the scatter of a share consistent for normal data: share / P(chi2_6 <= chi2_4 quantile of the share).
CONSISTENCY = {SUBSET: 1.486, HALF: 2.109}
#: Squared distance beyond which a document is rejected: the chi-square quantile of four degrees at 1 - 1e-6.
CUTOFF = 33.4
MIN_GROUP = 50
C_STEPS = 5
BINS = 64


def _repeat_words(words: Column) -> Column:
    """Words in windows of eight words that occur twice or more. Windows are compared by hash
    first; only a text with equal hashes sorts the windows themselves."""
    last = F.size(words) - WINDOW

    def exact(ws: Column) -> Column:
        windows = F.array_sort(F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.array_join(F.slice(ws, i + 1, WINDOW), " ").alias("w"), i.alias("p"))))
        twice = let(windows, lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["w"] == x["w"], F.lit(False))))
        starts = F.array_sort(F.transform(twice, lambda x: x["p"]))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + F.least(F.lit(WINDOW), p + WINDOW - a["end"])).alias("n"))
        return F.aggregate(starts, zero, step, lambda a: a["n"])

    def hashes(wh: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(wh, i + 1, WINDOW)))

    found = let(let(F.transform(words, lambda w: F.xxhash64(w)), hashes), lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(last < 0, F.lit(0)).when(found, exact(words)).otherwise(F.lit(0))


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``stats`` of the base statistics of each whole text (null: none)."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{WS}]"))
    by_words = let(words_of(F.col(text)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).cast("long").alias("n_repeat_words")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = F.length(F.regexp_replace(body, "[^#*$%&|<>]+", "")).cast("long")
    return docs.withColumn("stats", F.struct(by_words.alias("w"), by_lines.alias("l"), symbols.alias("n_symbols")))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def _features() -> list[Column]:
    """The four features in integer steps. The sampling error of the angle of a share of n is 0.5 / sqrt(n):
    where it passes the floor, the angle is reduced by as much, so that the floor of a short
    document is in effect its sampling error. Words repeat in windows, so WINDOW of them count as one."""
    share = lambda a, b: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(a) / F.greatest(F.col(b), F.lit(1)))))
    trust = lambda n, floor: F.least(F.lit(1.0), 2 * floor * F.sqrt(n))
    length = F.log((F.col("word_chars") + 250) / (F.col("n_words") + 50))
    lines = share("n_dup_lines", "n_lines") * trust(F.col("n_lines"), FLOOR[2])
    words = share("n_repeat_words", "n_words") * trust(F.col("n_words") / WINDOW, FLOOR[3])
    return [F.round(f * SCALE).cast("long").alias(n) for n, f in zip(FEATURES, (length, share("n_symbols", "word_chars"), lines, words), strict=True)]


def _distance(x: list[Column], mean: list[Column], low: list[list[Column]]) -> Column:
    """Squared Mahalanobis distance, by forward substitution in the Cholesky factor."""
    y: list[Column] = []
    for i in range(len(x)):
        rest = x[i] - mean[i]
        for j in range(i):
            rest = rest - low[i][j] * y[j]
        y.append(rest / low[i][i])
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _factored(groups: DataFrame, cov: list[list[Column]], mean: list[Column]) -> DataFrame:
    """One row a group: centre m_i and Cholesky factor l_ij of the covariance with floors on its diagonal."""
    p = len(mean)
    out = groups.withColumns({f"m{i}": mean[i] for i in range(p)} | {f"c{i}{j}": cov[i][j] + (F.lit((FLOOR[i] * SCALE) ** 2) if i == j else F.lit(0.0)) for i in range(p) for j in range(i + 1)})
    for j in range(p):
        col = lambda n: F.col(n)
        out = out.withColumn(f"l{j}{j}", F.sqrt(sum((-(col(f"l{j}{k}") * col(f"l{j}{k}")) for k in range(j)), col(f"c{j}{j}"))))
        out = out.withColumns({f"l{i}{j}": sum((-(col(f"l{i}{k}") * col(f"l{j}{k}")) for k in range(j)), col(f"c{i}{j}")) / col(f"l{j}{j}") for i in range(j + 1, p)} or {f"l{j}{j}": col(f"l{j}{j}")})
    return out.select("g", "subset", *[f"m{i}" for i in range(p)], *[f"l{i}{j}" for i in range(p) for j in range(i + 1)])


def _scored(rows: DataFrame, fit: DataFrame) -> DataFrame:
    p = len(FEATURES)
    d2 = _distance([F.col(f) for f in FEATURES], [F.col(f"m{i}") for i in range(p)], [[F.col(f"l{i}{j}") for j in range(i + 1)] for i in range(p)])
    return rows.join(fit, "g", "left").withColumn("d2", d2)


def _start(rows: DataFrame) -> DataFrame:
    """Coordinate-wise medians and median absolute deviations, from the counts of each value of
    each feature: integers of a small range, so a group has few of them whatever its rows."""
    long = rows.select("g", F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f).alias("x")) for i, f in enumerate(FEATURES)])).alias("v")).select("g", "v.*")
    hist = written(long.groupBy("g", "f", "x").agg(F.count("*").alias("n")), "quality-hist")
    mid = hist.groupBy("g", "f").agg(F.percentile("x", 0.5, F.col("n")).alias("m"))
    off = hist.join(mid, ["g", "f"]).select("g", "f", "m", "n", F.abs(F.col("x") - F.col("m")).alias("off")).groupBy("g", "f").agg(F.first("m").alias("m"), F.percentile("off", 0.5, F.col("n")).alias("s"))
    p = len(FEATURES)
    flat = off.groupBy("g").agg(F.lit(HALF).alias("subset"), *[F.max(F.when(F.col("f") == i, F.col(c))).alias(f"{c}_{i}") for i in range(p) for c in ("m", "s")])
    cov = [[F.pow(1.4826 * F.col(f"s_{i}"), 2) if i == j else F.lit(0.0) for j in range(p)] for i in range(p)]
    return _factored(flat, cov, [F.col(f"m_{i}") for i in range(p)])


def _concentrate(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """One concentration step. Rows are pre-aggregated by group and distance bin; the subset is
    the smallest run of bins that holds the share ``subset`` of the group."""
    p = len(FEATURES)
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    binned = _scored(rows, fit).withColumn("bin", F.floor(BINS * F.log1p(F.col("d2"))))
    hist = binned.groupBy("g", "subset", "bin").agg(F.count("*").alias("n"), *[F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)], *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"q{i}{j}") for i, j in pairs])
    over = Window.partitionBy("g").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy("g")
    inside = hist.withColumns({"before": F.coalesce(F.sum("n").over(over), F.lit(0)), "all": F.sum("n").over(total)}).filter(F.col("before") < F.ceil(F.col("subset") * F.col("all")))
    sums = inside.groupBy("g", "subset").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(p)], *[F.sum(f"q{i}{j}").alias(f"q{i}{j}") for i, j in pairs])
    mean = [F.col(f"s{i}") / F.col("n") for i in range(p)]
    factor = F.when(F.col("subset") == HALF, CONSISTENCY[HALF]).otherwise(CONSISTENCY[SUBSET])
    cov = [[factor * (F.col(f"q{i}{j}") / F.col("n") - mean[i] * mean[j]) if j <= i else F.lit(0.0) for j in range(p)] for i in range(p)]
    return _factored(sums, cov, mean)


def quality_verdicts(docs: DataFrame, cutoff: float = CUTOFF, min_group: int = MIN_GROUP, steps: int = C_STEPS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, lang, source): its statistics, ``base_failed``,
    ``d2`` and ``kept``.

    A language and source with fewer than ``min_group`` rows that pass the base rules is estimated
    with the other such sources of its language, and with those of all languages if they are still
    too few. Null lang and null source are values of their own. Null and empty texts have zero
    words and fail the base rules; tied distances fall on one side together; repeated rows are
    judged alike; an empty table gives none. Other columns of ``docs`` are not looked at.
    """
    s = text_statistics(docs.select("doc_id", "text", "lang", "source"))
    stats = written(
        s.select("doc_id", "lang", "source", F.xxhash64("text").alias("text_hash"), "stats.w.*", "stats.l.*", "stats.n_symbols").withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words"))).select("*", *_features()),
        "quality-stats",
    )
    passed = stats.filter(~F.col("base_failed"))
    small = passed.groupBy("lang", "source").agg(F.count("*").alias("n")).withColumn("own", F.col("n") >= min_group)
    pooled = small.withColumn("lang_n", F.sum(F.when(~F.col("own"), F.col("n"))).over(Window.partitionBy("lang")))
    key = F.when(F.col("own"), F.concat_ws("|", F.lit("s"), F.to_json(F.struct("lang", "source")))).when(F.col("lang_n") >= min_group, F.concat_ws("|", F.lit("l"), F.to_json(F.struct("lang")))).otherwise(F.lit("all"))
    groups = pooled.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), key.alias("g"))
    rows = written(passed.join(groups, passed["lang"].eqNullSafe(groups["g_lang"]) & passed["source"].eqNullSafe(groups["g_source"])).select("g", "doc_id", "text_hash", *FEATURES), "quality-rows")
    start = written(_start(rows), "quality-fit")
    half = start
    for _ in range(steps):
        half = written(_concentrate(rows, half), "quality-fit")
    clean = _scored(rows, half).groupBy("g").agg(F.avg((F.col("d2") <= cutoff).cast("int")).alias("clean"))
    share = F.when(F.col("clean") >= TRUSTED, SUBSET).otherwise(HALF)
    fit = written(start.join(clean, "g").withColumn("subset", share).drop("clean"), "quality-fit")
    for _ in range(steps):
        fit = written(_concentrate(rows, fit), "quality-fit")
    judged = passed.join(groups, passed["lang"].eqNullSafe(groups["g_lang"]) & passed["source"].eqNullSafe(groups["g_source"]))
    scored = _scored(judged.drop("g_lang", "g_source"), fit).withColumn("kept", F.coalesce(F.col("d2") <= cutoff, F.lit(True)))
    failed = stats.filter("base_failed").withColumns({"d2": F.lit(None).cast("double"), "kept": F.lit(False)})
    names = ["doc_id", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "d2", "kept"]
    return scored.select(names).unionByName(failed.select(names))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, lang, source) that the quality rules keep, with all their columns.

    Null and empty texts go, as they fail the base rules; repeated rows stay or go together; extra
    columns may have any names; an empty table gives none.
    """
    bad = quality_verdicts(docs, **options).filter(~F.col("kept")).select("doc_id", "text_hash").distinct()
    bad = written(bad, "quality-rejected")
    return without_rows(docs, bad, bad.limit(0))
