"""Sharding: minimax contiguous partition of ordered atomic groups.

Groups of equal texts are ordered by the hash of their text and cut into contiguous shards so that
the largest shard is as small as any contiguous cut can make it. The least feasible capacity is
found by binary search with a greedy check. The search sees a summary of at most ``POINTS`` group
boundaries at a time, which gives a bracket for every cut; the next summary holds only boundaries
inside those brackets, until they are few enough to hold them all, so the result is exact whatever
the number of groups.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_of, written

POINTS = 8192
#: Ranges of the hash order in which running sums are taken, and salts in which rows are counted.
RANGES = 4096
SALTS = 256


def _greedy(points: list[int], total: int, shards: int, capacity: int) -> list[int] | None:
    """Cuts that fill each shard as far as ``capacity`` allows, or None if they do not suffice."""
    cuts, at = [], 0
    for _ in range(shards - 1):
        if at + capacity >= total:
            at = total
        else:
            at = points[bisect_right(points, at + capacity) - 1]
        cuts.append(at)
    return cuts if at + capacity >= total else None


def _least(lo: int, hi: int, feasible) -> int:
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if feasible(mid) else (mid + 1, hi)
    return lo


def minimax_cuts(ends: DataFrame, total: int, largest: int, shards: int, points: int = POINTS) -> list[int]:
    """Cut positions (sums of sizes before each cut) of the least feasible capacity.

    ``ends`` has the column ``end``: the running sum of sizes up to and with each group.
    Each round keeps one boundary for each interval of the current brackets. Cuts at known
    boundaries give an upper bound of the capacity; the lower bound lets a cut go anywhere up to the
    next known boundary. A round narrows the brackets by the number of points over the shards.
    """
    brackets = [(0, total)]
    known: set[int] = {0, total}
    while True:
        width = max(1, sum(b - a for a, b in brackets) // points)
        inside = F.lit(False)
        for a, b in brackets:
            inside = inside | F.col("end").between(a, b)
        cell = F.floor(F.col("end") / F.lit(width)).cast("long")
        seen = ends.filter(inside).groupBy(cell.alias("cell")).agg(F.min("end").alias("first"), F.max("end").alias("last"), F.count("*").alias("n"))
        rows = seen.collect()  # at most points + two for each bracket
        known |= {x for r in rows for x in (r["first"], r["last"])}
        marks = sorted(known)
        # cells with boundaries besides their first and last one
        open_cells = sorted((r["first"], r["last"]) for r in rows if r["n"] > 2)
        hi = _least(max(largest, -(-total // shards)), total, lambda c: _greedy(marks, total, shards, c) is not None)
        if not open_cells:
            return _greedy(marks, total, shards, hi) or []
        starts = [a for a, _ in open_cells]

        def reach(x: int) -> int:
            """The farthest place at or before x where a boundary is or may be."""
            i = bisect_right(starts, x) - 1
            if i >= 0 and x < open_cells[i][1]:
                return x
            return marks[bisect_right(marks, x) - 1]

        def may(c: int) -> list[int] | None:
            cuts, at = [], 0
            for _ in range(shards - 1):
                at = total if at + c >= total else reach(at + c)
                cuts.append(at)
            return cuts if at + c >= total else None

        lo = _least(max(largest, -(-total // shards)), hi, lambda c: may(c) is not None)
        low, high = _greedy_floor(marks, total, shards, lo), may(hi) or [total] * (shards - 1)
        before = sum(b - a for a, b in brackets)
        brackets = _merged([(marks[max(0, bisect_left(marks, a) - 1)], marks[min(len(marks) - 1, bisect_right(marks, b))]) for a, b in zip(low, high, strict=True)])
        if 2 * sum(b - a for a, b in brackets) > before:
            points *= 2  # too coarse for so many shards


def _greedy_floor(marks: list[int], total: int, shards: int, capacity: int) -> list[int]:
    cuts, at = [], 0
    for _ in range(shards - 1):
        at = total if at + capacity >= total else marks[bisect_right(marks, at + capacity) - 1]
        cuts.append(at)
    return cuts


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def minimax_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for each row of ``docs`` (doc_id, text).

    Equal texts share a shard. A null text has size 1 (as an empty one) and is a group of its own
    with other null texts. Rows in a shard are numbered without gaps by salted doc_id; repeated
    rows get a slot each. With fewer groups than shards some shards stay empty; an empty table
    gives no rows. Other columns are not looked at.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    key = F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("null"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    rows = written(docs.select("doc_id", size.alias("size"), crc32_of(F.col("text")).alias("text_crc32"), key.alias("key"), salt.alias("salt")), "shard-rows")
    groups = rows.groupBy("key").agg(F.sum("size").alias("size")).withColumn("range", F.when(F.col("key") == "null", RANGES).otherwise(F.conv(F.substring("key", 1, 3), 16, 10).cast("int")))
    groups = written(groups, "shard-groups")
    sums = groups.groupBy("range").agg(F.sum("size").alias("sum"), F.max("size").alias("largest"))
    starts = sums.withColumn("start", F.coalesce(F.sum("sum").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # at most RANGES + 1 rows
    running = F.sum("size").over(Window.partitionBy("range").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    ends = written(groups.withColumn("run", running).join(F.broadcast(starts.select("range", "start")), "range").select("key", (F.col("start") + F.col("run")).alias("end")), "shard-ends")
    whole = sums.agg(F.sum("sum").alias("total"), F.max("largest").alias("largest")).first()
    cuts = minimax_cuts(ends, whole["total"], whole["largest"], shards) if whole["total"] else []
    # the last key before each cut: as many rows as there are cuts
    found = {r["end"]: r["key"] for r in ends.filter(F.col("end").isin(cuts)).collect()} if cuts else {}
    order = F.when(F.col("key") == "null", F.lit("g")).otherwise(F.col("key"))  # after every hexadecimal digit
    shard = sum((F.when(order > F.lit("g" if found[c] == "null" else found[c]), 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    placed = rows.withColumn("shard", shard)
    counts = placed.groupBy("shard", "salt").agg(F.count("*").alias("n"))
    before = counts.select("shard", "salt", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "salt").orderBy("doc_id", "key"))
    return placed.withColumn("number", number).join(F.broadcast(before), ["shard", "salt"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("number") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
