"""Chat formatting: minimum-cost role repair over a legal-turn automaton.

A legal conversation is an optional system turn, then user and assistant turns in alternation,
ending with an assistant turn. Dynamic programming chooses for every turn to keep it, to relabel
it, to merge it into the turn before, or to put empty turns before it, at the least sum of costs.
Conversations are worked on in blocks of turns: a block yields the least costs from every state of
the automaton to every other, the blocks of a conversation combine in order, and each block is then
repaired alone between its two states. So a very long conversation is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_ids, small, written

BLOCK = 64
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: Costs of a merge, of a relabel (of a turn whose role is unknown: less), and of an empty turn.
MERGE, RELABEL, NAME_UNKNOWN, INSERT = 1.0, 5.0, 0.5, 3.0
INF = float("inf")


def _inserts() -> dict[tuple[int, int], tuple[int, ...]]:
    """The fewest empty turns that lead from a state to one from which a role is legal."""
    out: dict[tuple[int, int], tuple[int, ...]] = {}
    for state in range(4):
        paths = [((), state)]
        for _ in range(3):
            for path, at in paths:
                for role in (SYSTEM, USER, ASSISTANT):
                    if (at, role) in LEGAL:
                        out.setdefault((state, role), path)
            paths = [((*path, r), r) for path, at in paths for r in (SYSTEM, USER, ASSISTANT) if (at, r) in LEGAL]
    return out


INSERTS = _inserts()
#: Empty turns that end a conversation in each state.
ENDINGS = {START: (USER, ASSISTANT), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def options(state: int, role: int) -> Iterator[tuple[float, int, str, tuple[int, ...]]]:
    """(cost, next state, action, empty turns before) for a turn; role 0 is unknown. Earlier ones win ties."""
    named = lambda r: 0.0 if r == role else RELABEL if role else NAME_UNKNOWN
    order = sorted((SYSTEM, USER, ASSISTANT), key=lambda r: r != role)
    for r in order:
        if (state, r) in LEGAL:
            yield named(r), r, "keep" if r == role else "relabel", ()
    if state != START:
        yield MERGE + named(state), state, "merge" if state == role else "relabel+merge", ()
    for r in order:
        before = INSERTS.get((state, r))
        if before:
            yield INSERT * len(before) + named(r), r, "insert" if r == role else "relabel+insert", before


OPTIONS = {(s, r): list(options(s, r)) for s in range(4) for r in range(4)}


def block_matrix(roles: list[int]) -> np.ndarray:
    """Least costs from each state before the turns to each state behind them."""
    out = np.full((4, 4), INF)
    for s in range(4):
        best = [INF] * 4
        best[s] = 0.0
        for role in roles:
            new = [INF] * 4
            for t in range(4):
                if best[t] < INF:
                    for cost, u, *_ in OPTIONS[t, role]:
                        new[u] = min(new[u], best[t] + cost)
            best = new
        out[s] = best
    return out


def repair(roles: list[int], entry: int, leave: int) -> list[tuple[str, int, tuple[int, ...], float]]:
    """(action, role, empty turns before, cost) of each turn on the least path from ``entry`` to ``leave``."""
    best, backs = [INF] * 4, []
    best[entry] = 0.0
    for role in roles:
        new, back = [INF] * 4, [None] * 4
        for t in range(4):
            if best[t] < INF:
                for cost, u, action, before in OPTIONS[t, role]:
                    if best[t] + cost < new[u]:
                        new[u], back[u] = best[t] + cost, (t, action, before, cost)
        best = new
        backs.append(back)
    out, at = [], leave
    for back in reversed(backs):
        t, action, before, cost = back[at]
        out.append((action, at, before, cost))
        at = t
    return out[::-1]


def states_of(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """Entry and exit state of each block on the least path of the conversation with its ending."""
    best, seen = np.array([0.0, INF, INF, INF]), []
    for m in matrices:
        seen.append(best)
        best = (best[:, None] + m).min(axis=0)
    leave = int(np.argmin(best + np.array([INSERT * len(ENDINGS[s]) for s in range(4)])))
    states = []
    for before, m in zip(reversed(seen), reversed(matrices), strict=True):
        entry = int(np.argmin(before + m[:, leave]))
        states.append((entry, leave))
        leave = entry
    return states[::-1]


def role_of(role) -> int:
    """The number of a role; common other names are known, all else is unknown."""
    name = role.strip().lower() if isinstance(role, str) else ""
    return {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "assistant": ASSISTANT, "bot": ASSISTANT, "ai": ASSISTANT, "model": ASSISTANT, "gpt": ASSISTANT}.get(name, 0)


def _open(role: int) -> str:
    return f"<|{ROLES[role]}|>\n"


CLOSE = "<|end|>\n"


def _values(column: pd.Series) -> list:
    """Values of a column with None for nulls."""
    return [None if isinstance(v, float) and v != v else v for v in column.tolist()]


def _runs(batches: Iterator[pd.DataFrame], columns: list[str], keys: int) -> Iterator[list[tuple]]:
    """Whole runs of rows with equal first ``keys`` columns, from sorted batches."""
    rows = (row for batch in batches for row in zip(*(_values(batch[c]) for c in columns), strict=True))
    for _, run in groupby(rows, key=lambda r: r[:keys]):
        yield list(run)


def _batched(rows: Iterator[tuple], columns: list[str], size: int = 10_000) -> Iterator[pd.DataFrame]:
    while some := list(islice(rows, size)):
        yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(columns, zip(*some, strict=True), strict=True)})


def _matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[tuple[int, ...], list[float]] = {}  # many blocks have the same roles

    def matrix(roles: tuple[int, ...]) -> list[float]:
        if roles not in known:
            if len(known) > 50_000:
                known.clear()
            known[roles] = block_matrix(list(roles)).ravel().tolist()
        return known[roles]

    rows = ((*run[0][:3], matrix(tuple(role_of(r[3]) for r in run))) for run in _runs(batches, ["conv_id", "block", "part", "role"], 3))
    yield from _batched(rows, ["conv_id", "block", "part", "matrix"])


def _states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows() -> Iterator[tuple]:
        for run in _runs(batches, ["conv_id", "block", "part", "matrix"], 1):
            states = states_of([np.asarray(r[3]).reshape(4, 4) for r in run])
            for i, ((conv, block, part, _), (a, b)) in enumerate(zip(run, states, strict=True)):
                yield conv, block, part, a, b, i == len(run) - 1

    yield from _batched(rows(), ["conv_id", "block", "part", "entry", "leave", "last"])


def _render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows() -> Iterator[tuple]:
        for run in _runs(batches, ["conv_id", "block", "part", "turn", "role", "text", "entry", "leave", "last"], 3):
            *_, entry, leave, last = run[0]
            was = entry
            path = repair([role_of(r[4]) for r in run], entry, leave)
            for i, (row, (action, role, before, cost)) in enumerate(zip(run, path, strict=True)):
                text = row[5] if isinstance(row[5], str) else ""
                if "merge" in action:
                    piece = "\n" + text
                else:
                    piece = ("" if was == START else CLOSE) + "".join(_open(r) + CLOSE for r in before) + _open(role) + text
                if last and i == len(run) - 1:
                    ending = ENDINGS[role]
                    piece += CLOSE + "".join(_open(r) + CLOSE for r in ending)
                    cost += INSERT * len(ending)
                    before = (*before, *ending)
                was = role
                yield row[0], row[3], row[1], row[2], i, row[4], action, ROLES[role], len(before), cost, piece

    yield from _batched(rows(), ["conv_id", "turn", "block", "part", "position", "role", "action", "new_role", "n_inserted", "cost", "rendered"])


def _blocks(turns: DataFrame, block: int) -> DataFrame:
    """``turns`` with ``block``, by turn number, and ``part``. Where more rows than four blocks have one
    number (repeated or null turns, rows without a conversation) they are ordered over all
    tasks and cut into parts of ``block`` rows, so that no block grows with the table."""
    number = F.coalesce(F.floor(F.col("turn") / block).cast("long"), F.lit(-1 << 62))
    rows = turns.select("conv_id", "turn", "role", "text", number.alias("block"))
    many = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n")).filter(F.col("n") > 4 * block)
    hot = written(many.select(F.col("conv_id").alias("hot_id"), F.col("block").alias("hot_block")), "chat-hot")
    if hot.isEmpty():
        return rows.withColumn("part", F.lit(0).cast("long"))
    hot = small(hot)
    key = F.col("conv_id").eqNullSafe(F.col("hot_id")) & (F.col("block") == F.col("hot_block"))
    order = ["conv_id", "block", "turn", "role", "text", "at"]
    big = rows.join(hot, key).drop("hot_id", "hot_block").withColumn("at", F.monotonically_increasing_id())
    big = written(big.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).withColumn("task", F.shiftright("at", 33)), "chat-ordered")
    spans = big.groupBy("conv_id", "block", "task").agg(F.min("at").alias("lo"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id", "block").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select(F.col("conv_id").alias("hot_id"), F.col("block").alias("hot_block"), F.col("task").alias("of_task"), (before - F.col("lo")).alias("shift"))
    numbered = big.join(spans, key & (F.col("task") == F.col("of_task"))).withColumn("part", F.floor((F.col("at") + F.col("shift")) / block).cast("long"))
    return rows.join(hot, key, "left_anti").withColumn("part", F.lit(0).cast("long")).unionByName(numbered.select("conv_id", "turn", "role", "text", "block", "part"))


def repair_conversations(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``turns`` (conv_id, turn, role, text): its action, new role, number of
    empty turns put beside it, cost and rendered piece. The pieces of a conversation in order of
    block, part and position, the place within the part, are its rendering.

    Turns are in order of ``turn`` (null first), then role and text; repeated rows are turns of
    their own. Turns with a null conv_id are one conversation. A null or strange role is unknown
    and is named at a small cost; a null text is empty. Of tied paths the one through the first of
    keep, relabel, merge and insert wins. An empty table gives no rows; other columns are not
    looked at.
    """
    rows = _blocks(turns, block)
    keys = ["conv_id", "block", "part"]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "turn", "role", "text")
    matrices = map_ids(dealt.select(*keys, "role"), _matrices, "block long, part long, matrix array<double>", "conv_id")
    states = map_ids(matrices.repartition("conv_id").sortWithinPartitions(*keys), _states, "block long, part long, entry int, leave int, last boolean", "conv_id")
    known = written(states.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.col("part").alias("p"), "entry", "leave", "last"), "chat-states")
    joined = rows.join(known, rows["conv_id"].eqNullSafe(known["c"]) & (rows["block"] == known["b"]) & (rows["part"] == known["p"])).drop("c", "b", "p")
    again = joined.repartition(*keys).sortWithinPartitions(*keys, "turn", "role", "text")
    return map_ids(again, _render, "block long, part long, position int, role string, action string, new_role string, n_inserted int, cost double, rendered string", "conv_id", "turn")
