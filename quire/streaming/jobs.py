"""Structured Streaming jobs over arriving sources, answers and logs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: States from which a packet may take each status.
MOVES = {"HANDED_OFF": ("PREPARED", "HANDED_OFF"), "IMPORTED": ("PREPARED", "HANDED_OFF", "IMPORTED"), "CANCELLED": ("PREPARED",)}


def stream_dedupe(files: DataFrame, time: str = "ts", late: str = "1 day") -> DataFrame:
    """Arriving sources without those whose hash came before, within the watermark."""
    return files.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(["sha256"])


def stream_conversations(answers: DataFrame) -> DataFrame:
    """Running count and last time of each session; for update or complete output."""
    return answers.groupBy("session").agg(F.count("*").alias("answers"), F.max("created_at").alias("last"))


def stream_windows(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type in tumbling windows; late ones count while the watermark allows."""
    e = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return e.groupBy(F.window(time, width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def expire_runs(runs: DataFrame, now: str, most_attempts: int = 2) -> DataFrame:
    """Runs (run_id, status, attempts, lease_expires_at) whose lease has ended are queued again, or failed after the last attempt."""
    ended = (F.col("status") == "RUNNING") & (F.col("lease_expires_at") < F.lit(now).cast("timestamp"))
    return runs.withColumn("status", F.when(ended & (F.col("attempts") >= most_attempts), "FAILED").when(ended, "QUEUED").otherwise(F.col("status")))


def stream_idempotent(requests: DataFrame, keep_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """Requests (scope, key, request_id, body, response, ts) with the response of the first one of their
    key; another body under the same key is a conflict. Keys are forgotten after ``keep_ms``."""

    def answer(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        for rows in batches:
            for r in rows.sort_values(["ts", "request_id"]).itertuples():
                body = hashlib.sha256(r.body.encode()).hexdigest()
                if not state.exists:
                    state.update((body, r.response))
                    state.setTimeoutDuration(keep_ms)
                known, response = state.get
                same = known == body
                yield pd.DataFrame({"scope": [key[0]], "key": [key[1]], "request_id": [r.request_id], "response": [response if same else None], "conflict": [not same]})

    out = "scope string, key string, request_id long, response string, conflict boolean"
    return requests.groupBy("scope", "key").applyInPandasWithState(answer, out, "body string, response string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def stream_revisions(changes: DataFrame) -> DataFrame:
    """Changes (key, id, ts, expected) as accepted or conflicting against the revision that the key's
    state holds; the streaming twin of ``apply_revisions``, which sees a batch in order."""

    def apply(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        revision = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        out = []
        for r in rows.itertuples():
            accepted = r.expected == revision
            revision += accepted
            out.append((key[0], r.id, revision, bool(accepted)))
        state.update((int(revision),))
        yield pd.DataFrame(out, columns=["key", "id", "revision", "accepted"])

    return changes.groupBy("key").applyInPandasWithState(apply, "key long, id long, revision int, accepted boolean", "revision int", "append", GroupStateTimeout.NoTimeout)


def stream_packets(events: DataFrame) -> DataFrame:
    """Status of each packet after each event (key, id, ts, kind); the streaming twin of ``packet_status``."""

    def move(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status = state.get[0] if state.exists else "PREPARED"
        out = []
        for r in pd.concat(list(batches)).sort_values(["ts", "id"]).itertuples():
            legal = status in MOVES.get(r.kind, ())  # an unknown kind changes nothing
            status = r.kind if legal else status
            out.append((key[0], r.id, status, legal))
        state.update((status,))
        yield pd.DataFrame(out, columns=["key", "id", "status", "legal"])

    return events.groupBy("key").applyInPandasWithState(move, "key long, id long, status string, legal boolean", "status string", "append", GroupStateTimeout.NoTimeout)
