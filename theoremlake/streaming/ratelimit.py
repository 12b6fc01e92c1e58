"""Sliding-window rate limits (X1), in batch and in Structured Streaming.

A call is accepted if fewer than `limit` accepted calls of its key lie within the window; rejected calls are not
counted, so each decision depends on those before it and no window function can express it. A call exactly a window
old still counts. A limit of 0 or less accepts everything."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def decide(recent: deque[int], at: int, limit: int, window: int) -> bool:
    """Whether a call at time `at` is accepted; recent holds the accepted calls and is brought up to date."""
    if limit <= 0:
        return True
    while recent and at - recent[0] > window:
        recent.popleft()
    if len(recent) >= limit:
        return False
    recent.append(at)
    return True


def limit_rate(events: DataFrame, limit: int, window_seconds: float, key: str = "key", ts: str = "ts", tie: str = "id") -> DataFrame:
    """events (key, ts, tie, ...) -> (key, ts, tie, accepted), in the order of ts and tie.

    Keys are spread over tasks and each task reads its keys sorted, one row after the other; at most `limit` times of one
    key are held, however many calls it has. Null keys are one key; rows with a null ts are left out."""
    micros = int(window_seconds * 1_000_000)
    src = events.where(F.col(ts).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), F.col(tie).cast("long").alias("tie"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, recent, begun = None, deque(), False
        for b in batches:
            out = []
            for k, at in zip(b.column("key").to_pylist(), b.column("at").to_pylist(), strict=True):
                if not begun or k != current:
                    current, recent, begun = k, deque(), True
                out.append(decide(recent, at, limit, micros))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("ts"), b.column("tie"), pa.array(out, pa.bool_())], names=["key", "ts", "tie", "accepted"])

    sorted_ = src.repartition("key").sortWithinPartitions("key", "at", "tie")
    kind = dict(src.dtypes)["ts"]
    return sorted_.mapInArrow(run, f"key string, ts {kind}, tie long, accepted boolean").select(F.col("key").cast(dict(events.dtypes)[key]).alias(key), F.col("ts").alias(ts), F.col("tie").alias(tie), "accepted")


def calls_in_window(events: DataFrame, window_seconds: int, key: str = "key", ts: str = "ts") -> DataFrame:
    """events with n_recent, the calls of the key in the window up to each call, rejected ones included."""
    w = Window.partitionBy(key).orderBy("_at").rangeBetween(-window_seconds * 1_000_000, 0)
    return events.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("n_recent", F.count("*").over(w)).drop("_at")


def limit_rate_stream(events: DataFrame, limit: int, window_seconds: float, key: str = "key", ts: str = "ts", tie: str = "id") -> DataFrame:
    """limit_rate for a stream: state of a key is the times of its accepted calls. Within a trigger calls are put in order;
    a call older than the state's last one is judged when it comes. A key keeps at most `limit` times."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    micros = int(window_seconds * 1_000_000)

    def judge(k, frames, state):
        import pandas as pd

        recent = deque(state.get[0] if state.exists else [])
        pdf = pd.concat(list(frames)).sort_values(["at", "tie"], kind="stable")
        accepted = [decide(recent, int(at), limit, micros) for at in pdf["at"]]
        state.update((list(recent),))
        yield pd.DataFrame({"key": [k[0]] * len(pdf), "at": pdf["at"].to_numpy(), "tie": pdf["tie"].to_numpy(), "accepted": accepted})

    src = events.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(tie).cast("long").alias("tie"))
    out = src.groupBy("key").applyInPandasWithState(judge, "key string, at long, tie long, accepted boolean", "recent array<long>", "append", GroupStateTimeout.NoTimeout)
    return out.select(F.col("key").cast(dict(events.dtypes)[key]).alias(key), F.timestamp_micros("at").alias(ts), F.col("tie").alias(tie), "accepted")
