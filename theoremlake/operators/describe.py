"""Descriptions by a pluggable describer, with an append-only cache."""

from __future__ import annotations

import itertools
import random
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

BATCH = 12
#: HTTP states after which a service may be asked again (fixed values).
RETRY_STATES = (403, 429, 500, 503)

Describer = Callable[[list[str]], list[str]]


def with_backoff(call: Callable[[], tuple[int, object]], attempts: int = 6, pause: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """The value of call() -> (state, value) once the state is 200; other states than RETRY_STATES fail at once."""
    for n in range(attempts):
        state, value = call()
        if state == 200:
            return value
        if state not in RETRY_STATES:
            raise RuntimeError(f"state {state}")
        sleep(pause * 2**n * (1 + random.random() / 10))
    raise RuntimeError("no answer after all attempts")


def key_cycle(keys: list[str]) -> Iterator[str]:
    """M8: keys of a service in turn."""
    return itertools.cycle(keys)


def describe(df: DataFrame, describer: Callable[[], Describer], line_col: str, batch: int = BATCH) -> DataFrame:
    """(id, name, nl_description) of rows (id, name, line_col); describer is made once in each task. Blank answers are dropped."""
    schema = "id decimal(20,0), name string, nl_description string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = describer()
        for b in batches:
            for start in range(0, b.num_rows, batch):
                part = b.slice(start, batch)
                told = pa.array([t.strip() if t and t.strip() else None for t in ask(part.column(line_col).to_pylist())], pa.string())
                t = pa.RecordBatch.from_arrays([part.column("id").cast(pa.decimal128(20, 0)), part.column("name"), told], names=["id", "name", "nl_description"])
                yield t.filter(told.is_valid())

    return df.select("id", "name", line_col).mapInArrow(run, schema)
