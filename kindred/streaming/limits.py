"""Rate limits and connection counts over event streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from kindred.functions.lineage import fresh

WINDOW_SECONDS = 60


def _decide(times: list[int], limit: int, seconds: int, count: int, reset: int) -> tuple[list[bool], int, int]:
    """Allowed or not for each time (microseconds, ascending), going on from (count, reset); reset < 0: no window yet."""
    out = []
    for t in times:
        if reset < 0 or t > reset:
            count, reset = 1, t + seconds * 1_000_000
            out.append(True)
        elif count >= limit:
            out.append(False)
        else:
            count += 1
            out.append(True)
    return out, count, reset


def rate_limited(events: DataFrame, key: str, time: str, tie: str, limit: int = 5, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """events with `allowed`: at most `limit` events a window of a key; denied events don't count.

    A window opens at a key's first event and ends `seconds` later; the first event strictly after that
    opens the next. A key's events are decided in order, so one task walks them: sorted, a batch at a
    time, with (count, reset) as all that it keeps. Batch only.
    """
    micros = fresh(events, "micros")
    # The key's name may hold what a column expression would read.
    by = F.col(f"`{key}`")
    own = events.withColumn(micros, F.unix_micros(F.col(time).cast("timestamp"))).repartition(by).sortWithinPartitions(by, micros, tie)
    names = events.columns

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, reset = object(), 0, -1
        for b in batches:
            keys, times = b.column(names.index(key)).to_pylist(), b.column(len(names)).to_pylist()
            allowed, at = [], 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if keys[at] != last:
                    last, count, reset = keys[at], 0, -1
                told, count, reset = _decide(times[at:end], limit, seconds, count, reset)
                allowed += told
                at = end
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(allowed, pa.bool_())], names=[*names, "allowed"])

    return own.mapInArrow(walk, StructType(list(events.schema.fields)).add("allowed", "boolean"))


def _named(events: DataFrame, *columns: str) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    return ", ".join(f"`{c}` {kinds[c]}" for c in columns)


def rate_limited_stream(events: DataFrame, key: str, time: str, tie: str, limit: int = 5, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """The same over a stream: (key, time, tie, allowed), with (count, reset) kept for each key between micro-batches.

    Micro-batches come in order of time. If the stream has a watermark, a key is forgotten once the watermark has passed
    the end of its window, as its next event opens a new one in any case; events before the watermark are dropped.
    Without a watermark every key is kept.
    """
    forgets = any("spark.watermarkDelayMs" in f.metadata for f in events.schema.fields)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values([time, tie], kind="stable")
        count, reset = state.get if state.exists else (0, -1)
        micros = pdf[time].astype("datetime64[us]").astype("int64").tolist()
        allowed, count, reset = _decide(micros, limit, seconds, count, reset)
        end = -(-reset // 1000)
        if forgets and end <= state.getCurrentWatermarkMs():
            state.remove() if state.exists else None
        else:
            state.update((count, reset))
            if forgets:
                state.setTimeoutTimestamp(end)
        yield pdf[[key, time, tie]].assign(allowed=allowed)

    timeout = GroupStateTimeout.EventTimeTimeout if forgets else GroupStateTimeout.NoTimeout
    return events.groupBy(key).applyInPandasWithState(step, f"{_named(events, key, time, tie)}, allowed boolean", "count int, reset long", "append", timeout)


def connections_stream(events: DataFrame, key: str, time: str, tie: str, delta: str) -> DataFrame:
    """`connections` over a stream whose micro-batches come in order of time: (key, time, tie, open). A key without an open
    connection is forgotten."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(batches)
        pdf = held[0] if len(held) == 1 else pd.concat(held)
        order = np.lexsort((pdf[tie].to_numpy(), pdf[time].to_numpy()))
        # Many keys have few events: plain arrays, as each step of a frame costs more than they do.
        sums = np.cumsum(pdf[delta].to_numpy()[order].astype(np.int64)) + (state.get[0] if state.exists else 0)
        open_ = sums - np.minimum(np.minimum.accumulate(sums), 0)
        last = int(open_[-1])
        if last:
            state.update((last,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({c: pdf[c].to_numpy()[order] for c in (key, time, tie)} | {"open": open_})

    return events.groupBy(key).applyInPandasWithState(step, f"{_named(events, key, time, tie)}, open long", "open long", "append", GroupStateTimeout.NoTimeout)


def connections(events: DataFrame, key: str, time: str, tie: str, delta: str) -> DataFrame:
    """events with `open`: connections of a key after each event, +1 and -1 in `delta`, never below 0.

    With a floor at 0 the count is the running sum less the least running sum so far, if that is below 0.
    """
    by = Window.partitionBy(key).orderBy(time, tie).rowsBetween(Window.unboundedPreceding, 0)
    running = events.withColumn("_sum", F.sum(delta).over(by))
    return running.withColumn("open", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(by))).drop("_sum")


def limiter_statistics(decided: DataFrame, key: str, limit: int) -> DataFrame:
    """One row: the limit, keys seen, events allowed and denied."""
    return decided.agg(F.lit(limit).alias("rate_limit_per_min"), F.countDistinct(key).alias("monitored"), F.count(F.when(F.col("allowed"), 1)).alias("allowed"), F.count(F.when(~F.col("allowed"), 1)).alias("denied"))
