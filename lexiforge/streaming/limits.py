"""Stateful limits: token bucket, circuit breaker, pacing and daily quota; as batch scans and as streaming operators.

A batch scan deals rows by key, sorts them in their partition and carries a state of fixed size from row to row, batch by
batch, so memory does not grow with a key. The order of a key's rows decides the result, so a key is one task's work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexiforge.operators.rank import place_in_groups
from lexiforge.sources.spool import partitions

#: state, time in ms, flag -> new state, result
Step = Callable[[tuple | None, int, Any], tuple[tuple, Any]]


def ordered_scan(rows: DataFrame, key: str, ts_ms: str, tie: str, flag: str | None, step: Step, result: str, kind: str) -> DataFrame:
    """rows and a column result: what step gives for each row of a key in order of time, then tie."""
    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for x in batches:
            out = []
            flags = x[flag].tolist() if flag else [None] * len(x)
            for k, at, f in zip(x[key].tolist(), x[ts_ms].tolist(), flags, strict=True):
                if k != last:
                    last, state = k, None
                state, value = step(state, int(at), f)
                out.append(value)
            x = x[names].copy()
            x[result] = out
            yield x

    dealt = rows.filter(F.col(key).isNotNull()).repartition(partitions(rows.sparkSession), key).sortWithinPartitions(key, ts_ms, tie)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return dealt.mapInPandas(run, f"{fields}, {result} {kind}")


def bucket_step(per_minute: int) -> Step:
    """A full bucket of per_minute tokens that refills as many a minute; true if a request is let through.

    The state is in 1/60000 of a token, which one millisecond adds per_minute times, so it is exact.
    """
    full = per_minute * 60_000

    def step(state: tuple | None, at: int, _: Any) -> tuple[tuple, bool]:
        have, before = state or (full, at)
        have = min(full, have + (at - before) * per_minute)
        ok = have >= 60_000
        return (have - 60_000 * ok, at), ok

    return step


def breaker_step(most: int = 5, open_ms: int = 60_000) -> Step:
    """closed, open or half-open as each call finds the breaker; flag: the call failed. A refused call changes nothing."""

    def step(state: tuple | None, at: int, failed: Any) -> tuple[tuple, str]:
        run, opened = state or (0, -1)
        if opened >= 0 and at - opened < open_ms:
            return (run, opened), "open"
        found = "half-open" if opened >= 0 else "closed"
        if not failed:
            return (0, -1), found
        if opened >= 0 or run + 1 >= most:
            return (most, at), found
        return (run + 1, -1), found

    return step


def token_bucket(rows: DataFrame, key: str, ts_ms: str, tie: str, per_minute: int = 60) -> DataFrame:
    return ordered_scan(rows, key, ts_ms, tie, None, bucket_step(per_minute), "allowed", "boolean")


def circuit_breaker(rows: DataFrame, key: str, ts_ms: str, tie: str, failed: str, most: int = 5, open_ms: int = 60_000) -> DataFrame:
    return ordered_scan(rows, key, ts_ms, tie, failed, breaker_step(most, open_ms), "state", "string")


def pace(rows: DataFrame, key: str, ts_ms: str, tie: str, interval_ms: int) -> DataFrame:
    """rows with start_ms: when a call may start, not before its time and an interval after the one before.

    The n-th call of a key starts n intervals after the latest of (time - n intervals) so far: a running maximum.
    """
    order = Window.partitionBy(key).orderBy(ts_ms, tie)
    ahead = F.row_number().over(order).cast("long") * interval_ms
    rows = rows.filter(F.col(key).isNotNull())
    return rows.withColumn("start_ms", F.col(ts_ms) - ahead).withColumn("start_ms", F.max("start_ms").over(order.rowsBetween(Window.unboundedPreceding, 0)) + ahead)


def daily_quota(rows: DataFrame, key: str, ts: str, tie: str, quota: int) -> DataFrame:
    """The first `quota` rows of each key and day; Spark limits each partition before it deals the rows."""
    order = Window.partitionBy(key, F.to_date(ts)).orderBy(ts, tie)
    return rows.withColumn("used", F.row_number().over(order)).filter(F.col("used") <= quota).withColumn("used", F.col("used").cast("long"))


def failure_runs(rows: DataFrame, key: str, order: Sequence[Column], failed: Column, least: int = 5) -> DataFrame:
    """key, first (a place in the key's order) and n of each run of consecutive failures of at least `least` rows.

    In a run the place among all rows and the place among failures grow together. Places come from ranges, so a key of any
    size is spread over tasks.
    """
    placed = place_in_groups(rows.withColumn("__f", failed), [key], order, "__i").filter("__f")
    placed = place_in_groups(placed.select(key, "__i"), [key], [F.col("__i")], "__j")
    runs = placed.groupBy(key, (F.col("__i") - F.col("__j")).alias("__run")).agg(F.min("__i").alias("first"), F.count("*").alias("n"))
    return runs.filter(F.col("n") >= least).drop("__run")


def stream_scan(rows: DataFrame, key: str, ts_ms: str, flag: str | None, step: Step, state_type: str, result: str, kind: str, expire_ms: int = 300_000) -> DataFrame:
    """The scan on a stream: rows of a micro-batch in order of time; a key's state goes when it was not seen for expire_ms."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    names = rows.columns

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        x = pd.concat(list(batches), ignore_index=True).sort_values(ts_ms, kind="stable", ignore_index=True)
        now, out = state.get if state.exists else None, []
        flags = x[flag].tolist() if flag else [None] * len(x)
        for at, f in zip(x[ts_ms].tolist(), flags, strict=True):
            now, value = step(now, int(at), f)
            out.append(value)
        state.update(now)
        state.setTimeoutDuration(expire_ms)
        x = x[names].copy()
        x[result] = out
        yield x

    return rows.groupBy(key).applyInPandasWithState(run, f"{fields}, {result} {kind}", state_type, "append", GroupStateTimeout.ProcessingTimeTimeout)


def stream_token_bucket(rows: DataFrame, key: str, ts_ms: str, per_minute: int = 60) -> DataFrame:
    return stream_scan(rows, key, ts_ms, None, bucket_step(per_minute), "have long, before long", "allowed", "boolean")


def stream_breaker(rows: DataFrame, key: str, ts_ms: str, failed: str, most: int = 5, open_ms: int = 60_000) -> DataFrame:
    return stream_scan(rows, key, ts_ms, failed, breaker_step(most, open_ms), "run long, opened long", "state", "string")
