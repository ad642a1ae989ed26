"""Streaming forms of the stateful steps; each equals its batch form on the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def dedup_within_watermark(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key within the watermark's reach; state is dropped behind it."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def tumbling_counts(stream: DataFrame, time: str, width: str, delay: str, by: list[str]) -> DataFrame:
    """Counts per window and key; late rows within the delay are counted, later ones are not."""
    out = stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), *by, "n")


def sessions(stream: DataFrame, time: str, gap: str, delay: str, by: str) -> DataFrame:
    """Sessions of a key: stretches without a gap of that length."""
    out = stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def stale_closer(stream: DataFrame, key: str, time: str, delay: str, hours: int = 72) -> DataFrame:
    """key, event, at: OPENED when a key is first seen (or seen again after closing), CLOSED when it has not been seen for ``hours`` of event time."""
    limit = hours * 3_600_000

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "event": ["CLOSED"], "at": [pd.Timestamp(last + limit, unit="ms")]})
            return
        times = sorted(int(t.timestamp() * 1000) for b in batches for t in b[time])
        out, last = [], state.get[0] if state.exists else None
        for t in times:
            if last is None:
                out.append(("OPENED", t))
            elif t - last > limit:
                out += [("CLOSED", last + limit), ("OPENED", t)]
            last = t if last is None else max(last, t)
        state.update((last,))
        state.setTimeoutTimestamp(max(last + limit, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame({key: [k[0]] * len(out), "event": [e for e, _ in out], "at": [pd.Timestamp(t, unit="ms") for _, t in out]})

    kind = dict(stream.dtypes)[key]
    return stream.withWatermark(time, delay).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, event string, at timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def stale_events(rows: DataFrame, key: str, time: str, until: str, hours: int = 72) -> DataFrame:
    """The batch form of ``stale_closer`` for rows up to the moment ``until``."""
    from pyspark.sql import window as W

    limit = F.make_dt_interval(hours=F.lit(hours))
    w = W.Window.partitionBy(key).orderBy(time)
    gaps = rows.select(key, time, F.lag(time).over(w).alias("_before"), F.lead(time).over(w).alias("_after"))
    fresh = F.col("_before").isNull() | (F.col(time) > F.col("_before") + limit)
    ended = F.coalesce("_after", F.lit(until).cast("timestamp")) > F.col(time) + limit
    opened = gaps.where(fresh).select(key, F.lit("OPENED").alias("event"), F.col(time).alias("at"))
    return opened.unionByName(gaps.where(ended).select(key, F.lit("CLOSED").alias("event"), (F.col(time) + limit).alias("at")))
