"""Keyed state with time: the latest per key with a time to live, and a sliding rate limit.

Each has a batch form over a table of events and a streaming form that gives the same rows.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import RATE_MOST, RATE_WINDOW_SECONDS, STATE_MOST, STATE_TTL_HOURS


def latest(df: DataFrame, *, key: str, at: str, order: str, now: Column, ttl_hours: int = STATE_TTL_HOURS, most: int | None = STATE_MOST) -> DataFrame:
    """Each key's last row that has not expired; of more than `most` keys the newest."""
    live = df.where((F.col(at) <= now) & (F.col(at) > now - F.make_dt_interval(hours=F.lit(ttl_hours))))
    last = live.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.desc(order)))).where("_n = 1").drop("_n")
    return last if most is None else last.orderBy(F.desc(at), F.desc(order)).limit(most)


def sliding_limit(df: DataFrame, *, key: str, at: str, order: str, seconds: int = RATE_WINDOW_SECONDS, most: int = RATE_MOST) -> DataFrame:
    """df with recent: requests of the key in the seconds before (itself included), and limited: beyond the limit."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(micros).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return df.withColumn("recent", F.count(F.lit(1)).over(w)).withColumn("limited", F.col("recent") > most)


def stream_window_counts(df: DataFrame, *, key: str, at: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and key of a stream or table, with a watermark."""
    return df.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def stream_latest(df: DataFrame, *, key: str, at: str, value: str, ttl_hours: int = STATE_TTL_HOURS) -> DataFrame:
    """A stream's latest value of each key; state that no event renews within the time to live goes. Update mode; event time."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = state.get if state.exists else None
        for frame in frames:
            row = frame.sort_values(at).iloc[-1]
            if best is None or row[at].value // 1000 >= best[0]:
                best = (row[at].value // 1000, str(row[value]))
        state.update(best)
        state.setTimeoutTimestamp(max(best[0] // 1000 + ttl_hours * 3_600_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], "at": [pd.Timestamp(best[0], unit="us")], value: [best[1]]})

    kind = df.schema[key].dataType.simpleString()
    return df.withWatermark(at, "1 minute").groupBy(key).applyInPandasWithState(update, f"{key} {kind}, at timestamp, {value} string", "at long, value string", "update", "EventTimeTimeout")


def stream_sliding_limit(df: DataFrame, *, key: str, at: str, order: str, seconds: int = RATE_WINDOW_SECONDS, most: int = RATE_MOST) -> DataFrame:
    """sliding_limit over a stream: each event once, with recent and limited. Events of a key must not come later than ones after them by more than the watermark.

    State is the times of the key's events within the last seconds; it goes when none came for so long. Append mode; event time."""
    span = seconds * 1_000_000

    def update(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        for frame in frames:
            rows = frame.sort_values([at, order])
            times = (rows[at].astype("datetime64[us]").astype("int64")).tolist()
            held = sorted([*held, *times])
            recent = [bisect.bisect_right(held, t) - bisect.bisect_right(held, t - span) for t in times]
            yield pd.DataFrame({key: [k[0]] * len(rows), order: rows[order].tolist(), "at": rows[at].tolist(), "recent": recent, "limited": [n > most for n in recent]})
        held = held[bisect.bisect_right(held, held[-1] - span) :]
        state.update((held,))
        state.setTimeoutTimestamp(max(held[-1] // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    kind, number = df.schema[key].dataType.simpleString(), df.schema[order].dataType.simpleString()
    return df.withWatermark(at, "1 minute").groupBy(key).applyInPandasWithState(update, f"{key} {kind}, {order} {number}, at timestamp, recent long, limited boolean", "times array<long>", "append", "EventTimeTimeout")
