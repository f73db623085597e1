"""Cumulative drift sums in event time: rows may arrive in any order within a bound."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftmark.config import PERIOD, SERIES_KEY, DetectorParams

INPUT = f"source_table string, metric string, {PERIOD} date, z_score double"
OUTPUT = f"source_table string, metric string, {PERIOD} date, cusum_high double, cusum_low double, rejected boolean"
STATE = "high double, low double, days array<date>, scores array<double>"
LATE = "28 days"
_EPOCH = dt.date(1970, 1, 1)


def _millis(day: dt.date) -> int:
    return (day - _EPOCH).days * 86_400_000


def drift(series: DataFrame, params: DetectorParams = DetectorParams(), late: str = LATE) -> DataFrame:
    """Fold one row per series and period into high and low sums, in order of the periods.

    The sums need the period before, so a row waits in the state of its series until the watermark, ``late`` behind the newest
    period of all series, has passed it; a timer of the state then releases what is due, whether or not the series has new
    rows. A series holds as many rows as there are periods within the bound.

    A row whose period the watermark has passed on arrival is dropped by the stream and counted (``late_rows``). Of several rows with
    one period, the first to arrive counts; the others come out without sums and marked as rejected. Rows without a source, metric or
    period carry no score and only move the watermark, which ends a series that gets no more rows.
    """
    slack = params.cusum_slack

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if any(k is None for k in key):
            for _ in frames:
                pass
            return
        high, low, days, scores = state.get if state.exists else (0.0, 0.0, [], [])
        waiting = dict(zip(days, scores))
        out = []
        for frame in frames:
            for day, z in zip(frame[PERIOD], frame["z_score"]):
                if day in waiting:
                    out.append((day, float("nan"), float("nan"), True))
                else:
                    waiting[day] = None if pd.isna(z) else float(z)
        passed = state.getCurrentWatermarkMs()
        for day in sorted(d for d in waiting if _millis(d) <= passed):
            z = waiting.pop(day)
            if z is not None:
                high, low = max(0.0, high + z - slack), max(0.0, low - z - slack)
            out.append((day, high, low, False))
        state.update((high, low, list(waiting), list(waiting.values())))
        if waiting:
            state.setTimeoutTimestamp(max(_millis(min(waiting)), passed + 1))
        if out:
            rows = pd.DataFrame(out, columns=[PERIOD, "cusum_high", "cusum_low", "rejected"])
            rows.insert(0, "metric", key[1])
            rows.insert(0, "source_table", key[0])
            yield rows

    timed = series.withColumn("at", F.to_timestamp(PERIOD)).withWatermark("at", late)
    return timed.groupBy(*SERIES_KEY).applyInPandasWithState(fold, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def start_drift(
    series: DataFrame, out: str, checkpoint: str, params: DetectorParams = DetectorParams(), late: str = LATE
) -> StreamingQuery:
    return (
        drift(series, params, late)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def late_rows(query: StreamingQuery) -> int:
    """Rows that the last runs of a drift stream dropped because they came too late."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
