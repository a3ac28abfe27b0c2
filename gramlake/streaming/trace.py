"""Streams: running sums of a model over an event stream, and the latest state of each job, with bounded state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_fit(events: DataFrame, time: str, x: str, y: str, width: str, late: str, by: Sequence[str] = ()) -> DataFrame:
    """(window, by, n, slope, intercept) of a line in each tumbling window; rows later than the watermark are dropped by it.

    The state of a window is the aggregate's buffers, whatever the number of rows.
    """
    w = events.withWatermark(time, late).groupBy(F.window(time, width), *by)
    return w.agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def latest(events: DataFrame, key: str, order: str) -> DataFrame:
    """The last event of each key so far, for update or complete output."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("e")).select(key, "e.*")


def append_trace(events: DataFrame, path: str, checkpoint: str):
    """Append a stream of trace events to a table; offsets and files are committed together."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
