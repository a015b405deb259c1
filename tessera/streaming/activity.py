"""Activity as a stream: calendar windows with a watermark, and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def believable(ts: str, first: str = "1990-01-01"):
    """Whether an instant can be true: not before `first` and not over a day ahead. Such rows still count in totals."""
    return F.col(ts).between(F.lit(first).cast("timestamp"), F.current_timestamp() + F.expr("interval 1 day"))


def windowed(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(at, kind, n, value) of each window, batch or stream; state is dropped `late` behind the newest event."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "kind").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("at"), "kind", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """(who, started, ended, n): stretches of one person's events no further apart than `gap`."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "who").agg(F.count("*").alias("n")).select("who", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")
