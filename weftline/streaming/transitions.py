"""Transition graphs of event streams, beyond what the analysis of source trees needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, value) of events(event_id, ts, event_type, value): repeats of an event_id within the watermark count once."""
    e = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    out = e.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, end, n) of the sessions of events(ts, user_id): a session ends after a gap."""
    e = events.withWatermark("ts", late)
    out = e.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def transitions(events: DataFrame) -> DataFrame:
    """(src, dst, n): how often an event type follows another of the same user, for a table of events."""
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = events.select(F.col("event_type").alias("src"), nxt.alias("dst")).where("dst is not null")
    return rows.groupBy("src", "dst").agg(F.count("*").alias("n"))
