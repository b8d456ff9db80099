"""Search in nested event lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foreglass.functions.text import contains_text

FIELDS = ["Event", "Time", "Location", "Subject", "Object"]


def matching_events(df: DataFrame, title: str, groups: str, word: str) -> DataFrame:
    """Events (from ``array<array<struct>>``) in which any field mentions the word."""
    events = df.select(title, F.explode(F.flatten(F.col(groups))).alias("event"))
    mentioned = F.lit(False)
    for field in FIELDS:
        mentioned = mentioned | contains_text(F.col("event")[field], word)
    return events.filter(mentioned)


def event_columns(events: DataFrame, title: str, kind: str) -> DataFrame:
    """Time, place, subject and object of the events of one kind."""
    found = events.filter(F.col("event.Event") == kind)
    return found.select(title, *[F.col(f"event.{f}").alias(f.lower()) for f in FIELDS[1:]])
