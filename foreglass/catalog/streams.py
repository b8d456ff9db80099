"""Micro-batch jobs: the given tables arrive as files, the written results are read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from foreglass.catalog import register, table
from foreglass.functions import text as X
from foreglass.scale import scratch_path
from foreglass.streaming import batches as B, timed as D


def arriving(spark, sf, name, columns, files_per_batch):
    """A table written as several files, read as a stream."""
    folder = scratch_path(spark, f"in-{name}")
    rows = table(spark, sf, name).select(*columns)
    rows.repartition(6).write.parquet(folder)
    session = B.state_session(spark, spark.sparkContext.defaultParallelism)
    return B.watch_files(session, folder, rows.schema, files_per_batch=files_per_batch, glob="*.parquet")


def _labelled(rows):
    return rows.select("doc_id", X.mentions_any("text", ["the", "of"]).cast("int").alias("label"))


LABELLED = r"""select doc_id, regexp_matches(lower(text), '(?:^|[^\p{L}\p{N}_])(?:the|of)(?:[^\p{L}\p{N}_]|$)')::int as label
   from documents"""


@register("labelled_batches", LABELLED)
def labelled_batches(spark, sf):
    out, checkpoint = scratch_path(spark, "labelled"), scratch_path(spark, "progress")
    B.label_stream(arriving(spark, sf, "documents", ["doc_id", "text"], 2), _labelled, ["doc_id"], out, checkpoint)
    return B.finished(spark, out).select("doc_id", "label")


@register("resumed_batches", LABELLED)
def resumed_batches(spark, sf):
    """The same stream twice with a lost checkpoint in between: nothing is labelled twice."""
    out = scratch_path(spark, "labelled")
    stream = arriving(spark, sf, "documents", ["doc_id", "text"], 6)
    for _ in range(2):
        B.label_stream(stream, _labelled, ["doc_id"], out, scratch_path(spark, "progress"))
    return B.finished(spark, out).select("doc_id", "label")


@register("later_files", LABELLED)
def later_files(spark, sf):
    """Files that arrive between two runs are picked up by the second, on the same checkpoint."""
    folder, out, progress = (scratch_path(spark, name) for name in ("in-later", "labelled", "progress"))
    rows = table(spark, sf, "documents").select("doc_id", "text")
    session = B.state_session(spark, spark.sparkContext.defaultParallelism)
    for half in (0, 1):
        rows.filter(F.col("doc_id") % 2 == half).write.mode("append").parquet(folder)
        stream = B.watch_files(session, folder, rows.schema, glob="*.parquet")
        B.label_stream(stream, _labelled, ["doc_id"], out, progress)
    return B.finished(spark, out).select("doc_id", "label")


@register(
    "labelled_missing_keys",
    """select lang, max(n_chars) > 0 as label from (select nullif(lang, 'de') as lang, n_chars from documents) group by 1""",
)
def labelled_missing_keys(spark, sf):
    """A missing key is a key: labelled once, also after the checkpoint was lost."""
    out = scratch_path(spark, "labelled")
    columns = [F.expr("nullif(lang, 'de')").alias("lang"), "n_chars"]
    stream = arriving(spark, sf, "documents", columns, 2)
    label = lambda rows: rows.select("lang", (F.col("n_chars") > 0).alias("label"))
    for _ in range(2):
        B.label_stream(stream, label, ["lang"], out, scratch_path(spark, "progress"))
    return B.finished(spark, out).select("lang", "label")


@register(
    "running_counts",
    """select 'lang' as dimension, lang as value, count(*) as n from documents group by 2
       union all select 'source', source, count(*) from documents group by 2""",
)
def running_counts(spark, sf):
    out = scratch_path(spark, "counts")
    stream = arriving(spark, sf, "documents", ["doc_id", "lang", "source"], 2)
    B.running_counts(stream, ["lang", "source"], out, scratch_path(spark, "progress"))
    return B.current_counts(spark, out)


@register("first_events_stream", "select user_id, event_type, count(*) > 0 as seen from events group by all")
def first_events_stream(spark, sf):
    out = scratch_path(spark, "first")
    stream = arriving(spark, sf, "events", ["event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")], 3)
    kept = B.first_per_key_stream(stream, ["user_id", "event_type"], "ts", "3650 days")
    B.run_available(kept, lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}"), scratch_path(spark, "progress"))
    return spark.read.parquet(f"{out}/batch=*").select("user_id", "event_type", F.lit(True).alias("seen"))


@register("labelled_after_aging", LABELLED)
def labelled_after_aging(spark, sf):
    """All rows arrive twice on one checkpoint, and a third time after it was lost; state holds a key for a
    millisecond only, so repeats are told by the look-up in the results."""
    folder, out, progress = (scratch_path(spark, name) for name in ("in-aging", "labelled", "progress"))
    rows = table(spark, sf, "documents").select("doc_id", "text")
    session = D.timed_session(spark, spark.sparkContext.defaultParallelism)
    for arrival in range(3):
        if arrival < 2:
            rows.write.mode("append").parquet(folder)
        stream = B.watch_files(session, folder, rows.schema, glob="*.parquet")
        D.label_stream_timed(stream, _labelled, ["doc_id"], out, f"{progress}-{arrival // 2}", keep_ms=1)
    return B.finished(spark, out).select("doc_id", "label")


@register("first_events_timed", "select user_id, event_type, min(ts)::timestamp as ts from events group by all")
def first_events_timed(spark, sf):
    """Of the rows of a key in one batch, the earliest passes the state."""
    folder, out = scratch_path(spark, "in-first"), scratch_path(spark, "first")
    rows = table(spark, sf, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    rows.write.parquet(folder)
    session = D.timed_session(spark, spark.sparkContext.defaultParallelism)
    stream = B.watch_files(session, folder, rows.schema, files_per_batch=1_000_000, glob="*.parquet")
    keep = lambda batch: batch
    D.label_stream_timed(stream, keep, ["user_id", "event_type"], out, scratch_path(spark, "progress"), 3_600_000, ["ts"])
    return B.finished(spark, out).select("user_id", "event_type", "ts")
