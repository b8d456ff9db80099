"""Micro-batch labelling: new files are picked up, labelled, appended; restarts add nothing twice."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from foreglass.scale import written_once


def watch_files(
    spark: SparkSession, folder: str, schema, file_format: str = "parquet", files_per_batch: int = 50, glob: str = "*"
) -> DataFrame:
    """Files of a folder as they appear, a fixed number per batch."""
    return (
        spark.readStream.schema(schema)
        .format(file_format)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(folder)
    )


def state_session(spark: SparkSession, partitions: int) -> SparkSession:
    """A session for streams whose state is small.

    A stream keeps one state store per shuffle partition for all its life, so the
    number is chosen for the state (a few keys per dimension), not for the tables.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    session.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return session


def run_available(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> None:
    """Work through what is there and stop; call again (or use a trigger) for more."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()


def label_stream(
    stream: DataFrame,
    label: Callable[[DataFrame], DataFrame],
    keys: list[str],
    out: str,
    checkpoint: str,
) -> None:
    """Label every batch and add it to ``out`` (Parquet, one folder per run and batch).

    The stream's own state keeps the keys it has seen, missing keys included, so a batch
    costs the same however many came before it. A batch that is replayed overwrites its
    own folder. A run lives as long as its checkpoint; if that is lost, a new run leaves
    out by an anti join the keys that earlier runs had finished when it started.
    """
    spark = stream.sparkSession
    run = run_name(spark, checkpoint)
    earlier = finished(spark, out)
    done = None
    if earlier is not None:
        others = earlier.filter(F.col("run") != run).select(F.struct(*keys).alias("_key")).distinct()
        done = None if others.isEmpty() else written_once(others, "done")

    def write(batch: DataFrame, number: int) -> None:
        rows = batch
        if done is not None:
            held = spark.read.schema(done.schema).parquet(*done.inputFiles())
            rows = rows.withColumn("_key", F.struct(*keys)).join(held, "_key", "left_anti").drop("_key")
        label(rows).write.mode("overwrite").parquet(f"{out}/run={run}/batch={number}")

    run_available(stream.dropDuplicates(keys), write, checkpoint)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def run_name(spark: SparkSession, checkpoint: str) -> str:
    """Name of the run that a checkpoint belongs to; kept in the checkpoint itself. Later runs have larger names."""
    path = f"{checkpoint}/run"
    if not _exists(spark, path):
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        spark.createDataFrame([(name,)], "value string").coalesce(1).write.text(path)
    return spark.read.text(path).first()["value"]


def finished(spark: SparkSession, out: str) -> DataFrame | None:
    """Results so far, or None before the first batch."""
    if not _exists(spark, out):
        return None
    return spark.read.option("basePath", out).parquet(f"{out}/run=*/batch=*")


def running_counts(stream: DataFrame, dimensions: list[str], out: str, checkpoint: str) -> None:
    """Counts per value of each dimension, kept up to date: state is one row per value.

    Only changed rows come with a batch. Each batch is merged with the counts that the
    one before it left, which are as few as there are values, so neither a batch nor
    ``current_counts`` reads what older batches wrote. A run lives as long as its
    checkpoint and never reads another's batches: if the checkpoint is lost, a new run
    counts the stream from its start, and its counts replace the old ones.
    """
    spark = stream.sparkSession
    out = f"{out}/run={run_name(spark, checkpoint)}"
    values = F.explode(
        F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    )
    counted = stream.select(values.alias("_v")).select("_v.*").groupBy("dimension", "value").count()

    def write(batch: DataFrame, number: int) -> None:
        before = f"{out}/batch={number - 1}"
        if _exists(spark, before):
            key = F.struct("dimension", "value").alias("_key")
            held = spark.read.schema(batch.schema).parquet(before).select("*", key)
            kept = held.join(batch.select(key), "_key", "left_anti").select(*batch.columns)
            batch = batch.unionByName(kept)
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    run_available(counted, write, checkpoint, mode="update")


def current_counts(spark: SparkSession, out: str) -> DataFrame:
    """Counts as the newest batch of the newest run left them."""
    run = list_folders(spark, out).agg(F.max("path")).first()[0]  # names of later runs are larger
    newest = list_folders(spark, run).agg(F.max(F.regexp_extract("path", r"batch=(\d+)$", 1).cast("bigint"))).first()[0]
    rows = spark.read.parquet(f"{run}/batch={newest}")
    return rows.select("dimension", "value", F.col("count").alias("n"))


def list_folders(spark: SparkSession, path: str) -> DataFrame:
    """Paths directly below a folder."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)
    return spark.createDataFrame([(f.getPath().toString(),) for f in found], "path string")


def first_per_key_stream(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Drop repeats of a key that arrive within ``delay``; state older than that is freed."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
