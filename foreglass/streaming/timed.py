"""Labelling with state that ages: keys are forgotten after a while and then looked up in the results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from foreglass.scale import broadcast_if_small
from foreglass.streaming.batches import finished, run_available, run_name, state_session

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 1 << 14  # of the keys in state; part of the checkpoint, so it must stay


def timed_session(spark: SparkSession, partitions: int) -> SparkSession:
    """A session for streams with timed state, which lies in RocksDB beside each executor and in the checkpoint.

    Batches without data are off: state that ages by the clock would ask for one more of them for ever.
    """
    session = state_session(spark, partitions)
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    session.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    return session


def _first_seen(keys: list[int], order: list[int], names: list[str], held: T.StructType, keep_ms: int):
    """The processor of one bucket of keys: the first row of each key that the bucket does not hold already.

    Made inside a function so that it travels with its code. Rows come as Python values, so
    that whole numbers beside missing ones stay exact. Every call on state is an exchange of
    messages with Spark, so a bucket's keys are read by one call and the new ones added by one.
    """
    from pyspark.sql import Row
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    shape = Row(*names)

    def plain(value):
        """A value that is equal and hashed alike where Spark groups values together."""
        if isinstance(value, (list, tuple)):
            return tuple(plain(part) for part in value)
        if isinstance(value, bytearray):
            return bytes(value)
        return ("nan",) if value != value else value

    class FirstSeen(StatefulProcessor):
        def init(self, handle):
            self.held = handle.getListState("held", held, keep_ms)

        def handleInputRows(self, key, rows, timerValues):
            known = {plain(entry) for entry in self.held.get()}
            best = {}
            for row in rows:
                mine = plain([row[i] for i in keys])
                if mine in known:
                    continue
                rank = [(row[i] is None, row[i]) for i in order]
                if mine not in best or rank < best[mine][0]:
                    best[mine] = (rank, row)
            if not best:
                return
            self.held.appendList([tuple(row[i] for i in keys) for _, row in best.values()])
            now = timerValues.getCurrentProcessingTimeInMs()
            for _, row in best.values():
                yield shape(*row[: len(names) - 1], now)

        def close(self):
            pass

    return FirstSeen()


def first_rows(stream: DataFrame, keys: list[str], order: list[str], keep_ms: int) -> DataFrame:
    """The first row of each key that state does not hold, with ``_at``, the time of its batch in milliseconds.

    State is the key itself, in a list for each of ``BUCKETS`` hash buckets, and lives ``keep_ms``
    milliseconds from the batch that brought the key; it is not prolonged by repeats. A batch reads
    the keys of the buckets that it touches, and a task holds the first rows of one bucket. Of
    the rows of a key in one batch the first by ``order`` passes (NULL last; ties by a hash of the
    row, so a replay picks the same). Missing keys are keys. The stream must come from ``timed_session``.
    """
    fields = stream.schema.fields
    place = {name: i for i, name in enumerate(stream.columns)}
    safe = [f"c{i}" for i in range(len(fields))]
    own = [place[name] for name in keys]
    bucket = F.pmod(F.xxhash64(*[safe[i] for i in own]), F.lit(BUCKETS))
    marked = stream.toDF(*safe).withColumn("tie", F.xxhash64(*safe)).withColumn("bucket", bucket)
    out = T.StructType([T.StructField(n, f.dataType) for n, f in zip(safe, fields)] + [T.StructField("at", T.LongType())])
    held = T.StructType([T.StructField(safe[i], fields[i].dataType) for i in own])
    processor = _first_seen(own, [*[place[name] for name in order], len(fields)], out.names, held, keep_ms)
    return marked.groupBy("bucket").transformWithState(processor, out, "Append", "ProcessingTime").toDF(*stream.columns, "_at")


def label_stream_timed(
    stream: DataFrame,
    label: Callable[[DataFrame], DataFrame],
    keys: list[str],
    out: str,
    checkpoint: str,
    keep_ms: int,
    order: list[str] | None = None,
) -> None:
    """Label each key once, with state for the keys of the last ``keep_ms`` milliseconds only.

    ``label`` keeps the key columns. Results are Parquet below ``out``, one folder per run,
    batch and batch time. A key that passes the state is new, or its state has aged, or the
    checkpoint was lost; so the keys of a batch are looked up in what other runs wrote and in
    what this run wrote ``keep_ms`` or more before the batch. Younger folders are left out by
    their names, as state still holds their keys: a run that is younger than ``keep_ms`` looks
    up nothing. The look-up reads key columns only, and the batch goes to them, so results are
    not shuffled while a batch's keys are small. A replayed batch has its old time, finds none
    of its own rows and overwrites its own folder.
    """
    spark = stream.sparkSession
    run = run_name(spark, checkpoint)
    key = F.struct(*keys).alias("_key")

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            at = batch.agg(F.min("_at")).first()[0]
            if at is None:
                return
            rows = batch.drop("_at")
            done = finished(spark, out)
            if done is not None:
                aged = done.filter((F.col("run") != run) | (F.col("at") <= at - keep_ms)).select(key)
                asked = broadcast_if_small(rows.select(key))
                known = aged.join(asked, "_key", "left_semi").distinct()
                rows = rows.withColumn("_key", F.struct(*keys)).join(known, "_key", "left_anti").drop("_key")
            labelled = label(rows).withColumn("at", F.lit(at))
            labelled.write.mode("overwrite").partitionBy("at").parquet(f"{out}/run={run}/batch={number}")
        finally:
            batch.unpersist()

    run_available(first_rows(stream, keys, order or [], keep_ms), write, checkpoint)
