"""Building blocks that keep operators flat when one key holds much of the data.

Three ideas recur in the library:

* A side is broadcast only after its bytes were measured (``broadcast_if_small``).
* Ordered work (numbering, running sums, looking back) runs on range partitions of
  the whole order, and only one summary row per key and partition is ordered
  globally, so a hot key is spread over as many tasks as its rows need.
* "The first q rows of each class" is found as a cut-off value: only the one
  hash bucket that holds the boundary is ever ranked.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T, Window

BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, which every executor can reach.

    Where that is unset, the folder lies in the SQL warehouse, which on a cluster must not be
    a folder of each machine. It is deleted when the application ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
        if not _reachable(base, spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = f"{base.rstrip('/')}/foreglass-{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def _reachable(folder: str, master: str) -> bool:
    """Whether every executor can reach a folder: its file system is no local one, or there is one process only."""
    local_files = folder.startswith(("file:", "/")) or ":" not in folder
    return not local_files or master == "local" or master.startswith("local[")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is ever written twice."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and stops plans from growing."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Write a summary once; hint a broadcast only if its values are few enough bytes.

    Beyond the bound the frame comes back without a hint and Spark joins by
    shuffle (with its skew handling) instead.
    """
    kept = written_once(df, "summary")
    return F.broadcast(kept) if value_bytes(kept) <= max_bytes else kept


def value_bytes(df: DataFrame) -> int:
    """Bytes of all values, written as text."""
    return df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))).cast("bigint"))).first()[0] or 0


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a table of fewer files than cores before CPU-heavy work on each row.

    A layout choice only, for files that a scan cannot split; the rows are the same, and
    hashing a key is repeatable.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df


def written_once(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write an expensive intermediate table to the shared folder and read it back.

    Later steps then scan columns of a file instead of repeating the work, also
    after an executor is lost. ``options`` are those of the Parquet writer.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def looked_up(
    rows: DataFrame, column: str, key: str, table: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], ddl: str, limit: int = 1 << 21
) -> DataFrame:
    """``work(rows, found)`` for rows with lists whose entries are looked up in a table that is too large for every task.

    Rows go to chunks of about ``limit`` entries. A chunk meets ``found``, the rows of ``table``
    whose ``key`` is among its distinct entries (of a struct, the field ``key``), so a frequent
    entry is sent once a chunk, and what is held at a time does not grow with either side.
    """
    shape = T.StructType([*rows.schema.fields, T.StructField("_chunk", T.LongType())])

    def number(batches):
        first, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            sizes = pc.list_value_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
            ends = held + np.cumsum(sizes.astype(np.int64) + 1)
            held = int(ends[-1]) if len(ends) else held
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first + ends // limit)], names=[*batch.schema.names, "_chunk"])

    numbered = written_once(rows.mapInArrow(number, shape), "chunks")
    entry = F.col("_e").getField(key) if isinstance(rows.schema[column].dataType.elementType, T.StructType) else F.col("_e")
    wanted = numbered.select(F.col("_chunk").alias("_asks"), F.explode(column).alias("_e")).select("_asks", entry.alias(key)).distinct()
    found = wanted.join(table, key)
    return numbered.groupBy("_chunk").cogroup(found.groupBy("_asks")).applyInArrow(work, ddl)


def rows_within(df: DataFrame, max_rows: int) -> list:
    """Rows of a frame that the caller wants as Python rows, at most so many; raises beyond."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"expected at most {max_rows} rows")
    return rows


_PLACE = ["_tie", "_row"]


def in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Rows range-partitioned by keys and order, written once, with their partition's number ``_part``.

    Spark samples the real columns for the bounds, so any orderable type will do and
    NULLs come first. Ties go by a hash of the row and then by its place, so not even
    equal rows must share a partition. ``_key`` holds the keys as one struct, in which
    NULLs are equal. The number of partitions is the session's unless given.
    """
    hashable = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
    placed = df.withColumns(
        {
            "_key": F.struct(*keys) if keys else F.lit(0),
            "_tie": F.xxhash64(*hashable),
            "_row": F.monotonically_increasing_id(),
        }
    )
    by = [*keys, *order, *_PLACE]
    ranged = placed.repartitionByRange(partitions, *by) if partitions else placed.repartitionByRange(*by)
    return written_once(ranged.withColumn("_part", F.spark_partition_id()), "ordered")


def _totals(rows: DataFrame, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Running sums of rows of ``in_order``: inside (key, partition), plus what earlier partitions add."""
    rows = rows.withColumn("_value", value)
    sums = rows.groupBy("_key", "_part").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_key", "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_earlier"))
    inside = Window.partitionBy("_key", "_part").orderBy(*order, *_PLACE).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("_inside", F.sum("_value").over(inside))
        .join(before, ["_key", "_part"])
        .withColumn(name, F.col("_earlier") + F.coalesce("_inside", F.lit(0)))
        .drop("_value", "_inside", "_earlier")
    )


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, partitions: int | None = None
) -> DataFrame:
    """Inclusive running sum of ``value`` per key in the given order.

    The sum runs inside (key, range partition); what earlier partitions add is
    computed on one row per key and partition. NULL keys are a key, NULL orders come
    first, NULL values add nothing.
    """
    total = _totals(in_order(df, keys, order, partitions), order, value, name)
    return total.drop("_key", "_part", *_PLACE)


def positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position", partitions: int | None = None
) -> DataFrame:
    """``row_number`` per key (1-based) without one task per key."""
    return running_total(df, keys, order, F.lit(1).cast("bigint"), name, partitions)


def look_back(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: dict[str, tuple[str, int]],
    position: str = "_position",
    partitions: int | None = None,
) -> DataFrame:
    """``lag`` columns, given as ``{new: (column, offset)}``, for keys of any size.

    Rows are numbered first and each key is cut into blocks of about a range
    partition; the last rows of a block are also sent to the next one, so that every
    block can look back on its own. The copies are dropped again after the window.
    """
    depth = max(offset for _, offset in columns.values())
    rows = in_order(df, keys, order, partitions)
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.max("_part").alias("last")).first()
    size = max(depth, -(-shape["n"] // ((shape["last"] or 0) + 1)))
    numbered = _totals(rows, order, F.lit(1).cast("bigint"), position)
    block = F.floor((F.col(position) - 1) / size)
    tail = (F.col(position) - 1) % size >= size - depth
    copied = numbered.withColumn("_home", block).withColumn(
        "_block", F.explode(F.when(tail, F.array(block, block + 1)).otherwise(F.array(block)))
    )
    window = Window.partitionBy("_key", "_block").orderBy(position)
    for new, (column, offset) in columns.items():
        copied = copied.withColumn(new, F.lag(column, offset).over(window))
    return copied.filter("_home = _block").drop("_home", "_block", "_key", "_part", *_PLACE)


def stable_hash(seed: int, *columns: str) -> Column:
    """Hex digest of seed and row identity: the same order on every run and retry."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def _hashed(df: DataFrame, row_id: str, seed: int, digits: int) -> tuple[DataFrame, Column]:
    """Rows with hash and hash bucket, and the value by which rows are chosen."""
    hashed = df.withColumn("_hash", stable_hash(seed, row_id))
    place = F.struct(F.col("_hash").alias("h"), F.col(row_id).alias("r"))
    return hashed.withColumn("_bucket", F.substring("_hash", 1, digits)), place


def mark_rows(df: DataFrame, quota: int, row_id: str, seed: int, name: str, digits: int = 4) -> DataFrame:
    """Flag exactly ``quota`` rows of the table, chosen by hash order (see ``mark_quota``)."""
    hashed, place = _hashed(df, row_id, seed, digits)
    sizes = hashed.groupBy("_bucket").count()
    so_far = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)  # over the few buckets
    edge = sizes.withColumn("_to_here", F.sum("count").over(so_far)).filter(F.col("_to_here") >= quota)
    found = edge.orderBy("_bucket").first() if quota > 0 else None
    if found is None:
        return df.withColumn(name, F.lit(quota > 0))
    take = quota - (found["_to_here"] - found["count"])
    inside = hashed.filter(F.col("_bucket") == found["_bucket"]).select(place.alias("_at")).orderBy("_at").limit(take)
    last = inside.agg(F.max("_at").alias("m")).first()["m"]
    cut = F.struct(F.lit(last["h"]).alias("h"), F.lit(last["r"]).alias("r"))
    return hashed.withColumn(name, place <= cut).drop("_hash", "_bucket")


def mark_quota(
    df: DataFrame,
    key: str,
    quotas: DataFrame,
    row_id: str,
    seed: int,
    name: str,
    digits: int = 4,
) -> DataFrame:
    """Flag exactly ``quota`` rows of each class, chosen by hash order.

    ``quotas`` has one row ``(key, quota)`` per class. Counts per (class, hash
    prefix) locate the bucket in which the quota runs out; only that bucket is
    ranked, and the result is one cut-off row per class. The wide rows are then
    compared with their cut-off without any shuffle.
    """
    hashed, place = _hashed(df, row_id, seed, digits)
    slim = hashed.select(key, "_bucket", place.alias("_at"))
    sizes = slim.groupBy(key, "_bucket").count()
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        sizes.withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .join(quotas.select(key, "quota"), key)
        .filter("_before < quota and quota <= _before + count")
        .select(key, "_bucket", (F.col("quota") - F.col("_before")).alias("_take"))
    )
    rank = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy("_at"))
    cutoffs = (
        slim.join(broadcast_if_small(edges), [key, "_bucket"])
        .withColumn("_rank", rank)
        .filter("_rank = _take")
        .select(key, F.col("_at").alias("_cut"))
    )
    return (
        hashed.join(broadcast_if_small(cutoffs), key, "left")
        .withColumn(name, F.coalesce(place <= F.col("_cut"), F.lit(False)))
        .drop("_hash", "_bucket", "_cut")
    )


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence, k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key.

    The rank filter sits right above the window, so Spark keeps at most ``k``
    rows per key and task before the shuffle; a hot key costs k rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def small_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches whose texts have at most ``limit`` bytes, or lists as many entries; or of one row.

    A batch may hold 64 MB, and work on its words or characters many times that.
    """
    for batch in batches:
        values = batch.column(column)
        size = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
        ends = np.cumsum(size.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        lo = 0
        while lo < batch.num_rows:
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
