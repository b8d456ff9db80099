"""Writers with versioned names."""

from __future__ import annotations

import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from foreglass.sources.scans import list_files

FORMATS = ("csv", "json", "parquet")


def next_version(df: DataFrame, folder: str, prefix: str) -> int:
    """One more than the highest ``prefix-vN`` below the folder, from 1."""
    pattern = rf"/\Q{prefix}\E-v(\d+)(?:[./]|$)"
    number = F.regexp_extract("path", pattern, 1)
    found = list_files(df.sparkSession, folder).filter(number != "").agg(F.max(number.cast("bigint")))
    return (found.first()[0] or 0) + 1


def _claimed(spark: SparkSession, path: str) -> bool:
    """Create an empty file that must not be there yet; of several writers one succeeds."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(place.getParent())
    if fs.getUri().getScheme() == "file":  # Hadoop's local create looks first and creates then
        return spark.sparkContext._jvm.java.io.File(place.toUri().getPath()).createNewFile()
    try:
        fs.create(place, False).close()
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def save_versioned(
    df: DataFrame, folder: str, prefix: str, file_format: str = "csv", include_version: bool = True
) -> str:
    """Write under the next free version, or over ``prefix`` without versions; gives the path.

    Rows go to a folder that readers do not see. Then the writer claims the next number
    that no other has claimed and renames its folder to it, so a version is whole, is
    never overwritten, and holds the rows of one writer.
    """
    if file_format not in FORMATS:
        raise ValueError(f"unknown file type {file_format}")
    spark = df.sparkSession
    path = f"{folder}/_writing-{uuid.uuid4().hex}" if include_version else f"{folder}/{prefix}"
    writer = df.write.mode("errorifexists" if include_version else "overwrite")
    if file_format == "csv":
        writer = writer.option("header", "true").option("escape", '"')
    writer.format(file_format).save(path)
    if not include_version:
        return path
    version = next_version(df, folder, prefix)
    while not _claimed(spark, f"{folder}/_claims/{prefix}-v{version}"):
        version += 1
    whole = f"{folder}/{prefix}-v{version}"
    places = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (path, whole)]
    if not places[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(*places):
        raise OSError(f"could not rename {path} to {whole}")
    return whole


def save_batches(df: DataFrame, root: str, kind: str, batch: str) -> None:
    """Batch table partitioned by batch, for pruned reads by batch range."""
    df.write.partitionBy(batch).mode("errorifexists").parquet(f"{root}/{kind}")


def write_log(df: DataFrame, path: str) -> None:
    from foreglass.sources.scans import table_to_log

    table_to_log(df).write.mode("append").text(path)


def write_json_arrays(df: DataFrame, path: str) -> None:
    """One JSON array in each part file, an object a line; an empty partition gives an empty array."""

    def lines(batches):
        opening = "["
        for batch in batches:
            if batch.num_rows:
                texts = [f",{text}" for text in batch.column("value").to_pylist()]
                texts[0] = opening + (texts[0][1:] if opening else texts[0])
                opening = ""
                yield pa.RecordBatch.from_arrays([pa.array(texts)], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array([f"{opening}]"])], names=["value"])

    df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(lines, "value string").write.text(path)
