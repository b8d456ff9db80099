"""Readers. Every reader takes a path (or glob) and gives a lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from foreglass.functions.replies import plain_markup
from foreglass.scale import cut_lineage, spread

BROKEN = "_corrupt_record"


def read_table_file(
    spark: SparkSession,
    path: str,
    schema,
    file_type: str = "csv",
    sep: str = "\t",
    encoding: str = "utf-8",
    line_breaks_in_cells: bool = False,
) -> DataFrame:
    """Delimited (tab by default), JSON-lines or Parquet file with a known schema.

    A file whose quoted cells hold line breaks can't be split between tasks, so that is
    an option.
    """
    if file_type == "csv":
        return spark.read.schema(schema).csv(
            path, sep=sep, encoding=encoding, header=True, escape='"', multiLine=line_breaks_in_cells
        )
    if file_type == "json":
        return spark.read.schema(schema).json(path)
    if file_type == "parquet":
        return spark.read.schema(schema).parquet(path)
    raise ValueError(f"unknown file type {file_type}")


def read_headerless(spark: SparkSession, path: str, schema, sep: str = ",", encoding: str = "utf-8") -> DataFrame:
    return spark.read.schema(schema).csv(path, sep=sep, encoding=encoding, header=False, escape='"')


def batch_number(path: Column) -> Column:
    return F.regexp_extract(path, r"batch_(\d+)-", 1).cast("int")


def read_batches(
    spark: SparkSession,
    root: str,
    kind: str,
    schema,
    start: int | None = None,
    end: int | None = None,
    batches: list[int] | None = None,
    sep: str = ",",
    layout: str = "{kind}_logs/batch_*-{kind}/batch_*-from_df.csv",
) -> DataFrame:
    """All batch files of a kind with their ``batch_id``; missing batches are skipped.

    The batch filter is on the file path, so Spark drops files before reading.
    """
    pattern = f"{root}/{layout.format(kind=kind)}"
    found = spark.read.schema(schema).csv(pattern, sep=sep, header=True, escape='"')
    number = batch_number(F.col("_metadata.file_path"))
    found = found.withColumn("batch_id", number)
    if batches is not None:
        found = found.filter(number.isin(*batches))
    if start is not None:
        found = found.filter(number >= start)
    if end is not None:
        found = found.filter(number <= end)
    if found.isEmpty():
        raise ValueError("no batch file found")
    return found


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Paths below a folder, contents untouched; empty for a missing folder. Any other trouble is raised."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    if found is None or not len(found):
        return spark.createDataFrame([], "path string")
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")


def latest_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Newest file per prefix and extension: ``prefix-v10.csv`` beats ``prefix-v9.csv``."""
    return (
        versioned(files, path)
        .groupBy("prefix", "extension")
        .agg(F.max("version").alias("version"), F.max_by(path, "version").alias(path))
    )


def versioned(files: DataFrame, path: str = "path") -> DataFrame:
    """Prefix, number and extension of ``prefix-vN.ext`` or ``prefix-N.ext`` names."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    pattern = r"^(.*)-v?(\d+)\.([^.]+)$"
    return files.filter(name.rlike(pattern)).select(
        path,
        F.regexp_extract(name, pattern, 1).alias("prefix"),
        F.regexp_extract(name, pattern, 2).cast("bigint").alias("version"),
        F.regexp_extract(name, pattern, 3).alias("extension"),
    )


def next_numbers(files: DataFrame, path: str = "path") -> DataFrame:
    """Next free number per prefix; one counter over all extensions."""
    return versioned(files, path).groupBy("prefix").agg((F.max("version") + 1).alias("next_version"))


def latest_seed_folders(folders: DataFrame, folder: str = "folder") -> DataFrame:
    """Newest run folder per experiment and seed: ``seed4`` is version 0, ``seed4_v2`` 2.

    Seeds are whole numbers, so ``seed42`` is never taken for ``seed4``.
    """
    pattern = r"([^/]+)/seed(\d+)(?:_v(\d+))?$"
    version = F.regexp_extract(folder, pattern, 3)
    parsed = folders.filter(F.col(folder).rlike(pattern)).select(
        folder,
        F.regexp_extract(folder, pattern, 1).alias("experiment"),
        F.regexp_extract(folder, pattern, 2).cast("int").alias("seed"),
        F.when(version == "", F.lit(0)).otherwise(version.cast("int")).alias("version"),
    )
    return parsed.groupBy("experiment", "seed").agg(
        F.max("version").alias("version"), F.max_by(folder, "version").alias(folder)
    )


def read_json_lines(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_json_array(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Files that each hold one JSON array."""
    return (spark.read.schema(schema) if schema else spark.read).json(path, multiLine=True)


def read_lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """Raw lines in any encoding (the text source itself only knows UTF-8)."""
    if encoding.lower() == "utf-8":
        return spark.read.text(path).withColumnRenamed("value", "line")
    return spark.read.schema("line string").csv(path, sep="\u0001", quote="", encoding=encoding, header=False)


def split_at_last(lines: DataFrame, sep: str, names: tuple[str, str], line: str = "line") -> DataFrame:
    """``text@label`` lines cut at the last separator; lines without one are dropped."""
    text = F.col(line)
    parts = F.split(text, F.lit(f"\\Q{sep}\\E"))
    last = F.element_at(parts, -1)
    cut = F.length(text) - F.length(last) - len(sep)
    return lines.filter(F.contains(text, F.lit(sep))).select(
        F.substring(text, F.lit(1), cut).alias(names[0]), last.alias(names[1])
    )


def read_tag_lines(spark: SparkSession, path: str, columns: tuple[str, ...] = ("index", "word", "tag")):
    """Tag file: ``(good, bad)``; blank lines stay as rows with NULL columns.

    ``line`` orders the lines of a file. It is the start of the file block plus
    the line's place in the block, which never reaches the next block's start.
    The ids are written once, so that both outputs see the same numbers.
    """
    raw = spark.read.text(path).select(
        F.col("value").alias("content"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    kept = cut_lineage(raw)
    first = kept.groupBy("file", "_block").agg(F.min("_id").alias("_first"))
    lines = kept.join(first, ["file", "_block"]).withColumn("line", F.col("_block") + F.col("_id") - F.col("_first"))
    parts = F.split("content", "\t")
    blank = F.trim("content") == ""
    fits = blank | (F.size(parts) == len(columns))
    good = lines.filter(fits).select(
        "file",
        "line",
        *[F.when(~blank, F.get(parts, F.lit(i))).alias(name) for i, name in enumerate(columns)],
    )
    return good, lines.filter(~fits).select("file", "line", "content")


def read_keeping_broken(spark: SparkSession, path: str, schema: T.StructType, sep: str = ","):
    """``(good, bad)`` of a headerless delimited file; bad rows keep their raw line."""
    wide = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields], f"{BROKEN} string"])
    parsed = F.from_csv("value", wide, {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})
    rows = spark.read.text(path).select(parsed.alias("r")).select("r.*")
    return rows.filter(F.col(BROKEN).isNull()).drop(BROKEN), rows.filter(F.col(BROKEN).isNotNull())


def read_dropping_broken(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """Only the good rows; counted alike whatever columns are asked for.

    (The reader's own drop mode skips the check for columns that are not read.)
    """
    return read_keeping_broken(spark, path, schema, sep)[0]


def log_to_table(lines: DataFrame, ignore: list[str], delimiter: str = ",", line: str = "line") -> DataFrame:
    """Fields of the log lines that contain none of the given texts."""
    kept = lines
    for part in ignore:
        kept = kept.filter(~F.contains(F.col(line), F.lit(part)))
    fields = F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), F.lit(f"\\Q{delimiter}\\E"))
    return kept.select(fields.alias("fields"))


def table_to_log(df: DataFrame) -> DataFrame:
    """``CSV Row: a, b`` lines of a table; missing values are empty."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    return df.select(F.concat(F.lit("CSV Row: "), F.concat_ws(", ", *cells)).alias("value"))


def write_markup_files(df: DataFrame, row_id: str, markup: str, path: str, per_folder: int = 1000) -> None:
    """One file for every row, in folders ``shelf=<task>/box=<number>`` of at most ``per_folder`` files.

    A folder belongs to one task, so it is moved into place as a whole, and a reader lists
    folders of many files, not a folder for every file.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # of the row in its task
    placed = spread(df.select(row_id, markup), row_id).select(
        markup, F.spark_partition_id().alias("shelf"), F.floor(place / per_folder).alias("box")
    )
    placed.write.option("maxRecordsPerFile", 1).partitionBy("shelf", "box").text(path)


def read_markup_files(spark: SparkSession, path: str, extension: str = ".tml") -> DataFrame:
    """One row per markup file: plain text and file name; files without text are dropped."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=f"*{extension}", recursiveFileLookup=True)
    rows = files.select(plain_markup("value").alias("sentence"), F.col("_metadata.file_name").alias("file_name"))
    return rows.filter("sentence <> ''")


def flatten_hits(hits: DataFrame, query: dict[str, str], site: str) -> DataFrame:
    """Fields of ``_source`` as columns, with the query and the site they came from."""
    params = F.create_map(*[F.lit(x) for pair in query.items() for x in pair])
    return hits.select("_source.*", params.alias("query_params"), F.lit(site).alias("site"))


def read_folder(spark: SparkSession, folder: str, schema, file_format: str = "json") -> DataFrame:
    """Every file of a folder as one table, with the file each row came from."""
    rows = spark.read.schema(schema).format(file_format).load(folder)
    return rows.select("*", F.col("_metadata.file_name").alias("file_name"))


def run_record(df: DataFrame, label: str, rule: str) -> DataFrame:
    """One row about a run: rows in, rows per label value, rule, time."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col(label) == 1).alias("n_positive"),
        F.count_if(F.col(label) == 0).alias("n_negative"),
        F.count_if(F.col(label).isNull()).alias("n_missing"),
    ).select("*", F.lit(rule).alias("rule"), F.current_timestamp().alias("made_at"))
