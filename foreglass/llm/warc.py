"""Content-addressed WARC archive: payload bytes once, exact headers apart."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foreglass.scale import scratch_path, written_once

END = "\r\n"


def header_text(kind: Column, page: Column, url: Column, sha1: Column, length: Column, refers: Column, date: str) -> Column:
    """Header block of a record, with the empty line that ends it.

    Control characters of a URL are percent-encoded, so a URL can't add lines.
    """
    safe = url
    for code in range(32):
        safe = F.replace(safe, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    named = lambda value: F.concat(F.lit("<urn:page:"), F.coalesce(value.cast("string"), F.lit("")), F.lit(">"))
    nothing = F.lit("")
    return F.concat(
        F.lit("WARC/1.1" + END),
        field("WARC-Type", kind),
        field("WARC-Record-ID", named(page)),
        F.coalesce(field("WARC-Target-URI", safe), nothing),
        field("WARC-Date", F.lit(date)),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        F.when(kind == "revisit", field("WARC-Refers-To", named(refers))).otherwise(nothing),
        field("Content-Type", F.lit("text/html; charset=utf-8")),
        field("Content-Length", length.cast("string")),
        F.lit(END),
    )


def write_archive(
    pages: DataFrame,
    path: str,
    least_bytes: int = 1000,
    id_col: str = "page_id",
    url_col: str = "url",
    body_col: str = "html",
    date: str = "2020-01-01T00:00:00Z",
) -> None:
    """Write one record per page below ``path``: ``payloads`` by SHA-256, and ``headers``.

    Of records with equal payloads of at least ``least_bytes``, the one with the largest
    id is a response and others revisit it. Groups are counted on narrow rows with
    partial aggregates; the page that lends a payload is found before payloads move, so
    equal payloads never meet in one task. Null bodies are empty; a null URL has no
    header line; null ids rank below all others. Pages repeated as they are give a
    record each (all responses if they hold the largest id), and one payload.
    """
    rows = pages.select(
        F.col(id_col).alias("page"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(body_col), F.lit("")).cast("binary").alias("payload"),
    ).withColumns({"digest": F.unhex(F.sha2("payload", 256)), "length": F.octet_length("payload").cast("long")})
    holders = written_once(rows.groupBy("digest").agg(F.max("page").alias("holder")), "holders")
    narrow = rows.select("page", "url", "digest", "length", F.sha1("payload").alias("sha1"))
    kind = F.when((F.col("length") >= least_bytes) & ~F.col("page").eqNullSafe(F.col("holder")), "revisit").otherwise("response")
    narrow.join(holders, "digest").withColumn("type", kind).select(
        "digest",
        "length",
        F.encode(
            header_text(F.col("type"), F.col("page"), F.col("url"), F.col("sha1"), F.col("length"), F.col("holder"), date), "utf-8"
        ).alias("header"),
    ).write.parquet(f"{path}/headers")
    own = F.coalesce(F.col("page").cast("string"), F.lit(""))
    lender = holders.select("digest", F.coalesce(F.col("holder").cast("string"), F.lit("")).alias("lender"))
    kept = rows.select("digest", own.alias("lender"), "payload").join(lender, ["digest", "lender"], "left_semi")
    kept.dropDuplicates(["digest", "lender"]).select("digest", "payload").write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Rebuild the whole records by joining headers to payloads: ``record`` binary.

    A payload that does not have the digest it is stored under, or the length its
    header names, ends the job. A record that revisits another gets the payload back too.
    """
    headers = spark.read.parquet(f"{path}/headers")
    stored = spark.read.parquet(f"{path}/payloads").select("digest", "payload", F.unhex(F.sha2("payload", 256)).alias("found"))
    joined = headers.join(stored, "digest", "left")
    sound = (F.col("found") == F.col("digest")) & (F.octet_length("payload") == F.col("length"))
    record = F.concat("header", "payload", F.lit("\r\n\r\n").cast("binary"))
    return joined.select(F.when(sound, record).otherwise(F.raise_error(F.lit("a payload is not what its digest says"))).alias("record"))


def parse_records(records: DataFrame) -> DataFrame:
    """Header fields and payload of whole records, found by the header's own length."""
    at = F.position(F.lit(b"\r\n\r\n"), F.col("record"))
    head = F.decode(F.substring("record", F.lit(1), at + 3), "utf-8")
    field = lambda name: F.regexp_extract(head, rf"(?md)^{name}: (.*)\r$", 1)
    split = records.select("record", head.alias("head"), at.alias("at"), field("Content-Length").cast("long").alias("length"))
    head = F.col("head")
    named = lambda value: F.nullif(F.regexp_extract(value, "^<urn:page:(.*)>$", 1), F.lit(""))
    return split.select(
        field("WARC-Type").alias("type"),
        named(field("WARC-Record-ID")).alias("page"),
        F.nullif(field("WARC-Target-URI"), F.lit("")).alias("url"),
        F.regexp_extract(field("WARC-Payload-Digest"), "^sha1:(.*)$", 1).alias("payload_digest"),
        named(field("WARC-Refers-To")).alias("refers_to"),
        "length",
        F.substring("record", F.col("at") + 4, F.col("length").cast("int")).alias("payload"),
    )


def export_files(records: DataFrame, path: str) -> None:
    """Write whole records as gzipped WARC files, one per task, with Spark's text writer.

    The writer ends every value with the two line ends that end a record.
    """
    cut = F.expr("substring(record, 1, octet_length(record) - 4)")
    records.select(F.decode(cut, "utf-8").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def _records(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at) + 4
        line = next(x for x in data[at:stop].split(b"\r\n") if x.lower().startswith(b"content-length:"))
        end = stop + int(line.split(b":")[1])
        yield data[at : end + 4]
        at = end + 4


def import_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole records of gzipped WARC files, cut by their content lengths; a file is one task's work."""

    def cut(batches):
        import gzip

        import pyarrow as pa

        for batch in batches:
            for content in batch.column("content"):
                found = list(_records(gzip.decompress(content.as_py())))
                for i in range(0, len(found), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(found[i : i + 256], pa.binary())], names=["record"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(cut, "record binary")


def archived(pages: DataFrame, **options) -> DataFrame:
    """Write pages to a fresh archive in the shared folder, and parse what is read back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archive(pages, path, **options)
    return parse_records(read_archive(spark, path))
