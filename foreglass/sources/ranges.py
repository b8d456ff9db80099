"""Readers that split a file inside: CSV with line breaks in quoted cells, and JSON arrays.

Such records can't be told from a single line, so Spark's own readers give a whole file to
one task. Here the text source cuts files into byte ranges at a delimiter (a line break, or
a closing brace) and the ranges are understood in three narrow passes:

1. Every range tells how it would end if it began outside and inside quotes, and by how
   much the depth of brackets changes. One row per range leaves a task.
2. Prefix sums over the ranges of a file tell how each range really begins. Records cut by
   the end of a range, at most two pieces each range, are put together.
3. Every range yields the records that lie wholly inside it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T, Window

from foreglass.scale import small_slices, written_once

Step = Callable[[bytes, bool], tuple[bool, int]]


@dataclass
class Format:
    """How records are made of the units between delimiters.

    ``step(unit, inside)`` tells whether the end of a unit lies inside quotes and how the
    depth changes; a record ends after a unit outside quotes at depth ``level``. ``rest``
    tells whether a file's last, unfinished record counts.
    """

    delimiter: bytes
    step: Step
    level: int
    rest: bool
    finish: Callable[[bytes], bytes]


def csv_format(sep: str = ",") -> Format:
    """Cells in double quotes may hold separators, line breaks and doubled quotes.

    A quote inside a cell that doesn't begin with one is a plain character, and after a
    closing quote all up to the separator belongs to the cell, as in Spark's own reader.
    """
    s = re.escape(sep.encode())
    body = rb'[^"]*+(?:""[^"]*+)*+'
    left_open = re.compile(rb'(?:(?:"' + body + rb'"[^S]*+|[^"S][^S]*+)?+S)*+"'.replace(b"S", s) + body)
    quoted, mark = re.compile(body), sep.encode()

    def step(unit: bytes, inside: bool) -> tuple[bool, int]:
        if b'"' not in unit:
            return inside, 0
        at = 0
        if inside:
            end = quoted.match(unit).end()
            if end == len(unit):
                return True, 0
            at = unit.find(mark, end + 1) + 1
            if not at:
                return False, 0
        return left_open.fullmatch(unit, at) is not None, 0

    return Format(b"\n", step, 0, True, lambda record: record[:-1] if record.endswith(b"\r") else record)


def json_format() -> Format:
    """Objects of one array; braces and brackets inside strings don't count."""
    string = re.compile(rb'"(?:[^"\\]++|\\.)*+"', re.DOTALL)
    rest_of_string = re.compile(rb'(?:[^"\\]++|\\.)*+"', re.DOTALL)

    def step(unit: bytes, inside: bool) -> tuple[bool, int]:
        unit += b"}"
        if inside:
            found = rest_of_string.match(unit)
            if found is None:
                return True, 0
            unit = unit[found.end() :]
        plain = string.sub(b"", unit)
        cut = plain.find(b'"')
        if cut >= 0:
            plain = plain[:cut]
        return cut >= 0, plain.count(b"{") + plain.count(b"[") - plain.count(b"}") - plain.count(b"]")

    return Format(b"}", step, 1, False, lambda record: record.lstrip(b"[, \t\r\n") + b"}")


# ---- ranges ------------------------------------------------------------------


def _units(spark: SparkSession, path, delimiter: bytes) -> DataFrame:
    """Units of all files in order, with their range; the text source gives each unit to one range."""
    found = spark.read.text(path, lineSep=delimiter.decode())
    file, start = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    return found.select(F.col("value").cast("binary").alias("unit"), file, start).withColumn("range", F.xxhash64("file", "start"))


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int]]:
    """Runs of units of one range: ``batch, first, end``. A range may go on in the next batch."""
    for batch in small_slices(batches, "unit", 1 << 20):  # as bytes objects, units take far more
        own = batch.column("range").to_numpy()
        cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
        yield from ((batch, a, b) for a, b in zip(cuts, cuts[1:]))


def count_ranges(units: DataFrame, form: Format) -> DataFrame:
    """``file, start, range, ends_0, depth_0, ends_1, depth_1``: where a range ends, begun outside (0) or inside (1) quotes."""
    step = form.step
    shape = "file string, start long, range long, ends_0 boolean, depth_0 long, ends_1 boolean, depth_1 long"
    types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
    names = ["file", "start", "range", "ends_0", "depth_0", "ends_1", "depth_1"]

    def count(batches):
        at, ends, depth = None, [False, True], [0, 0]

        def row():
            cells = [*at, ends[0], depth[0], ends[1], depth[1]]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types)], names=names)

        for batch, lo, hi in _by_range(batches):
            here = tuple(batch.column(c)[lo].as_py() for c in ("file", "start", "range"))
            if here != at:
                if at is not None:
                    yield row()
                at, ends, depth = here, [False, True], [0, 0]
            for unit in batch.column("unit").slice(lo, hi - lo).to_pylist():
                first, change = step(unit, ends[0])
                if ends[0] == ends[1]:
                    second, other = first, change
                else:
                    second, other = step(unit, ends[1])
                ends, depth = [first, second], [depth[0] + change, depth[1] + other]
        if at is not None:
            yield row()

    return units.mapInArrow(count, shape)


def range_starts(counted: DataFrame) -> DataFrame:
    """``range, inside, depth`` at the start of every range, by prefix sums over the ranges of a file.

    A range keeps or swaps the two states, or ends in one state whatever it began in. So
    the state at a start is the last such fixed state, turned round by each swap since.
    The window holds one narrow row per range.
    """
    earlier = Window.partitionBy("file").orderBy("start")
    before, until = earlier.rowsBetween(Window.unboundedPreceding, -1), earlier.rowsBetween(Window.unboundedPreceding, 0)
    swap = (F.col("ends_0") & ~F.col("ends_1")).cast("long")
    fixed = F.when(F.col("ends_0") == F.col("ends_1"), F.col("ends_0").cast("long"))
    swaps = counted.withColumns({"_swap": swap, "_swaps": F.sum(swap).over(until)})
    # a fixed state as it would have been at the start of the file
    back = swaps.withColumn("_fixed", F.pmod(fixed + F.col("_swaps"), F.lit(2)))
    state = F.coalesce(F.last("_fixed", ignorenulls=True).over(before), F.lit(0)) + F.col("_swaps") - F.col("_swap")
    known = back.withColumn("inside", F.pmod(state, F.lit(2)) == 1)
    change = F.when(F.col("inside"), F.col("depth_1")).otherwise(F.col("depth_0"))
    return known.select("file", "start", "range", "inside", F.coalesce(F.sum(change).over(before), F.lit(0)).alias("depth"))


def _records(units: DataFrame, form: Format, starts, edges: bool) -> DataFrame:
    """Whole records of each range (``file, value, first``), or the pieces at its edges.

    ``first`` marks a file's first record that isn't blank. Pieces have ``range, place``
    (0 goes on with an earlier range, 1 is gone on with) and ``closes``.
    """
    step, level, finish, delimiter = form.step, form.level, form.finish, form.delimiter
    names = ["file", "start", "range", "place", "closes", "value", "first"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.bool_()]
    shape = "file string, start long, range long, place int, closes boolean, value binary, first boolean"

    def read(batches):
        ranges, insides, depths = starts.value
        at, held, out, size = None, [], [], 0
        inside, depth, whole, fresh = False, 0, True, False

        def emit(place, closes, value):
            return (*at, place, closes, value, fresh and whole)

        def pack(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch, lo, hi in _by_range(batches):
            here = tuple(batch.column(c)[lo].as_py() for c in ("file", "start", "range"))
            if here != at:
                if held and edges:
                    out.append(emit(int(whole), False, delimiter.join(held)))
                i = int(np.searchsorted(ranges, here[2]))
                if i == len(ranges) or ranges[i] != here[2]:
                    raise ValueError("the files, or spark.sql.files.maxPartitionBytes, have changed since the ranges were counted")
                at, held, inside, depth = here, [], bool(insides[i]), int(depths[i])
                fresh = here[1] == 0
                whole = fresh or (not inside and depth == level)
            for unit in batch.column("unit").slice(lo, hi - lo).to_pylist():
                held.append(unit)
                inside, change = step(unit, inside)
                depth += change
                if inside or depth != level:
                    continue
                value = delimiter.join(held)
                if whole and not edges:
                    value = finish(value)
                    if value:
                        out.append(emit(1, True, value))
                        size += len(value)
                elif edges and not whole:
                    out.append(emit(0, True, value))
                if value.strip():
                    fresh = False
                held, whole = [], True
                if size > 8 << 20 or len(out) > 10_000:
                    yield pack(out)
                    out, size = [], 0
        if held and edges:
            out.append(emit(int(whole), False, delimiter.join(held)))
        if out:
            yield pack(out)

    return units.mapInArrow(read, shape)


def split_records(spark: SparkSession, path, form: Format) -> DataFrame:
    """``file, value, first``: the records of all files, however they are cut into ranges.

    A record may go over any number of ranges. The driver and each task hold 17 bytes a
    range (128 MB of input by default). Ranges are those of the session's
    ``spark.sql.files.maxPartitionBytes``; if that has changed before the rows are read, reading fails.
    """
    units = _units(spark, path, form.delimiter)
    begins = written_once(range_starts(written_once(count_ranges(units, form), "range-counts")), "range-starts")
    held = begins.select("range", "inside", "depth").orderBy("range").toArrow()
    starts = spark.sparkContext.broadcast([held.column(c).to_numpy() for c in ("range", "inside", "depth")])
    pieces = written_once(_records(units, form, starts, edges=True), "range-edges")
    order = Window.partitionBy("file").orderBy("start", "place").rowsBetween(Window.unboundedPreceding, 0)
    keys = pieces.select("file", "start", "place", F.sum("place").over(order).alias("record"))
    listed = F.sort_array(F.collect_list(F.struct("start", "place", "value")))
    joined = (
        pieces.join(keys, ["file", "start", "place"])
        .groupBy("file", "record")
        .agg(listed.alias("parts"), F.max("closes").alias("closes"), F.max("first").alias("first"))
        .filter(F.col("closes") | F.lit(form.rest))
    )
    between, finish = form.delimiter, form.finish

    def mend(batches):
        for batch in batches:
            texts = [finish(between.join(p["value"] for p in parts)) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(texts, pa.binary()), batch.column("first")], names=["file", "value", "first"])

    cut = joined.select("file", "parts", "first").mapInArrow(mend, "file string, value binary, first boolean")
    return _records(units, form, starts, edges=False).select("file", "value", "first").unionByName(cut)


def read_csv_in_ranges(spark: SparkSession, path, schema: str | T.StructType, sep: str = ",", header: bool = True) -> DataFrame:
    """CSV (UTF-8) whose quoted cells may hold line breaks, split inside files; as Spark's ``multiLine`` reader reads it.

    Blank lines are skipped, a header is each file's first record, ``""`` in quotes is a
    quote. A quote that is never closed takes the rest of its file.
    """
    records = split_records(spark, path, csv_format(sep))
    if header:
        records = records.filter(~F.col("first"))
    ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    options = {"sep": sep, "escape": '"', "multiLine": "true"}
    return records.select(F.from_csv(F.decode("value", "UTF-8"), ddl, options).alias("r")).select("r.*")


def read_json_array_in_ranges(spark: SparkSession, path, schema: str | T.StructType) -> DataFrame:
    """Files that each hold one JSON array of objects, split inside files, on one line or on many.

    An empty array has no rows. Elements that are no objects are not rows of their own.
    """
    records = split_records(spark, path, json_format())
    return records.select(F.from_json(F.decode("value", "UTF-8"), schema).alias("r")).select("r.*")
