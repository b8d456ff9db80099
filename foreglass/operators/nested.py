"""Search in JSON of any shape and depth, as variants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from foreglass.scale import written_once


def json_leaves(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """``row_id, path, kind, value``: every value of a JSON text that is no object or list, with its path from ``$``.

    Objects and lists are opened level by level, inside the row's task; the loop ends when
    no row holds a deeper one, so the number of passes is the depth of the deepest text.
    ``kind`` is the value's type, ``value`` the value as text (a JSON null is NULL). Texts
    that are null or no JSON have no leaves.
    """
    spark = df.sparkSession
    parsed = df.select(row_id, F.lit("$").alias("path"), F.try_parse_json(text).alias("v")).filter("v is not null")
    levels = []
    while True:
        told = parsed.withColumn("kind", F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0))
        level = written_once(told, "json-level")
        inner = F.col("kind").isin("OBJECT", "ARRAY")
        levels.append(level.filter(~inner).select(row_id, "path", "kind", F.try_variant_get("v", "$", "string").alias("value")))
        open_ones = level.filter(inner)
        if open_ones.isEmpty():
            return reduce(DataFrame.unionAll, levels)
        children = open_ones.select(row_id, "path", "v").lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        parsed = children.select(row_id, F.concat("path", step).alias("path"), F.col("value").alias("v"))


def json_search(df: DataFrame, row_id: str, text: str, word: str) -> DataFrame:
    """``row_id, path, value`` of the text values, at any depth and under any name, that hold the word in any case."""
    leaves = json_leaves(df, row_id, text)
    return leaves.filter((F.col("kind") == "STRING") & F.contains(F.lower("value"), F.lit(word.lower()))).select(row_id, "path", "value")
