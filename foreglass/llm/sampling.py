"""Bounded training samples, the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foreglass.scale import top_k


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds``; null ids are fold 0."""
    digest = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return F.when(F.col(id_col).isNull(), F.lit(0)).otherwise(F.pmod(digest, F.lit(folds))).cast("int")


def bounded_sample(rows: DataFrame, id_col: str, per_class: int, label_col: str, most: int = 10_000) -> DataFrame:
    """``id, label`` of at most ``per_class`` rows of each label and ``most`` in all, by the hash of the id.

    Runs on the two narrow columns; each task sends at most ``per_class`` rows a label.
    With many labels, each gives its first rows before any gives more.
    """
    keyed = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter("id is not null and label is not null")
    placed = keyed.distinct().withColumn("place", F.md5(F.col("id").cast("string")))
    ranked = top_k(placed, ["label"], ["place", "id"], per_class)
    return ranked.orderBy("rank", "place", "id", "label").limit(most).select("id", "label")
