"""Splits, resampling and weights; every choice is a hash of row identity and seed.

Shares are exact per class, results repeat on every run and after lost tasks,
and no class is ever sorted as a whole (see ``scale.mark_quota``).
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, functions as F

from foreglass.scale import broadcast_if_small, cut_lineage, mark_quota, mark_rows, stable_hash

METHODS = ("oversample", "undersample")


def _class_key(columns: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])


def split_rows(
    df: DataFrame, row_id: str, test_size: float = 0.2, seed: int = 42, stratify: list[str] | None = None
) -> DataFrame:
    """Add ``is_test``: exactly ``round(n * test_size)`` rows, per class if stratified.

    Classes with a single row cannot be stratified; then all rows are split as
    one class, with a warning.
    """
    share = lambda n: F.floor(n * F.lit(test_size) + 0.5).cast("bigint")
    if not stratify:
        quota = df.agg(share(F.count("*"))).first()[0]
        return mark_rows(df, quota, row_id, seed, "is_test")
    marked = df.withColumn("_class", _class_key(stratify))
    sizes = broadcast_if_small(marked.groupBy("_class").agg(F.count("*").alias("_n")))
    if not sizes.filter("_n < 2").isEmpty():
        warnings.warn("a class has a single row: splitting without stratification", stacklevel=2)
        return split_rows(df, row_id, test_size, seed)
    quotas = sizes.select("_class", share(F.col("_n")).alias("quota"))
    return mark_quota(marked, "_class", quotas, row_id, seed, "is_test").drop("_class")


def resampled(df: DataFrame, row_id: str, label: str, method: str, seed: int = 42) -> DataFrame:
    """Balanced classes.

    ``undersample`` keeps as many rows of each class as the smallest one has.
    ``oversample`` keeps all rows and repeats rows of smaller classes, each about
    equally often, until every class is as large as the largest; ``copy`` is 0
    for the original. Rows without a label belong to no class and are left out.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    df = df.filter(F.col(label).isNotNull())
    sizes = cut_lineage(df.groupBy(label).agg(F.count("*").alias("_n")))
    bounds = sizes.agg(F.min("_n").alias("low"), F.max("_n").alias("high")).first()
    if method == "undersample":
        quotas = sizes.select(label, F.lit(bounds["low"]).alias("quota"))
        return mark_quota(df, label, quotas, row_id, seed, "_kept").filter("_kept").drop("_kept")
    target = F.lit(bounds["high"])
    quotas = sizes.select(
        label, (target % F.col("_n")).alias("quota"), F.floor(target / F.col("_n")).alias("_times")
    )
    marked = mark_quota(df, label, quotas, row_id, seed, "_extra")
    counted = marked.join(broadcast_if_small(quotas.select(label, "_times")), label)
    times = F.col("_times") + F.col("_extra").cast("int")
    return counted.withColumn("copy", F.explode(F.sequence(F.lit(0), (times - 1).cast("int")))).drop("_times", "_extra")


def class_weights(df: DataFrame, label: str, given: dict | None = None) -> DataFrame:
    """Weight column: given per class, or n / (classes x rows of the class)."""
    if given is not None:
        pairs = F.create_map(*[F.lit(x) for pair in given.items() for x in pair])
        return df.withColumn("weight", F.try_element_at(pairs, F.col(label)))
    sizes = cut_lineage(df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("_n")))
    total = sizes.agg(F.sum("_n").alias("n"), F.count("*").alias("k")).first()
    weight = F.lit(total["n"]) / (F.lit(total["k"]) * F.col("_n"))
    return df.join(broadcast_if_small(sizes.select(label, weight.alias("weight"))), label, "left")


def folds(df: DataFrame, row_id: str, k: int, seed: int = 42) -> DataFrame:
    """Fold number 0..k-1 from the row hash."""
    head = F.conv(F.substring(stable_hash(seed, row_id), 1, 8), 16, 10).cast("bigint")
    return df.withColumn("fold", (head % k).cast("int"))


def scaling_parameters(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column, in one pass."""
    stats = df.agg(
        *[F.avg(c).alias(f"{c}_m") for c in columns], *[F.stddev_pop(c).alias(f"{c}_s") for c in columns]
    ).first()
    return {c: (stats[f"{c}_m"] or 0.0, stats[f"{c}_s"] or 1.0) for c in columns}


def scaled(df: DataFrame, parameters: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({f"{c}_scaled": (F.col(c) - m) / s for c, (m, s) in parameters.items()})


def unscaled(df: DataFrame, parameters: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({f"{c}_restored": F.col(f"{c}_scaled") * s + m for c, (m, s) in parameters.items()})
