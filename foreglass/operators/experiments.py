"""Averaging of experiment runs over seeds, datasets and models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

KINDS = ["imbalanced", "oversampled", "undersampled"]


def latest_versions(runs: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """Only the rows of the highest version per key (several rows may share it)."""
    newest = runs.groupBy(*keys).agg(F.max(version).alias(version))
    return runs.join(newest, [*keys, version], "left_semi")


def average_runs(runs: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean and sample standard deviation over seeds, per ``keys`` + model.

    One wide row per model, plus ``mean_row`` (mean of means) and ``std_row``
    (standard deviation of the standard deviations) per ``keys``.
    """
    per_model = runs.groupBy(*keys, "model").agg(
        F.count_distinct("seed").alias("n_seeds"),
        *[F.avg(m).alias(f"{m}_mean") for m in metrics],
        *[F.stddev_samp(m).alias(f"{m}_std") for m in metrics],
    )
    overall = per_model.groupBy(*keys).agg(
        F.max("n_seeds").alias("n_seeds"),
        *[F.avg(f"{m}_mean").alias(f"{m}_mean") for m in metrics],
        *[F.stddev_samp(f"{m}_std").alias(f"{m}_std") for m in metrics],
    )
    none = F.lit(None).cast("double")
    mean_row = overall.withColumn("model", F.lit("mean_row")).withColumns({f"{m}_std": none for m in metrics})
    std_row = overall.withColumn("model", F.lit("std_row")).withColumns({f"{m}_mean": none for m in metrics})
    return per_model.unionByName(mean_row).unionByName(std_row)


def mean_and_std_text(averaged: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """``0.8179 ± 0.0493`` per model and metric; the model name is kept."""
    models = averaged.filter(~F.col("model").isin("mean_row", "std_row"))
    text = lambda m: F.when(
        F.col(f"{m}_std").isNotNull(), F.format_string("%.4f ± %.4f", f"{m}_mean", f"{m}_std")
    ).otherwise(F.format_string("%.4f", f"{m}_mean"))
    return models.select(*keys, "model", *[text(m).alias(m) for m in metrics])


def dataset_kind(experiment: str) -> Column:
    """Kind of training set named in an experiment, else the full name."""
    kind = F.col(experiment)
    for name in reversed(KINDS):
        kind = F.when(F.contains(F.col(experiment), F.lit(name)), F.lit(name)).otherwise(kind)
    return kind


def cross_dataset_margins(means: DataFrame, metrics: list[str], kinds: list[str] = KINDS) -> DataFrame:
    """Per model: every metric per dataset kind, then mean, population std and margin.

    ``means`` holds one row per (experiment, model); of several experiments of a
    kind the last one (by name) counts.
    """
    kind = dataset_kind("experiment")
    last = means.withColumn("kind", kind).groupBy("model", "kind").agg(
        *[F.max_by(m, "experiment").alias(m) for m in metrics]
    )
    wide = last.groupBy("model").pivot("kind", kinds).agg(*[F.first(m).alias(m) for m in metrics])
    if len(metrics) == 1:
        wide = wide.withColumnsRenamed({k: f"{k}_{metrics[0]}" for k in kinds})
    stats = last.groupBy("model").agg(
        *[
            stat
            for m in metrics
            for stat in (
                F.avg(m).alias(f"{m}_mean_across_datasets"),
                F.stddev_pop(m).alias(f"{m}_std_across_datasets"),
                (F.max(m) - F.min(m)).alias(f"{m}_margin"),
            )
        ]
    )
    return wide.join(stats, "model")


def accuracy_per_dataset(means: DataFrame, metric: str = "accuracy") -> DataFrame:
    """Spread of a metric over the models of each dataset kind, best and worst model."""
    value = F.col(metric)
    last = (
        means.withColumn("dataset", dataset_kind("experiment"))
        .groupBy("dataset", "model")
        .agg(F.max_by(metric, "experiment").alias(metric))
    )
    best = F.min_by("model", F.struct((-value).alias("a"), F.col("model").alias("b")))
    worst = F.min_by("model", F.struct(value.alias("a"), F.col("model").alias("b")))
    return last.groupBy("dataset").agg(
        F.avg(value).alias(f"{metric}_mean"),
        F.stddev_samp(value).alias(f"{metric}_std"),
        F.min(value).alias(f"{metric}_min"),
        F.max(value).alias(f"{metric}_max"),
        (F.max(value) - F.min(value)).alias(f"{metric}_margin"),
        best.alias("best_model"),
        worst.alias("worst_model"),
    )


def rounded(df: DataFrame, columns: list[str], decimals: int = 6) -> DataFrame:
    return reduce(lambda d, c: d.withColumn(c, F.round(c, decimals)), columns, df)
