"""Averages over experiment runs; ``lineitem`` aggregates stand in for metric files."""

from __future__ import annotations

from pyspark.sql import functions as F

from foreglass.catalog import register, table
from foreglass.operators import experiments as X

METRICS = ["accuracy", "f1_class_1", "auc"]

RUNS = """runs as (select case l_linenumber % 4 when 0 then 'seeds_imbalanced' when 1 then 'seeds_oversampled'
      when 2 then 'seeds_undersampled' else 'seeds_plain' end as experiment,
    year(l_shipdate) as seed, l_returnflag || l_linestatus as model,
    avg(l_quantity / 50) as accuracy, avg(l_discount * 10) as f1_class_1, avg(l_tax * 10) as auc
    from lineitem group by 1, 2, 3)"""
MEANS = f"""{RUNS}, means as (select experiment, model, count(distinct seed) as n_seeds,
    avg(accuracy) as accuracy, avg(f1_class_1) as f1_class_1, avg(auc) as auc,
    stddev_samp(accuracy) as accuracy_std, stddev_samp(f1_class_1) as f1_class_1_std, stddev_samp(auc) as auc_std
    from runs group by 1, 2)"""


def runs(spark, sf):
    return (
        table(spark, sf, "lineitem")
        .selectExpr(
            """case l_linenumber % 4 when 0 then 'seeds_imbalanced' when 1 then 'seeds_oversampled'
               when 2 then 'seeds_undersampled' else 'seeds_plain' end as experiment""",
            "year(l_shipdate) as seed",
            "concat(l_returnflag, l_linestatus) as model",
            "l_quantity / 50 as a",
            "l_discount * 10 as f",
            "l_tax * 10 as u",
        )
        .groupBy("experiment", "seed", "model")
        .agg(F.avg("a").alias("accuracy"), F.avg("f").alias("f1_class_1"), F.avg("u").alias("auc"))
    )


def means(spark, sf):
    return runs(spark, sf).groupBy("experiment", "model").agg(*[F.avg(m).alias(m) for m in METRICS])


ROUNDED = ", ".join(f"round({m}, 6) as {m}_mean, round({m}_std, 6) as {m}_std" for m in METRICS)
register(
    "average_runs",
    f"""with {MEANS}
        select experiment, model, n_seeds, {ROUNDED} from means
        union all by name
        select experiment, 'mean_row' as model, max(n_seeds) as n_seeds,
          {', '.join(f'round(avg({m}), 6) as {m}_mean, null as {m}_std' for m in METRICS)} from means group by 1
        union all by name
        select experiment, 'std_row' as model, max(n_seeds) as n_seeds,
          {', '.join(f'null as {m}_mean, round(stddev_samp({m}_std), 6) as {m}_std' for m in METRICS)}
        from means group by 1""",
)(
    lambda spark, sf: X.rounded(
        X.average_runs(runs(spark, sf), ["experiment"], METRICS),
        [f"{m}_{s}" for m in METRICS for s in ("mean", "std")],
    )
)

register(
    "mean_and_std_text",
    f"""with {MEANS} select experiment, model,
        {', '.join(f"printf('%.4f ± %.4f', {m}, {m}_std) as {m}" for m in METRICS)} from means""",
)(
    lambda spark, sf: X.mean_and_std_text(
        X.average_runs(runs(spark, sf), ["experiment"], METRICS), ["experiment"], METRICS
    )
)

KINDS = """case when contains(experiment, 'imbalanced') then 'imbalanced' when contains(experiment, 'oversampled')
    then 'oversampled' when contains(experiment, 'undersampled') then 'undersampled' else experiment end"""
register(
    "cross_dataset_margins",
    f"""with {MEANS}, k as (select {KINDS} as kind, * from means) select model,
        {', '.join(f"round(max({m}) filter (where kind = '{k}'), 6) as {k}_{m}" for k in X.KINDS for m in METRICS)},
        {', '.join(f'round(avg({m}), 6) as {m}_mean_across_datasets, round(stddev_pop({m}), 6) as {m}_std_across_datasets, round(max({m}) - min({m}), 6) as {m}_margin' for m in METRICS)}
        from k group by 1""",
)(
    lambda spark, sf: (lambda d: X.rounded(d, [c for c in d.columns if c != "model"]))(
        X.cross_dataset_margins(means(spark, sf), METRICS)
    )
)

register(
    "accuracy_per_dataset",
    f"""with {MEANS}, k as (select {KINDS} as dataset, model, accuracy from means)
        select dataset, round(avg(accuracy), 6) as accuracy_mean, round(stddev_samp(accuracy), 6) as accuracy_std,
          round(min(accuracy), 6) as accuracy_min, round(max(accuracy), 6) as accuracy_max,
          round(max(accuracy) - min(accuracy), 6) as accuracy_margin,
          arg_min(model, (-accuracy, model)) as best_model, arg_min(model, (accuracy, model)) as worst_model
        from k group by 1""",
)(
    lambda spark, sf: X.rounded(
        X.accuracy_per_dataset(means(spark, sf)), [f"accuracy_{s}" for s in ("mean", "std", "min", "max", "margin")]
    )
)

register(
    "latest_run_versions",
    """with v as (select year(l_shipdate) as seed, l_linenumber as version, sum(l_quantity) as q
           from lineitem where l_returnflag <> 'A' or l_linenumber < 5 group by 1, 2)
       select seed, version, round(q, 2) as q from v qualify version = max(version) over (partition by seed)""",
)(
    lambda spark, sf: X.latest_versions(
        table(spark, sf, "lineitem")
        .filter("l_returnflag <> 'A' or l_linenumber < 5")
        .groupBy(F.year("l_shipdate").alias("seed"), F.col("l_linenumber").alias("version"))
        .agg(F.round(F.sum("l_quantity"), 2).alias("q")),
        ["seed"],
    )
)
