"""Model quality and rater agreement on ``labels`` with rule columns as models."""

from __future__ import annotations

from pyspark.sql import functions as F

from foreglass.catalog import register, table
from foreglass.operators import evaluate as E, profile as P
from foreglass.operators.experiments import rounded

MODELS = ["length_rule", "source_rule", "toxic_rule", "lang_rule"]
FULL_MODELS = ["length_rule", "source_rule", "toxic_rule"]

RATED = """rated as (select doc_id as row_id, quality as label, (n_chars >= 400)::int as length_rule,
    (source in ('src1', 'src2', 'src3'))::int as source_rule, 1 - toxic as toxic_rule,
    case lang when 'en' then 1 when 'fr' then 0 end as lang_rule, n_chars::double as n_chars
    from labels join documents using (doc_id))"""
LONG = f"""{RATED}, long as (
    select row_id, label as actual, 'length_rule' as model, length_rule as predicted from rated
    union all select row_id, label, 'source_rule', source_rule from rated
    union all select row_id, label, 'toxic_rule', toxic_rule from rated
    union all select row_id, label, 'lang_rule', lang_rule from rated)"""


def rated(spark, sf):
    return (
        table(spark, sf, "labels")
        .join(table(spark, sf, "documents").select("doc_id", "n_chars", "source", "lang"), "doc_id")
        .selectExpr(
            "doc_id as row_id",
            "quality as label",
            "int(n_chars >= 400) as length_rule",
            "int(source in ('src1', 'src2', 'src3')) as source_rule",
            "1 - toxic as toxic_rule",
            "case lang when 'en' then 1 when 'fr' then 0 end as lang_rule",
            "double(n_chars) as n_chars",
        )
    )


def counts(spark, sf):
    return E.outcome_counts(rated(spark, sf), "label", MODELS)


BINARY = """select model, round(avg((actual is not distinct from predicted)::int), 6) as accuracy,
    round(coalesce(count(*) filter (where actual = 1 and predicted = 1) /
          nullif(count(*) filter (where predicted = 1), 0), 0), 6) as precision,
    round(coalesce(count(*) filter (where actual = 1 and predicted = 1) /
          nullif(count(*) filter (where actual = 1), 0), 0), 6) as recall,
    round(coalesce(2 * count(*) filter (where actual = 1 and predicted = 1) /
          nullif(count(*) filter (where actual = 1) + count(*) filter (where predicted = 1), 0), 0), 6) as f1
    from long group by 1"""
register("binary_metrics", f"with {LONG} {BINARY}")(
    lambda spark, sf: rounded(E.binary_metrics(counts(spark, sf)), ["accuracy", "precision", "recall", "f1"])
)

CLASSES = """cls as (select m.model, c.c::varchar as class,
      count(*) filter (where actual = c and predicted = c) as tp,
      count(*) filter (where actual = c) as support, count(*) filter (where predicted = c) as flagged
    from long m, (values (0), (1)) c(c) group by all),
  pc as (select model, class, coalesce(tp / nullif(flagged, 0), 0) as precision,
      coalesce(tp / nullif(support, 0), 0) as recall, coalesce(2 * tp / nullif(support + flagged, 0), 0) as f1,
      support, tp from cls)"""
REPORT = """select model, class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1,
      support from pc
  union all select model, 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6),
      round(sum(tp) / sum(support), 6), sum(support)::bigint from pc group by 1
  union all select model, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
      sum(support)::bigint from pc group by 1
  union all select model, 'weighted avg', round(sum(precision * support) / sum(support), 6),
      round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
      sum(support)::bigint from pc group by 1"""
register("classification_report", f"with {LONG}, {CLASSES} {REPORT}")(
    lambda spark, sf: rounded(E.classification_report(counts(spark, sf)), ["precision", "recall", "f1"])
)

register(
    "confusion_matrix",
    f"""with {LONG} select model, c as actual, count(*) filter (where actual = c and predicted = 0) as predicted_0,
        count(*) filter (where actual = c and predicted = 1) as predicted_1
        from long, (values (0), (1)) c(c) group by all""",
)(lambda spark, sf: E.confusion_matrix(counts(spark, sf), [0, 1]))

AUC = """ranks as (select model, actual, avg(r) over (partition by model, score) as r from
     (select model, actual, score, row_number() over (partition by model order by score) as r from scored)),
   auc as (select model, round((sum(r) filter (where actual = 1) - count(*) filter (where actual = 1)
        * (count(*) filter (where actual = 1) + 1) / 2)
      / (count(*) filter (where actual = 1) * count(*) filter (where actual = 0)), 6) as auc
     from ranks group by 1)"""
register(
    "roc_auc",
    f"""with {RATED}, scored as (select 'length_rule' as model, label as actual, length_rule::double as score from rated
          union all select 'n_chars', label, n_chars from rated
          union all select 'toxic_rule', label, toxic_rule from rated), {AUC} select * from auc""",
)(
    lambda spark, sf: rounded(E.auc(rated(spark, sf), "label", ["length_rule", "n_chars", "toxic_rule"]), ["auc"])
)

register(
    "evaluate_models",
    f"""with {LONG}, {CLASSES}, scored as (select model, actual, predicted::double as score from long), {AUC}
        select model, auc, round(sum(tp) / sum(support), 6) as accuracy,
          round(max(precision) filter (where class = '0'), 6) as precision_class_0,
          round(max(precision) filter (where class = '1'), 6) as precision_class_1,
          round(max(recall) filter (where class = '0'), 6) as recall_class_0,
          round(max(recall) filter (where class = '1'), 6) as recall_class_1,
          round(max(f1) filter (where class = '0'), 6) as f1_class_0,
          round(max(f1) filter (where class = '1'), 6) as f1_class_1
        from pc join auc using (model) where model <> 'lang_rule' group by 1, 2""",
)(
    lambda spark, sf: (
        lambda summary: rounded(summary, [c for c in summary.columns if c != "model"])
    )(E.evaluate_models(rated(spark, sf), "label", FULL_MODELS))
)

KAPPA = """pairs as (select a.model as model_1, b.model as model_2, a.predicted as x, b.predicted as y
     from long a join long b using (row_id)
     where list_position(['length_rule', 'source_rule', 'toxic_rule', 'lang_rule'], a.model)
         < list_position(['length_rule', 'source_rule', 'toxic_rule', 'lang_rule'], b.model)
       and a.predicted is not null and b.predicted is not null),
   k as (select model_1, model_2, avg((x = y)::int) as po, avg(x) * avg(y) + (1 - avg(x)) * (1 - avg(y)) as pe
         from pairs group by all)"""
register(
    "cohens_kappa",
    f"""with {LONG}, {KAPPA} select model_1, model_2, round((po - pe) / (1 - pe), 6) as kappa from k
        where model_1 = 'length_rule' and model_2 = 'toxic_rule'""",
)(
    lambda spark, sf: rounded(E.cohens_kappa(rated(spark, sf), ["length_rule", "toxic_rule"]), ["kappa"])
)
register(
    "pairwise_kappa",
    f"with {LONG}, {KAPPA} select model_1, model_2, round((po - pe) / (1 - pe), 2) as kappa from k",
)(lambda spark, sf: E.cohens_kappa(rated(spark, sf), MODELS, decimals=2))

register(
    "fleiss_kappa",
    f"""with {RATED}, s as (select label + length_rule + source_rule + toxic_rule as ones, 4 as k from rated),
        t as (select count(*) as subjects, avg((ones * ones + (k - ones) * (k - ones) - k) / (k * (k - 1))) as p,
              sum(ones) / (count(*) * 4) as p1 from s)
        select subjects, round((p - (p1 * p1 + (1 - p1) * (1 - p1))) / (1 - (p1 * p1 + (1 - p1) * (1 - p1))), 6) as kappa,
               true as valid from t""",
)(
    lambda spark, sf: rounded(E.fleiss_kappa(rated(spark, sf), ["label", *FULL_MODELS]), ["kappa"])
)

register(
    "majority_of_models",
    f"""with {RATED} select row_id, case when ones * 2 > k then 1 else 0 end as majority from
        (select row_id, length_rule + source_rule + toxic_rule + coalesce(lang_rule, 0) as ones,
                3 + (lang_rule is not null)::int as k from rated)""",
)(lambda spark, sf: rated(spark, sf).select("row_id", P.majority_of_columns(MODELS).alias("majority")))

register(
    "misclassified_rows",
    f"""with {LONG} select row_id, actual, model, predicted, case actual when 0 then 'FP' when 1 then 'FN' end as kind
        from long where actual is distinct from predicted""",
)(lambda spark, sf: E.misclassified(rated(spark, sf), "row_id", "label", MODELS))

register(
    "error_ratios",
    f"""with {LONG} select model, round(avg((actual is distinct from predicted)::int), 6) as misclassified,
        round(1 - avg((actual is distinct from predicted)::int), 6) as correct, 1.0::double as total, count(*) as n
        from long group by 1""",
)(lambda spark, sf: rounded(E.error_ratios(counts(spark, sf)), ["misclassified", "correct"]))

register(
    "rows_per_model",
    f"""with {LONG}, w as (select row_id, model, predicted from long where actual is distinct from predicted)
        select row_id, model, count(*) over (partition by model) as n_model from w""",
)(
    lambda spark, sf: E.rows_per_model(E.misclassified(rated(spark, sf), "row_id", "label", MODELS)).select(
        "row_id", "model", "n_model"
    )
)

register(
    "metrics_json",
    f"""with {LONG}, b as ({BINARY}) select model,
        printf('{{"accuracy":%.3f,"rows":%d}}', round(accuracy, 3), (select count(*) from rated)) as metrics from b""",
)(
    lambda spark, sf: E.metrics_json(
        E.error_ratios(counts(spark, sf)).select(
            "model", F.round("correct", 3).cast("decimal(10,3)").alias("accuracy"), F.col("n").alias("rows")
        )
    )
)
