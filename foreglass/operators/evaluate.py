"""Quality of model outputs and agreement of raters.

Everything about hard labels is derived from one small table, the counts per
(model, actual, predicted), which costs a single pass with map-side partial
counts for any number of models.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window, functions as F

from foreglass.scale import cut_lineage, running_total


def outcome_counts(df: DataFrame, actual: str, models: list[str]) -> DataFrame:
    """``(model, actual, predicted, n)``; a missing prediction is its own value."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("int").alias("predicted")) for m in models])
    )
    spread = df.select(F.col(actual).cast("int").alias("actual"), pairs.alias("p"))
    return spread.groupBy("p.model", "actual", "p.predicted").agg(F.count("*").alias("n"))


def _ratio(top, bottom):
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def binary_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, and precision, recall and F1 for class 1, per model."""
    n = F.col("n")
    hit = F.col("actual").eqNullSafe(F.col("predicted"))
    sums = counts.groupBy("model").agg(
        F.sum(n).alias("rows"),
        F.sum(F.when(hit, n).otherwise(0)).alias("right"),
        F.sum(F.when(hit & (F.col("actual") == 1), n).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("actual") == 1, n).otherwise(0)).alias("positives"),
        F.sum(F.when(F.col("predicted") == 1, n).otherwise(0)).alias("flagged"),
    )
    tp2 = 2 * F.col("tp")
    return sums.select(
        "model",
        _ratio(F.col("right"), F.col("rows")).alias("accuracy"),
        _ratio(F.col("tp"), F.col("flagged")).alias("precision"),
        _ratio(F.col("tp"), F.col("positives")).alias("recall"),
        _ratio(tp2, F.col("positives") + F.col("flagged")).alias("f1"),
    )


def classification_report(counts: DataFrame) -> DataFrame:
    """Per class precision, recall, F1 and support, plus accuracy and averages."""
    n, zero = F.col("n"), F.lit(0).cast("bigint")
    hit = F.when(F.col("actual") == F.col("predicted"), n).otherwise(zero)
    sides = F.explode(
        F.array(
            F.struct(F.col("actual").alias("c"), n.alias("support"), zero.alias("flagged"), hit.alias("tp")),
            F.struct(F.col("predicted").alias("c"), zero.alias("support"), n.alias("flagged"), zero.alias("tp")),
        )
    )
    per_class = (
        counts.select("model", sides.alias("s"))
        .filter("s.c is not null")
        .groupBy("model", F.col("s.c").cast("string").alias("class"))
        .agg(F.sum("s.support").alias("support"), F.sum("s.flagged").alias("flagged"), F.sum("s.tp").alias("tp"))
    )
    scored = per_class.select(
        "model",
        "class",
        _ratio(F.col("tp"), F.col("flagged")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("support") + F.col("flagged")).alias("f1"),
        "support",
        "tp",
    )
    rows = F.sum("support")
    values = ["precision", "recall", "f1"]
    macro = scored.groupBy("model").agg(
        F.lit("macro avg").alias("class"), *[F.avg(v).alias(v) for v in values], rows.alias("support")
    )
    weighted = scored.groupBy("model").agg(
        F.lit("weighted avg").alias("class"),
        *[(F.sum(F.col(v) * F.col("support")) / rows).alias(v) for v in values],
        rows.alias("support"),
    )
    accuracy = scored.groupBy("model").agg(
        F.lit("accuracy").alias("class"), *[(F.sum("tp") / rows).alias(v) for v in values], rows.alias("support")
    )
    return scored.drop("tp").unionByName(accuracy).unionByName(macro).unionByName(weighted)


def confusion_matrix(counts: DataFrame, classes: list[int]) -> DataFrame:
    """One row per model and actual class, one column per predicted class, zeros filled in."""
    grid = (
        counts.select("model")
        .distinct()
        .select("model", F.explode(F.array(*[F.lit(c) for c in classes])).alias("actual"))
        .withColumn("predicted", F.lit(classes[0]))
        .withColumn("n", F.lit(0).cast("bigint"))
    )
    wide = counts.unionByName(grid).groupBy("model", "actual").pivot("predicted", classes).agg(F.sum("n"))
    return wide.select("model", "actual", *[F.coalesce(str(c), F.lit(0)).alias(f"predicted_{c}") for c in classes])


def auc(df: DataFrame, actual: str, scores: list[str], partitions: int | None = None) -> DataFrame:
    """Area under the ROC curve per score column, ties counted half.

    Rows collapse to one row per distinct score first; the running count of
    negatives below a score is taken per range of the scores. A missing score is
    below all others; a row without a known class counts as negative.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("m"), F.col(s).cast("double").alias("v")) for s in scores]))
    spread = df.select(F.coalesce(F.col(actual) == 1, F.lit(False)).alias("hit"), pairs.alias("p"))
    per_score = spread.groupBy(F.col("p.m").alias("model"), F.col("p.v").alias("score")).agg(
        F.count_if("hit").cast("double").alias("pos"), F.count_if(~F.col("hit")).cast("double").alias("neg")
    )
    kept = cut_lineage(per_score)  # the rows are read once; the running count looks at scores only
    return _area(running_total(kept, ["model"], ["score"], F.col("neg"), "neg_to_here", partitions))


def label_auc(counts: DataFrame) -> DataFrame:
    """AUC of hard labels straight from the outcome counts (a few distinct labels per model)."""
    n = F.col("n").cast("double")
    per_label = counts.groupBy("model", F.col("predicted").alias("score")).agg(
        F.sum(F.when(F.col("actual") == 1, n).otherwise(0.0)).alias("pos"),
        F.sum(F.when(F.col("actual") == 1, 0.0).otherwise(n)).alias("neg"),
    )
    so_far = Window.partitionBy("model").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    return _area(per_label.withColumn("neg_to_here", F.sum("neg").over(so_far)))


def _area(ordered: DataFrame) -> DataFrame:
    wins = F.sum(F.col("pos") * (F.col("neg_to_here") - F.col("neg") / 2))
    pairs_total = F.sum("pos") * F.sum("neg")
    return ordered.groupBy("model").agg(F.when(pairs_total > 0, wins / pairs_total).alias("auc"))


def evaluate_models(df: DataFrame, actual: str, models: list[str]) -> DataFrame:
    """Summary row per model: accuracy, per-class scores and AUC of the hard labels."""
    return summary_of_counts(outcome_counts(df, actual, models))


def summary_of_counts(counts: DataFrame) -> DataFrame:
    """The same summary from ``(model, actual, predicted, n)`` counts."""
    # one pass over the rows; everything below works on a handful of counts
    counts = cut_lineage(counts)
    report = classification_report(counts).filter(F.col("class").isin("0", "1", "accuracy"))
    pick = lambda c, v: F.max(F.when(F.col("class") == c, F.col(v)))
    summary = report.groupBy("model").agg(
        pick("accuracy", "f1").alias("accuracy"),
        *[pick(c, v).alias(f"{v}_class_{c}") for v in ("precision", "recall", "f1") for c in ("0", "1")],
    )
    return summary.join(label_auc(counts), "model")


def rater_pair_counts(df: DataFrame, raters: list[str]) -> DataFrame:
    """Counts per rater pair and pair of ratings; rows with a missing rating are left out."""
    pairs = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(a).alias("model_1"),
                    F.lit(b).alias("model_2"),
                    F.col(a).cast("string").alias("a"),
                    F.col(b).cast("string").alias("b"),
                )
                for a, b in combinations(raters, 2)
            ]
        )
    )
    spread = df.select(pairs.alias("p")).select("p.*").filter("a is not null and b is not null")
    return spread.groupBy("model_1", "model_2", "a", "b").agg(F.count("*").alias("n"))


def cohens_kappa(df: DataFrame, raters: list[str], decimals: int | None = None) -> DataFrame:
    """Cohen's kappa of every rater pair, over the union of both raters' categories."""
    pairs = ["model_1", "model_2"]
    counts = rater_pair_counts(df, raters)
    sides = F.explode(
        F.array(
            F.struct(F.col("a").alias("c"), F.col("n").alias("left"), F.lit(0).cast("bigint").alias("right")),
            F.struct(F.col("b").alias("c"), F.lit(0).cast("bigint").alias("left"), F.col("n").alias("right")),
        )
    )
    margins = (
        counts.select(*pairs, sides.alias("s"))
        .groupBy(*pairs, "s.c")
        .agg(F.sum("s.left").cast("double").alias("left"), F.sum("s.right").cast("double").alias("right"))
        .groupBy(*pairs)
        .agg(F.sum(F.col("left") * F.col("right")).alias("chance"))
    )
    agreed = counts.groupBy(*pairs).agg(
        F.sum("n").cast("double").alias("rows"),
        F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"),
    )
    observed = F.col("same") / F.col("rows")
    expected = F.col("chance") / (F.col("rows") * F.col("rows"))
    kappa = F.when(expected < 1, (observed - expected) / (1 - expected))
    if decimals is not None:
        kappa = F.round(kappa, decimals)
    return agreed.join(margins, pairs).select(*pairs, kappa.alias("kappa"))


def fleiss_kappa(df: DataFrame, raters: list[str]) -> DataFrame:
    """One row: Fleiss' kappa over the rater columns.

    Missing ratings are left out; subjects with unequal numbers of ratings make
    the measure undefined, which the ``valid`` flag reports.
    """
    votes = F.array_compact(F.array(*[F.col(r).cast("string") for r in raters]))
    same = F.aggregate(
        votes, F.lit(0).cast("bigint"), lambda t, x: t + F.size(F.filter(votes, lambda y: y == x)) - 1
    )
    subjects = df.select(votes.alias("votes"), same.alias("same")).filter(F.size("votes") > 0)
    spread = subjects.select("same", F.size("votes").alias("k"), F.posexplode("votes").alias("i", "c"))
    first = F.col("i") == 0
    per_category = spread.groupBy("c").agg(
        F.count("*").cast("double").alias("n"),
        F.sum(F.when(first, F.col("same")).otherwise(0)).cast("double").alias("same"),
        F.count_if(first).cast("double").alias("subjects"),
        F.min("k").alias("k_min"),
        F.max("k").alias("k_max"),
    )
    total = per_category.agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("n")).alias("n2"),
        F.sum("same").alias("same"),
        F.sum("subjects").alias("subjects"),
        F.min("k_min").alias("k_min"),
        F.max("k_max").alias("k"),
    )
    valid = (F.col("k_min") == F.col("k")) & (F.col("k") > 1)
    agreement = F.col("same") / (F.col("subjects") * F.col("k") * (F.col("k") - 1))
    chance = F.col("n2") / (F.col("n") * F.col("n"))
    kappa = F.when(valid & (chance < 1), (agreement - chance) / (1 - chance))
    return total.select(F.col("subjects").cast("bigint").alias("subjects"), kappa.alias("kappa"), valid.alias("valid"))


def misclassified(df: DataFrame, row_id: str, actual: str, models: list[str]) -> DataFrame:
    """One row per wrong model output; a missing output is wrong. ``kind`` is FP or FN."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("int").alias("predicted")) for m in models])
    )
    spread = df.select(row_id, F.col(actual).cast("int").alias("actual"), pairs.alias("p"))
    wrong = spread.select(row_id, "actual", "p.model", "p.predicted").filter(
        ~F.col("actual").eqNullSafe(F.col("predicted"))
    )
    return wrong.withColumn("kind", F.when(F.col("actual") == 0, "FP").when(F.col("actual") == 1, "FN"))


def error_ratios(counts: DataFrame) -> DataFrame:
    """Wrong and right share per model; models without errors stay in."""
    wrong = F.sum(F.when(F.col("actual").eqNullSafe(F.col("predicted")), 0).otherwise(F.col("n")))
    sums = counts.groupBy("model").agg(wrong.alias("wrong"), F.sum("n").alias("n"))
    share = F.col("wrong") / F.col("n")
    return sums.select(
        "model", share.alias("misclassified"), (1 - share).alias("correct"), F.lit(1.0).alias("total"), "n"
    )


def rows_per_model(df: DataFrame, model: str = "model") -> DataFrame:
    """Each row with the number of rows of its model.

    The count is joined back instead of windowed, so that a frequent model is
    not gathered in one task.
    """
    return df.join(df.groupBy(model).agg(F.count("*").alias("n_model")), model)


def metrics_json(summary: DataFrame) -> DataFrame:
    """All model metrics in one JSON column."""
    rest = [c for c in summary.columns if c != "model"]
    return summary.select("model", F.to_json(F.struct(*rest)).alias("metrics"))

