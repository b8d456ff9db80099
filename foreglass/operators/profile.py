"""Counts, profiles, vocabularies and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from foreglass.functions import text as X
from foreglass.scale import positions

ALL_DIFFERENT = "None as all are different labels"


def value_counts(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Counts of non-missing values, most frequent first."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(name))
    return counted.orderBy(F.desc(name), column)


def dataset_profile(df: DataFrame, data_type: str, dimensions: list[str]) -> DataFrame:
    """Totals per data type and counts per value of every dimension, in one pass.

    Long form ``(data_type, dimension, value, n)``; dimension ``total`` is the sum.
    """
    sets = [[data_type, d] for d in dimensions] + [[data_type]]
    counted = df.groupingSets(sets, data_type, *dimensions).agg(
        F.count("*").alias("n"), *[F.grouping(d).alias(f"_no_{d}") for d in dimensions]
    )
    name, value = F.lit("total"), F.lit(None).cast("string")
    for d in dimensions:
        name = F.when(F.col(f"_no_{d}") == 0, F.lit(d)).otherwise(name)
        value = F.when(F.col(f"_no_{d}") == 0, F.col(d).cast("string")).otherwise(value)
    return counted.select(F.col(data_type).alias("data_type"), name.alias("dimension"), value.alias("value"), "n")


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows and share in percent (one decimal) per label."""
    counted = df.groupBy(label).agg(F.count("*").alias("n"))
    everything = Window.partitionBy()  # over the few label rows only
    share = F.round(100.0 * F.col("n") / F.sum("n").over(everything), 1)
    return counted.withColumn("percent", share).orderBy(label)


def grouped_sum(df: DataFrame, index: list[str], value: str, columns: str | None = None, values=None) -> DataFrame:
    """Pivot table by sum; one-way without ``columns``, else one column per listed value."""
    grouped = df.groupBy(*index)
    if columns is None:
        return grouped.agg(F.sum(value).alias(value))
    return grouped.pivot(columns, values).agg(F.sum(value))


def term_document_counts(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Counts per word and document, in long form; computed inside each row."""
    counted = X.with_term_counts(df.select(doc_id, text), X.whitespace_tokens(text))
    return X.explode_terms(counted, [doc_id])


def word_counts(tokens: DataFrame, word: str = "word") -> DataFrame:
    return tokens.groupBy(F.col(word).alias("word")).agg(F.count("*").alias("n"))


def thresholded_vocabulary(counts: DataFrame, threshold: int = 3, unknown: str = "< unk >") -> DataFrame:
    """Words seen more than ``threshold`` times, the rest folded into one entry.

    The folded entry has index 0 and reports both how many rare words there are
    (``n_types``) and how often they occur (``n``).
    """
    kept = F.col("n") > threshold
    folded = (
        counts.groupBy(F.when(kept, F.col("word")).otherwise(F.lit(unknown)).alias("word"))
        .agg(F.sum("n").alias("n"), F.count("*").alias("n_types"))
        .withColumn("_rank", F.when(F.col("word") == unknown, F.lit(None)).otherwise(-F.col("n")))
        .withColumn("_rank", F.coalesce("_rank", F.lit(-(2**62))))
    )
    numbered = positions(folded, [], ["_rank", "word"], "index")
    return numbered.select("word", (F.col("index") - 1).alias("index"), "n", "n_types")


def judge_votes(replies: DataFrame, keys: list[str], reply: str, order: list[str]) -> DataFrame:
    """One vote per non-empty reply line: ``(keys, order, line_no, vote)``."""
    return replies.select(*keys, *order, F.posexplode(X.reply_lines(reply)).alias("line_no", "vote"))


def vote_verdicts(votes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Majority label per key.

    If no label occurs twice the verdict says so; on ties the label that showed
    up last for the first time wins.
    """
    per_label = votes.groupBy(*keys, "vote").agg(
        F.count("*").alias("n"), F.min(F.struct(*order, "line_no")).alias("first_seen")
    )
    rank = F.struct("n", "first_seen", "vote")
    best = per_label.groupBy(*keys).agg(F.max("n").alias("_top"), F.max_by("vote", rank).alias("_label"))
    verdict = F.when(F.col("_top") == 1, F.lit(ALL_DIFFERENT)).otherwise(F.col("_label"))
    return best.select(*keys, verdict.alias("majority_label"), F.col("_top").alias("n_votes"))


def label_votes(votes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Every vote with the verdict of its key."""
    return votes.join(vote_verdicts(votes, keys, order).drop("n_votes"), keys)


def agreement_levels(votes: DataFrame, key: str, label: str) -> DataFrame:
    """Majority label per sentence and its share of the votes (ties: smallest label)."""
    counted = votes.groupBy(key, label).agg(F.count("*").alias("n"))
    order = F.struct((-F.col("n")).alias("a"), F.col(label).alias("b"))
    best = counted.groupBy(key).agg(
        F.min_by(label, order).alias("majority_label"), F.max("n").alias("_top"), F.sum("n").alias("votes")
    )
    return best.select(key, "majority_label", "votes", (F.col("_top") / F.col("votes")).alias("share"))


def majority_of_columns(columns: list[str]) -> Column:
    """Most frequent value of several model columns; ties go to the smallest.

    Works inside the row, so no model table is ever reshaped.
    """
    votes = F.array_compact(F.array(*[F.col(c) for c in columns]))
    counted = F.transform(
        F.array_sort(F.array_distinct(votes)),
        lambda v: F.struct(F.size(F.filter(votes, lambda x: x == v)).alias("n"), v.alias("v")),
    )
    best = F.aggregate(
        F.slice(counted, 2, max(len(columns), 1)),
        F.get(counted, F.lit(0)),
        lambda a, b: F.when(b["n"] > a["n"], b).otherwise(a),
    )
    return best["v"]
