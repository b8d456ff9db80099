"""Corpus pipeline: quality, near duplicates, benchmark passages, source weights, shards.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept.
``run`` writes each stage's rows as Parquet to the shared folder and reads them back, so
a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foreglass.llm import decontaminate, mixing, near_dedup, quality, sharding
from foreglass.llm.sampling import fold
from foreglass.scale import written_once

LEAST_QUALITY = 0.7
SHARDS = 40


def numbered(docs: DataFrame) -> DataFrame:
    """``row, doc``: every row with a number of its own, written once, so that rows of one id or of none can be told apart.

    The columns are packed, so none of their names can clash with those of a stage.
    """
    return written_once(docs.select(F.monotonically_increasing_id().alias("row"), packed(docs).alias("doc")), "numbered")


def packed(docs: DataFrame) -> Column:
    return F.struct(*columns_of(docs))


def columns_of(docs: DataFrame) -> list[Column]:
    """All columns, also those with a dot in their name."""
    return [F.col(f"`{c}`") for c in docs.columns]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    A null or empty text is scored like any other, by what it does not hold. Repeated
    rows get one score and stay or go together. Null ids have no label to learn from.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, fold("doc_id", 4) != 2)
    scored = quality.score(docs, model, carry=columns_of(docs))
    return scored.filter(F.col("score") >= LEAST_QUALITY).select("carried.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    Of a group the smallest id stays, null ids last, and one row of it, also where rows
    are repeated, share an id or have none. Texts without words are in no group: they stay.
    """
    rows = numbered(docs)
    found = near_dedup.near_duplicates(rows.select("row", "doc.text"), id_col="row", width=5, share=(80, 100))
    member = found.select(F.col("id").alias("row"), "component_id").join(rows.select("row", F.col("doc.doc_id").alias("id")), "row")
    member = written_once(member, "near-members")
    best = F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("best")
    groups = member.groupBy("component_id").agg(best, F.count(F.lit(1)).alias("c")).filter("c > 1")
    stays = written_once(groups.select("component_id", F.col("best.row").alias("stays")), "near-stays")
    gone = member.join(stays, "component_id").filter("row <> stays").select("row")
    return rows.join(gone, "row", "left_anti").select("doc.*")


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item.

    Every row is judged on its own text; one without words holds nothing and stays.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_items(docs, items, carry=columns_of(docs))
    return found.filter("n_hit = 0").select("carried.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix of the sources takes; none for those it leaves out.

    Every row counts for itself, also where ids repeat or are null. A row without words
    adds nothing to its source and is taken as often as its source is taken whole.
    """
    rows = numbered(docs)
    copies = mixing.mix_sources(rows.select("row", "doc.doc_id", "doc.text", "doc.source"), carry=["row"])
    taken = rows.join(copies.filter("copies > 0").select("row", "copies"), "row")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), "copies"))).select("doc.*")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row, beside its id and size.

    Rows of equal texts, null and empty ones included, are in one shard and have slots of their own.
    """
    placed = sharding.shard_documents(docs, shards=SHARDS)
    return placed.select(F.col("id").alias("doc_id"), "size", "shard", F.col("slot").cast("long").alias("slot"))


STAGES = [
    ("quality", good_quality),
    ("near duplicates", one_of_each),
    ("benchmark passages", no_benchmark),
    ("source weights", mixed),
    ("shards", sharded),
]

#: No SQL: the first stage is a trained model. Tests hold the other stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written_once(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
