"""Knowledge graph of statements: source -> outcome -> target."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def statement_edges(
    df: DataFrame, row_id: str, source: str, target: str, outcome: str, relation: str
) -> DataFrame:
    """Directed edges, one per node pair; of several relations the last row's stays."""
    says = df.select(row_id, F.col(source).alias("src"), F.col(outcome).alias("dst"), F.col(relation).alias("relation"))
    hits = df.select(
        row_id, F.col(outcome).alias("src"), F.col(target).alias("dst"), F.lit(None).cast("string").alias("relation")
    )
    both = says.unionByName(hits).filter("src is not null and dst is not null")
    return both.groupBy("src", "dst").agg(F.max_by("relation", F.struct(row_id, "relation")).alias("relation"))


def node_degrees(edges: DataFrame) -> DataFrame:
    """Edges per node, in and out, and whether the node has the most of them."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    degrees = ends.groupBy("node").agg(F.count("*").alias("degree"))
    most = degrees.agg(F.max("degree")).first()[0]
    return degrees.withColumn("is_hub", F.col("degree") == F.lit(most))
