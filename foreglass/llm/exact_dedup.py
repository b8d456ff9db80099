"""Exact duplicates by distributed most-significant-digit radix partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from foreglass.scale import written_once

BLANKS = " \t\n\x0b\x0c\r"


def without_blanks(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    head: int = 32,
    width: int = 512,
    growth: int = 16,
    widest: int = 1 << 20,
) -> DataFrame:
    """Groups of texts that are equal when blanks are left out.

    A radix pass splits every group by the next bytes of its texts. Length and the
    first ``head`` bytes come first, which ends most texts as singletons on narrow
    rows. What is left goes through passes over ``width`` bytes, then ``growth``
    times as many, up to ``widest``, until groups are singletons or at their texts'
    end. Bytes are compared as they are; no digest decides equality. Every pass
    counts with partial aggregates, so copies meet as one row per task, and writes
    the surviving keys, so that joining them back can split a hot key.

    Returns ``id, keep_id, group_size, kept, text_sha256, row_uid``: in each group
    the text with the most code points stays, then the smallest id (null ids last),
    then the first row. Null texts are empty texts. Rows repeated as they are form
    one group of which one row stays. Other columns are ignored.
    """
    plain = without_blanks(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("points"),
        plain.cast("binary").alias("body"),
    ).withColumns({"n": F.octet_length("body").cast("long"), "head": F.substring("body", 1, head)})
    shared = rows.groupBy("n", "head").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("n", "head", F.lit(True).alias("shared"))
    shared = written_once(shared, "radix-heads")  # read back, the join can split a hot key
    slim = rows.withColumn("sha", F.unhex(F.sha2("body", 256)))
    joined = slim.join(shared.hint("shuffle_hash"), ["n", "head"], "left")
    table = written_once(
        joined.select(
            F.monotonically_increasing_id().alias("uid"), "id", "points", "sha", "n", F.when(F.col("shared"), F.col("body")).alias("body")
        ),
        "radix",
    )

    state = table.filter("body is not null").select("uid", F.col("n").alias("label"), "n", "body")
    ended, at = [], 0
    while True:
        keyed = state.withColumn("block", F.substring("body", 1, width))
        groups = keyed.groupBy("label", "block").agg(F.min("uid").alias("next"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
        groups = written_once(groups, "radix-groups")
        more = F.col("n") > at + width
        state = written_once(
            keyed.join(groups, ["label", "block"]).select(
                "uid", F.col("next").alias("label"), "n", F.when(more, F.expr(f"substring(body, {width + 1})")).alias("body")
            ),
            "radix-pass",
        )
        ended.append(state.filter("body is null").select("uid", "label"))
        state = state.filter("body is not null")
        if state.isEmpty():
            break
        at, width = at + width, min(width * growth, widest)

    member = reduce(DataFrame.unionAll, ended)
    slim = table.select("uid", "id", "points", "sha")
    copies = slim.join(member, "uid")
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("z"), "id", "uid"))
    kept = written_once(copies.groupBy("label").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")), "radix-kept")
    out = [F.col("id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"), F.col("uid").alias("row_uid")]
    in_groups = copies.join(kept, "label").withColumns({"keep_id": F.col("best.id"), "kept": F.col("uid") == F.col("best.uid")})
    alone = slim.join(member, "uid", "left_anti").withColumns(
        {"keep_id": F.col("id"), "kept": F.lit(True), "group_size": F.lit(1).cast("long")}
    )
    return in_groups.select(*out).unionAll(alone.select(*out))
