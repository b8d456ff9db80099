"""Mixing sources to target weights, with columns and SQL functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window

from foreglass.scale import written_once

KEY_BITS = 60
WORD_GAP = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words between blanks; null has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[int] = (5, 2, 1), most_epochs: int = 3) -> DataFrame:
    """Words to take from every source; ``sources`` has one row ``source, words``.

    Sources in code point order, null last, get the weights in turn and share all
    words by weight. No target is above ``most_epochs`` times the source; what is cut
    off goes to the others by weight until none is above. That end point is reached
    directly: by rising room per weight, a source is full if its share of what fuller
    sources leave is above its room. The windows run over one row per source.
    """
    numbered = sources.withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.col("number") - 1) % len(weights) + 1).cast("int"))
    room = numbered.withColumns({"weight": weight, "room": F.col("words") * most_epochs})
    everything = Window.partitionBy()
    by_room = Window.orderBy((F.col("room") / F.col("weight")).asc(), "number")
    earlier = by_room.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    shares = room.withColumns({"all_words": F.sum("words").over(everything), "all_weight": F.sum("weight").over(everything)}).withColumns(
        {
            "left_words": F.col("all_words") - F.coalesce(F.sum("room").over(earlier), zero),
            "left_weight": F.col("all_weight") - F.coalesce(F.sum("weight").over(earlier), zero),
        }
    )
    full = (F.col("left_words") * F.col("weight")).cast("double") > (F.col("room") * F.col("left_weight")).cast("double")
    marked = shares.withColumn("full", full).withColumn(
        "full", F.min("full").over(by_room.rowsBetween(Window.unboundedPreceding, 0))
    )
    used = marked.withColumns(
        {
            "full_words": F.sum(F.when(F.col("full"), F.col("room")).otherwise(zero)).over(everything),
            "full_weight": F.sum(F.when(F.col("full"), F.col("weight")).otherwise(zero)).over(everything),
        }
    )
    share = ((F.col("all_words") - F.col("full_words")) * F.col("weight")).cast("double") / (
        F.col("all_weight") - F.col("full_weight")
    ).cast("double")
    return used.select("source", "words", F.when(F.col("full"), F.col("room").cast("double")).otherwise(share).alias("target"))


def mix_sources(
    docs: DataFrame,
    seed: int = 1,
    weights: Sequence[int] = (5, 2, 1),
    most_epochs: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Words that a mix takes from each document, so that every source meets its target exactly.

    Each row gets a hash-random key. A source's target, in whole words, is so many full
    epochs and a rest; in key order, the rest takes whole documents until it ends inside
    one, which gives only the words up to the cut. Prefix sums run per (source, key
    range), offset by the sums of earlier ranges; there are about as many ranges as rows
    in one, and keys are even, so a hot source is spread like any other.

    Returns ``id, source, size, source_size, target, taken, copies``: ``copies`` is how
    often a mix of whole documents holds the row (the cut document counts if at least
    half of it is taken). Null text has no words; rows of null source are a source; null
    ids share one key. Rows repeated as they are count one by one. Reruns agree. Columns
    of ``carry`` come along, so that rows can be told apart where ids cannot.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = written_once(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(F.col(text_col)).alias("size"),
            digest.alias("digest"),
            F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long").alias("key"),
            *carry,
        ),
        "mix-sizes",
    )
    sizes = written_once(rows.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")), "mix-sources")
    targets = written_once(source_targets(sizes.select("source", "words"), weights, most_epochs), "mix-targets")
    n = sizes.agg(F.sum("rows")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(math.isqrt(n) + 1)))
    cut = rows.withColumn("part", F.shiftright("key", KEY_BITS - bits))
    sums = cut.groupBy("source", "part").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(
        F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("earlier")
    )
    inside = Window.partitionBy("source", "part").orderBy("digest", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = cut.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    placed = placed.join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    goal = targets.select(F.col("source").alias("t"), F.col("words").alias("source_size"), "target")
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.coalesce(F.floor(budget / F.col("source_size")), F.lit(0))
    return (
        placed.join(goal, F.col("source").eqNullSafe(F.col("t")))
        .withColumn("epochs", F.when(F.col("source_size") > 0, epochs).otherwise(0))
        .withColumn("rest", budget - F.col("epochs") * F.col("source_size") - F.col("earlier") - F.col("inside"))
        .withColumn("part_taken", F.greatest(F.lit(0).cast("long"), F.least("rest", "size")))
        .select(
            "id",
            "source",
            "size",
            "source_size",
            "target",
            (F.col("epochs") * F.col("size") + F.col("part_taken")).cast("long").alias("taken"),
            (F.col("epochs") + ((F.col("size") > 0) & (2 * F.col("part_taken") >= F.col("size"))).cast("int")).cast("int").alias("copies"),
            *carry,
        )
    )
