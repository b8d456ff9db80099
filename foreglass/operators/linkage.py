"""Record linkage by shared keys and string similarity.

A block (all records that share a key) may hold much of the table, so its pairs
are never all listed. To group records, each is linked to the first of its block,
which connects what the full pair list would connect; to compare them, each meets
its neighbours in the block's order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from foreglass.scale import broadcast_if_small, cut_lineage, look_back


def block_links(df: DataFrame, record: str, keys: list[str]) -> DataFrame:
    """``(key_name, key, anchor, record)``: each record and the first one of its block.

    Missing keys link nothing.
    """
    members = key_members(df, record, keys)
    anchors = members.groupBy("key_name", "key").agg(F.min(record).alias("anchor"))
    return members.join(anchors, ["key_name", "key"]).filter(F.col("anchor") < F.col(record))


def key_members(df: DataFrame, record: str, keys: list[str]) -> DataFrame:
    """Long ``(record, key_name, key)`` of the present keys."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(k).alias("key_name"), F.col(k).cast("string").alias("key")) for k in keys])
    )
    return df.select(record, pairs.alias("_p")).select(record, "_p.*").filter("key is not null")


def neighbour_pairs(df: DataFrame, record: str, keys: list[str], order: list[str], window: int) -> DataFrame:
    """``(keys, anchor, record)``: each record with the ``window`` records before it in its block.

    A block is what agrees on all ``keys``; within it records stand in the given order,
    which brings likely matches side by side. All pairs of a block of up to ``window + 1``
    records are listed; a larger block costs ``window`` pairs a record and is shared
    between tasks. Records without one of the keys are in no block. Where every similar pair
    is wanted, use ``similar.similar_strings`` or ``similar.similar_records``.
    """
    present = df.dropna(subset=keys).select(record, *dict.fromkeys([*keys, *order]))
    columns = {f"_before_{i}": (record, i) for i in range(1, window + 1)}
    looked = look_back(present, keys, [*order, record], columns)
    before = F.explode(F.array_compact(F.array(*columns)))
    return looked.select(*keys, before.alias("anchor"), record)


def block_pair_counts(df: DataFrame, record: str, keys: list[str]) -> DataFrame:
    """How many pairs each block would have, without listing them."""
    sizes = key_members(df, record, keys).groupBy("key_name", "key").agg(F.count("*").alias("n"))
    return sizes.withColumn("pairs", (F.col("n") * (F.col("n") - 1) / 2).cast("bigint"))


def linked_values(links: DataFrame, df: DataFrame, record: str, columns: list[str]) -> DataFrame:
    """The compared columns of both ends of each link, as ``<column>_a`` and ``<column>_b``."""
    a = df.select(F.col(record).alias("anchor"), *[F.col(c).alias(f"{c}_a") for c in columns])
    b = df.select(record, *[F.col(c).alias(f"{c}_b") for c in columns])
    # many links share an anchor: join the anchors first when they are small
    used = broadcast_if_small(a.join(links.select("anchor").distinct(), "anchor", "left_semi"))
    return links.join(b, record).join(used, "anchor")


def name_distances(pairs: DataFrame, column: str) -> DataFrame:
    """Edit distance of names and of their phonetic codes."""
    a, b = F.col(f"{column}_a"), F.col(f"{column}_b")
    return pairs.withColumns(
        {
            "name_distance": F.levenshtein(a, b),
            "phonetic_a": F.soundex(a),
            "phonetic_b": F.soundex(b),
            "phonetic_distance": F.levenshtein(F.soundex(a), F.soundex(b)),
        }
    )


def _codes(words: list[str], width: int, pad: int) -> np.ndarray:
    """Code points of words, one row each, filled up with ``pad``."""
    out = np.full((len(words), width), pad, np.int32)
    for i, word in enumerate(words):
        out[i, : len(word)] = [ord(c) for c in word]
    return out


def jaro_winkler_scores(left: list[str], right: list[str]) -> np.ndarray:
    """Similarities in [0, 1] of many pairs at once; the common prefix (up to 4) counts extra above 0.7.

    Characters are matched place by place for all pairs together.
    """
    size_a, size_b = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    wide_a, wide_b = int(size_a.max(initial=0)), int(size_b.max(initial=0))
    a, b = _codes(left, wide_a, -1), _codes(right, wide_b, -2)
    reach = np.maximum(np.maximum(size_a, size_b) // 2 - 1, 0)
    hit_a, hit_b = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    furthest = int(reach.max(initial=0))
    for i in range(wide_a):
        for j in range(max(0, i - furthest), min(wide_b, i + furthest + 1)):
            found = (a[:, i] == b[:, j]) & ~hit_a[:, i] & ~hit_b[:, j] & (abs(i - j) <= reach)
            hit_a[found, i] = hit_b[found, j] = True
    m = hit_a.sum(axis=1)
    width = min(wide_a, wide_b)
    in_order = lambda codes, hits: np.take_along_axis(codes, np.argsort(~hits, axis=1, kind="stable"), axis=1)[:, :width]
    matched = np.arange(width) < m[:, None]
    moved = ((in_order(a, hit_a) != in_order(b, hit_b)) & matched).sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(m > 0, (m / size_a + m / size_b + (m - moved) / m) / 3, 0.0)
    head = min(4, wide_a, wide_b)
    prefix = np.cumprod(a[:, :head] == b[:, :head], axis=1).sum(axis=1) if head else np.zeros(len(left))
    score = np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro)
    return np.where([x == y for x, y in zip(left, right)], 1.0, score)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity; each distinct pair of a batch is compared once."""
    pairs = pd.DataFrame({"a": a, "b": b})
    known = pairs.dropna().drop_duplicates()
    if not len(known):
        return pd.Series([None] * len(pairs), dtype="float64")
    known = known.assign(score=jaro_winkler_scores(known["a"].tolist(), known["b"].tolist()))
    return pairs.merge(known, on=["a", "b"], how="left")["score"].astype("float64")


def string_similarity(a: str, b: str) -> Column:
    return jaro_winkler(F.col(a), F.col(b))


def connected_groups(members: DataFrame, record: str, key: str) -> DataFrame:
    """``(record, group)``: records connected through shared keys; group is the smallest record.

    Keys and records pass their smallest known label to each other; following
    the label's own label halves long chains each round. Every round is written
    to the shared folder, and it ends when no label changes any more.
    """
    edges = cut_lineage(members.select(record, key).distinct())
    labels = cut_lineage(edges.select(record).distinct().withColumn("group", F.col(record)))
    while True:
        by_key = edges.join(labels, record).groupBy(key).agg(F.min("group").alias("group"))
        lowest = edges.join(by_key, key).groupBy(record).agg(F.min("group").alias("group"))
        onward = lowest.select(F.col(record).alias("_at"), F.col("group").alias("_onward"))
        jumped = lowest.join(onward, F.col("group") == F.col("_at")).select(
            record, F.least("group", "_onward").alias("group")
        )
        moved = cut_lineage(jumped)
        before = labels.select(record, F.col("group").alias("_before"))
        if moved.join(before, record).filter("group <> _before").isEmpty():
            return moved
        labels = moved
