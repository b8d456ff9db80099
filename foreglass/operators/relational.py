"""Projections, filters, column binds and set operations."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from foreglass.functions.text import keyword_match
from foreglass.functions.vectors import dot
from foreglass.scale import broadcast_if_small, positions, rows_within, stable_hash, top_k


def drop_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.drop(*columns)


def drop_columns_like(df: DataFrame, pattern: str) -> DataFrame:
    """Drop columns whose name matches the pattern from its start."""
    return df.drop(*[c for c in df.columns if re.match(pattern, c)])


def select_and_rename(df: DataFrame, columns: Iterable[str], names: Mapping[str, str] | None = None) -> DataFrame:
    return df.select(*columns).withColumnsRenamed(dict(names or {}))


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def equals(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(F.col(column) == F.lit(value))


def differs(df: DataFrame, column: str, value) -> DataFrame:
    """Rows whose value is another one or missing."""
    return df.filter(~F.col(column).eqNullSafe(F.lit(value)))


def columns_differ(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(~F.col(a).eqNullSafe(F.col(b)))


def named_dataset(df: DataFrame, name: str, author_column: str = "author_type") -> DataFrame:
    """``all`` rows, only ``generated`` (author type 0) or only ``human`` (1)."""
    wanted = {"all": None, "generated": 0, "human": 1}
    if name not in wanted:
        raise ValueError(f"unknown dataset {name}")
    if wanted[name] is None:
        return df
    require_columns(df, [author_column])
    return df.filter(F.col(author_column) == wanted[name])


def keep_missing(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def label_to_int(df: DataFrame, label: str, target: str = "PREDICTION", name: str = "int_label") -> DataFrame:
    """1 where the label is the target, 0 otherwise (missing labels included)."""
    return df.withColumn(name, F.col(label).eqNullSafe(F.lit(target)).cast("int"))


def corrected_entity_label(label, text) -> Column:
    """Rules that move entity labels to the type their text shows."""
    label, text = F.col(label), F.col(text)
    quarter = r"^(?:Q\d of \d{4}|Quarter \d|\d Q\d)"
    day = r"^\d{1,2} [a-zA-Z]+ \d{4}"
    degrees = r"^-?\d+°[CF]"
    return (
        F.when((label == "LOC") | label.startswith("LOC_"), F.lit("GPE"))
        .when(label == "FAC", F.lit("PERSON"))
        .when((label == "WORK_OF_ART") & text.rlike(quarter), F.lit("DATE"))
        .when((label == "WORK_OF_ART") & text.isin("Weather Underground", "The Weather Channel"), F.lit("ORG"))
        .when((label == "CARDINAL") & text.rlike(day), F.lit("DATE"))
        .when((label == "CARDINAL") & text.rlike(degrees), F.lit("TEMPERATURE"))
        .otherwise(label)
    )


def presence_flags(df: DataFrame, columns: Iterable[str], total: str = "n_present") -> DataFrame:
    """1 where a value is present, else 0, and how many of them there are."""
    columns = list(columns)
    flags = df.withColumns({c: F.col(c).isNotNull().cast("int") for c in columns})
    count = F.lit(0)
    for c in columns:
        count = count + F.col(c)
    return flags.withColumn(total, count)


def ordinal_code(column: str, levels: Mapping[str, int]) -> Column:
    """Number of an ordered level; unknown levels give NULL."""
    code = F.lit(None).cast("int")
    for level, number in levels.items():
        code = F.when(F.col(column) == level, F.lit(number)).otherwise(code)
    return code


def blank_or_other(column: str, other: str = "O") -> Column:
    return F.when(F.col(column) == " ", F.lit(" ")).otherwise(F.lit(other))


def first_rows(df: DataFrame, order: list, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def row_range(df: DataFrame, order: list[str], start: int, stop: int) -> DataFrame:
    """Rows ``start`` (0-based) up to but without ``stop`` of the ordered table.

    Spark keeps ``stop`` rows per task and merges them; the offset is cut last.
    """
    return df.orderBy(*order).offset(start).limit(stop - start)


def last_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def keyword_posts(
    df: DataFrame, text: str, all_of, where: Column | None = None, order: list | None = None, limit: int | None = None
) -> DataFrame:
    """Posts matching every keyword group; plain predicates in ``where`` reach the scan."""
    found = df.filter(where) if where is not None else df
    found = found.filter(keyword_match(text, all_of))
    if order:
        found = found.orderBy(*order)
    return found.limit(limit) if limit else found


def bind_columns(left: DataFrame, right: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Side-by-side bind by row identity; rows of either side are kept."""
    return left.join(right, row_id, "full")


def attach(df: DataFrame, extra: DataFrame, columns: Iterable[str], row_id: str = "row_id") -> DataFrame:
    """Add columns by row identity; rows without a partner show NULLs."""
    return df.join(extra.select(row_id, *columns), row_id, "left")


def attach_model_outputs(df: DataFrame, outputs: DataFrame, models: list[str], row_id: str = "row_id") -> DataFrame:
    """Long model output ``(row_id, model, prediction)`` as one column per model."""
    wide = outputs.groupBy(row_id).pivot("model", models).agg(F.first("prediction"))
    return df.join(wide.withColumnsRenamed({m: f"{m} Prediction" for m in models}), row_id, "left")


def natural_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on all shared columns; missing keys match missing keys."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("the tables share no column")
    other = right.select(*[F.col(c).alias(f"_r_{c}" if c in shared else c) for c in right.columns])
    on = F.lit(True)
    for c in shared:
        on = on & left[c].eqNullSafe(other[f"_r_{c}"])
    return left.join(other, on).drop(*[f"_r_{c}" for c in shared])


def slot_pairs(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    per_left: int,
    heads: int | None = None,
    key: str | None = None,
) -> DataFrame:
    """Pair rows with the first ``per_left`` rows of the other side.

    With ``heads`` only the first rows of the left side take part (as in a
    3 x 33 trial grid); with ``key`` both sides must agree on an attribute.
    Every left row asks for slots 1..per_left and the slots are an equi join, so
    neither a cross join nor all pairs of a group are ever formed.
    """
    slots = F.explode(F.sequence(F.lit(1), F.lit(per_left))).alias("slot")
    if key is None:
        chosen = right.orderBy(right_id).limit(per_left)
        ranked = top_k(chosen.withColumn("_all", F.lit(0)), ["_all"], [right_id], per_left, "slot").drop("_all")
        asking = (left.orderBy(left_id).limit(heads) if heads else left).select("*", slots)
        return asking.join(broadcast_if_small(ranked), "slot")
    ranked = top_k(right, [key], [right_id], per_left, "slot")
    asking = (top_k(left, [key], [left_id], heads, "_n").drop("_n") if heads else left).select("*", slots)
    return asking.join(broadcast_if_small(ranked), [key, "slot"])


def attribute_pair_means(left: DataFrame, right: DataFrame, key: str, vector: str) -> DataFrame:
    """Number of pairs per attribute value and their mean cosine, over all pairs.

    The mean over all pairs of unit vectors is the product of the two mean unit
    vectors, so no pair is formed however large a group is.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        unit = Normalizer(inputCol="_v", outputCol="_u").transform(
            df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
        )
        return unit.groupBy(key).agg(
            F.count("*").alias(f"n_{name}"), vector_to_array(Summarizer.mean(F.col("_u"))).alias(f"mean_{name}")
        )

    both = side(left, "left").join(side(right, "right"), key)
    return both.select(
        key,
        (F.col("n_left") * F.col("n_right")).alias("pairs"),
        dot("mean_left", "mean_right").alias("mean_cosine"),
    )


def alignment(left: DataFrame, right: DataFrame, columns: list[str], row_id: str = "row_id") -> DataFrame:
    """One row: do both tables hold the same values row by row?"""
    a = left.select(row_id, F.struct(*columns).alias("_a"))
    b = right.select(row_id, F.struct(*columns).alias("_b"))
    same = F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))
    return a.join(b, row_id, "full").agg(
        F.count("*").alias("rows"),
        F.sum((~same).cast("bigint")).alias("different"),
        F.bool_and(same).alias("aligned"),
    )


def not_yet_done(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the work list that have no result yet, however many rows a result has."""
    return work.join(done.select(*keys), keys, "left_anti")


def work_plan(batches: DataFrame, domains: list[str], models: list[str], template: str) -> DataFrame:
    """Batch x domain x model rows with the text to send, spread in place."""
    array_of = lambda values: F.array(*[F.lit(v) for v in values])
    return (
        batches.withColumn("domain", F.explode(array_of(domains)))
        .withColumn("model", F.explode(array_of(models)))
        .withColumn("prompt", F.format_string(template, "domain", "batch_id"))
    )


def matched_arrays(ranked: DataFrame, query: str, value: str, rank: str = "rank", name: str = "matches") -> DataFrame:
    """Ranked matches per query as one array; a top-k list bounds its length."""
    ordered = F.sort_array(F.collect_list(F.struct(rank, value)))
    return ranked.groupBy(query).agg(F.transform(ordered, lambda m: m[value]).alias(name))


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Stack tables by column name; columns a table lacks are NULL."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row per key in a given order; one candidate per key and task is shuffled."""
    return top_k(df, keys, order, 1, "_first").drop("_first")


def combine_sources(frames: Iterable[DataFrame], columns: list[str]) -> DataFrame:
    """Stack only the columns the sources have in common use."""
    return union_by_name(*[f.select(*columns) for f in frames])


def shuffled(df: DataFrame, row_id: str, seed: int = 42) -> DataFrame:
    """A repeatable shuffle: ordered by a hash of seed and row identity."""
    return df.orderBy(stable_hash(seed, row_id), row_id)


def shuffle_positions(df: DataFrame, row_id: str, seed: int = 42, name: str = "position") -> DataFrame:
    """Place of every row in the repeatable shuffle."""
    hashed = df.withColumn("_hash", stable_hash(seed, row_id))
    placed = positions(hashed, [], ["_hash", row_id], name)
    return placed.drop("_hash")


def constant_columns(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({name: F.lit(value) for name, value in values.items()})


def any_duplicates(df: DataFrame, column: str) -> DataFrame:
    """One row: rows, distinct values, and whether any value occurs twice."""
    per_value = df.groupBy(column).count()
    return per_value.agg(
        F.sum("count").alias("rows"),
        F.count("*").alias("distinct_values"),
        (F.max("count") > 1).alias("has_duplicates"),
    )


def value_list(df: DataFrame, column: str, limit: int) -> list:
    """Distinct values as a Python list; for columns with few values only."""
    return [row[0] for row in rows_within(df.select(column).distinct().orderBy(column), limit)]
