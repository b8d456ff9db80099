"""Work that depends on the order of rows inside a series, user, file or text.

A series may hold a large share of all rows, so nothing here orders a whole
series in one task: see ``foreglass.scale`` for the building blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from foreglass.scale import look_back, positions, running_total, small_slices, top_k, written_once

LOOK = 0.01  # part of the texts that decides on the layout of pair counts
PAIRS_AT_ONCE = 1 << 19  # occurrences of a partition


def previous_value(
    df: DataFrame, keys: list[str], order: list[str], column: str, start: str | None = None, name: str = "previous"
) -> DataFrame:
    """Value of the row before, per key; the first row gets the start mark."""
    looked = look_back(df, keys, order, {name: (column, 1)})
    if start is not None:
        first = F.col("_position") == 1
        looked = looked.withColumn(name, F.when(first, F.lit(start)).otherwise(F.col(name)))
    return looked.drop("_position")


def word_pairs(words: DataFrame, keys: list[str], array: str) -> DataFrame:
    """Neighbouring pairs of a word array column, taken inside the row."""
    w = F.col(array)
    pairs = F.zip_with(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))),
        F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))),
        lambda a, b: F.struct(a.alias("word_1"), b.alias("word_2")),
    )
    return words.select(*keys, F.posexplode(pairs).alias("pos", "pair")).select(*keys, "pos", "pair.*")


def with_pair_counts(words: DataFrame, keys: list[str], array: str) -> DataFrame:
    """Every pair occurrence of a word array column with the count of its pair in the whole table.

    Occurrences are shuffled once, to partitions of about ``PAIRS_AT_ONCE`` of them, and counted
    where they meet; a hash sorts them, so words are compared only inside a pair. A hundredth of
    the texts tells how many partitions that takes and which pairs would fill a task. Such pairs
    are counted beforehand and their occurrences spread. That part decides on the layout only:
    every occurrence is counted.
    """
    pair = ["word_1", "word_2"]
    cores = words.sparkSession.sparkContext.defaultParallelism
    look = written_once(words.select(*keys, array).sample(LOOK, 0), "look")
    total = (look.agg(F.sum(F.greatest(F.size(array) - 1, F.lit(0)))).first()[0] or 0) / LOOK
    seen = word_pairs(look, keys, array).groupBy(*pair).agg(F.count("*").alias("_seen"))
    hot = seen.filter(F.col("_seen") / LOOK > max(PAIRS_AT_ONCE, total / (4 * cores))).select(*pair)
    pairs = word_pairs(words, keys, array)
    place, count = F.xxhash64(*pair), F.count("*").over(Window.partitionBy("_place", *pair))
    hot = written_once(hot, "hot-pairs")  # at most four for each core
    if not hot.isEmpty():
        known = pairs.join(F.broadcast(hot), pair).groupBy(*pair).agg(F.count("*").alias("_known"))
        pairs = pairs.join(F.broadcast(written_once(known, "hot-counts")), pair, "left")
        place = F.when(F.col("_known").isNull(), place).otherwise(F.xxhash64(*pair, *keys, "pos"))
        count = F.coalesce("_known", count)
    placed = pairs.repartition(max(cores, math.ceil(total / PAIRS_AT_ONCE)), place).withColumn("_place", place)
    return placed.withColumn("n_pair", count).select(*pair, *keys, "pos", "n_pair")


def pair_probabilities(pairs: DataFrame) -> DataFrame:
    """Pair counts and the chance of the second word after the first.

    Row totals are summed from the pair counts, not from the occurrences.
    """
    counted = pairs.groupBy("word_1", "word_2").agg(F.count("*").alias("n_pair"))
    totals = counted.groupBy("word_1").agg(F.sum("n_pair").alias("_total"))
    joined = counted.join(totals, "word_1")
    return joined.select("word_1", "word_2", "n_pair", (F.col("n_pair") / F.col("_total")).alias("p"))


def numbered_labels(
    tokens: DataFrame, label: str, order: list[str], per: list[str] | None = None
) -> DataFrame:
    """``NOUN_1, NOUN_2, ...``: running number of each label, per document or over all.

    Per document the window stays inside one text. Over the whole table a label may
    be on a third of all tokens: tokens are numbered inside their document (the first
    order column), and only the counts per label and document are summed in order.
    """
    if per:
        window = Window.partitionBy(*per, label).orderBy(*order)
        numbered = tokens.withColumn("_n", F.row_number().over(window))
    else:
        document, *rest = order
        if not rest:
            numbered = positions(tokens, [label], order, "_n")
        else:
            inside = F.row_number().over(Window.partitionBy(document, label).orderBy(*rest))
            counts = tokens.select(F.struct(document, label).alias("_place"), document, label)
            counts = counts.groupBy("_place", document, label).agg(F.count("*").alias("_count"))
            before = running_total(counts, [label], [document], F.col("_count"), "_to_here")
            before = before.select("_place", (F.col("_to_here") - F.col("_count")).alias("_before"))
            numbered = tokens.withColumn("_inside", inside).withColumn("_place", F.struct(document, label))
            numbered = numbered.join(before, "_place").withColumn("_n", F.col("_before") + F.col("_inside"))
            numbered = numbered.drop("_place", "_inside", "_before")
    return numbered.withColumn("unique_label", F.concat_ws("_", label, "_n")).drop("_n")


def numbered_labels_of_arrays(df: DataFrame, document: str, labels: str) -> DataFrame:
    """``document, pos, unique_label`` as ``numbered_labels`` over all, for a row a document with its labels as an array.

    Only two bytes a label, the number of its kind among those of the row, go to where the counts of
    earlier documents are; tokens are made there, in the row. A missing label is a kind whose name is left out.
    """
    kind = df.schema[document].dataType
    name = f"`{document}`"

    def encode(batches):
        for batch in small_slices(batches, labels):
            lists = batch.column(labels)
            sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            coded = lists.flatten().dictionary_encode()
            codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            kinds, counts, places, ends = [], [], [], np.cumsum(sizes)
            for lo, hi in zip(ends - sizes, ends):
                here, place, n = np.unique(codes[lo:hi], return_inverse=True, return_counts=True)
                kinds.append(coded.dictionary.take(pa.array(here, mask=here < 0)).to_pylist())
                counts.append(n.tolist())
                places.append(place.astype(np.uint16 if len(here) <= 1 << 16 else np.uint32).tobytes())
            columns = [batch.column(document), pa.array(kinds, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64())), pa.array(places, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["_doc", "_kinds", "_counts", "_places"])

    rows = df.select(document, F.col(labels).cast("array<string>").alias(labels))
    ddl = f"_doc {kind.simpleString()}, _kinds array<string>, _counts array<bigint>, _places binary"
    coded = written_once(rows.mapInArrow(encode, ddl), "coded")  # else words would be taken again for the join
    each = coded.select("_doc", F.explode(F.arrays_zip(F.col("_kinds").alias("k"), F.col("_counts").alias("c"))).alias("_e"))
    counts = each.select("_doc", F.col("_e.k").alias("_kind"), F.col("_e.c").alias("_count"))
    before = running_total(counts, ["_kind"], ["_doc"], F.col("_count"), "_to_here")
    pair = F.struct(F.col("_kind").alias("k"), (F.col("_to_here") - F.col("_count")).alias("b"))
    lists = before.groupBy(F.struct("_doc").alias("_place")).agg(F.collect_list(pair).alias("_before"))
    joined = coded.withColumn("_place", F.struct("_doc")).join(lists, "_place").select("_doc", "_kinds", "_places", "_before")

    def decode(batches):
        for batch in (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows)):
            kinds = batch.column("_kinds")[0].as_py()
            raw = batch.column("_places")[0].as_py()
            place = np.frombuffer(raw, np.uint16 if len(kinds) <= 1 << 16 else np.uint32).astype(np.int64)
            earlier = {e["k"]: e["b"] for e in batch.column("_before")[0].as_py()}
            order = np.argsort(place, kind="stable")
            held = place[order]
            number = np.empty(len(place), np.int64)
            number[order] = np.arange(len(place)) - np.searchsorted(held, held) + 1
            number += np.array([earlier[k] for k in kinds], np.int64)[place]
            told = pc.binary_join_element_wise(pa.array(kinds, pa.string()).take(pa.array(place)), pa.array(number).cast(pa.string()), "_", null_handling="skip")
            same = pa.repeat(batch.column("_doc")[0], len(place))
            yield pa.RecordBatch.from_arrays([same, pa.array(np.arange(len(place), dtype=np.int32)), told], names=[document, "pos", "unique_label"])

    return joined.mapInArrow(decode, f"{name} {kind.simpleString()}, pos int, unique_label string")


def wide_labels(documents: DataFrame, tokens: DataFrame, doc_id: str, labels: list[str], value: str) -> DataFrame:
    """One column per listed unique label; documents without any label stay in."""
    wide = (
        tokens.filter(F.col("unique_label").isin(*labels))
        .groupBy(doc_id)
        .pivot("unique_label", labels)
        .agg(F.first(value))
    )
    return documents.select(doc_id).join(wide, doc_id, "left")


def wide_labels_of_arrays(df: DataFrame, doc_id: str, words: str, labels: str, wanted: list[str]) -> DataFrame:
    """As ``wide_labels``, for rows that hold a document's words and labels as arrays: nothing is shuffled.

    ``LONG_2`` is the second word labelled ``LONG``, null if there is none.
    """
    both = F.arrays_zip(F.col(words).alias("w"), F.col(labels).alias("l"))

    def word_of(name: str) -> Column:
        label, _, number = name.rpartition("_")
        of_label = F.filter(both, lambda t: t["l"] == F.lit(label))
        return F.get(of_label, F.lit(int(number) - 1))["w"].alias(name)

    return df.select(doc_id, *[word_of(name) for name in wanted])


def marker_rows_to_ids(lines: DataFrame, file: str, line: str, is_blank: Column, partitions: int | None = None):
    """Sentence number from blank marker rows, per file; marker rows are dropped.

    The running count of markers is taken per range of lines, so one huge file is
    shared between tasks. A last sentence without marker stays; lines of a NULL file
    are a file, and a NULL line number comes first.
    """
    marked = lines.withColumn("_blank", F.coalesce(is_blank, F.lit(False)).cast("int"))
    counted = running_total(marked, [file], [line], F.col("_blank"), "sentence_no", partitions)
    return counted.filter("_blank = 0").drop("_blank")


def look_back_windows(df: DataFrame, keys: list[str], order: list[str], value: str, depth: int = 3) -> DataFrame:
    """Previous ``depth`` values as array ``x`` and the current one as ``y``.

    Rows with fewer values before them are left out.
    """
    columns = {f"_x{i}": (value, i) for i in range(depth, 0, -1)}
    looked = look_back(df, keys, order, columns).filter(F.col("_position") > depth)
    return looked.select(*keys, *order, F.array(*columns).alias("x"), F.col(value).alias("y"))


def tail_split(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Mark the last ``n`` rows of each series as test rows.

    Only the first test row of each series is looked up; all rows are then
    compared with it, so no series is ever sorted as a whole. A NULL series is one.
    """
    slim = df.select(F.struct(*keys).alias("_series"), F.struct(*order).alias("_at"))
    last = top_k(slim, ["_series"], [F.desc("_at")], n, "_rank")
    start = last.groupBy("_series").agg(F.min("_at").alias("_start"))
    joined = df.withColumn("_series", F.struct(*keys)).join(start, "_series", "left")
    return joined.withColumn("is_test", F.struct(*order) >= F.col("_start")).drop("_start", "_series")


def first_per_group(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    return top_k(df, [group], order, n, "_rank").drop("_rank")


def rebuilt_sentences(snippets: DataFrame, key: str, order: list[str], text: str) -> DataFrame:
    """Sentences of snippets joined by blanks in time order and split at full stops.

    Same result as joining the whole transcript and splitting it, but a long
    transcript is never held in one cell: each snippet is split on its own, a
    running count of full stops numbers the sentences, and only the pieces of
    one sentence meet. Empty pieces are kept.
    """
    pieces = F.split(F.col(text), r"\.")
    stops = running_total(
        snippets.select(key, *order, text), [key], order, F.size(pieces).cast("bigint") - 1, "_stops"
    )
    before = F.col("_stops") - (F.size(pieces) - 1)
    spread = stops.select(key, *order, before.alias("_before"), F.posexplode(pieces).alias("_i", "_piece"))
    parts = F.sort_array(F.collect_list(F.struct(*order, F.col("_piece"))))
    return (
        spread.groupBy(key, (F.col("_before") + F.col("_i")).cast("bigint").alias("sentence_no"))
        .agg(parts.alias("_parts"))
        .select(key, "sentence_no", F.array_join(F.col("_parts").getField("_piece"), " ").alias("sentence"))
    )


def transition_counts(df: DataFrame, keys: list[str], order: list[str], state: str, start: str = "<s>") -> DataFrame:
    """Counts of neighbouring states and the probability of the step.

    A step's probability is its count over the count of its first state as a
    first state, starts included.
    """
    steps = previous_value(df, keys, order, state, start, "from_state")
    counted = steps.groupBy("from_state", F.col(state).alias("to_state")).agg(F.count("*").alias("n"))
    totals = counted.groupBy("from_state").agg(F.sum("n").alias("_total"))
    return counted.join(totals, "from_state").select(
        "from_state", "to_state", "n", (F.col("n") / F.col("_total")).alias("p")
    )


def chain_log_probability(
    df: DataFrame, keys: list[str], order: list[str], state: str, transitions: DataFrame, start: str = "<s>"
) -> DataFrame:
    """Log probability of every sequence under a Markov chain, start step included.

    A step the chain does not know makes the sequence impossible: ``possible`` is
    false and the probability 0.
    """
    steps = previous_value(df, keys, order, state, start, "from_state").withColumnRenamed(state, "to_state")
    known = steps.join(transitions.select("from_state", "to_state", "p"), ["from_state", "to_state"], "left")
    return known.groupBy(*keys).agg(
        F.count("*").alias("steps"),
        F.bool_and(F.coalesce(F.col("p") > 0, F.lit(False))).alias("possible"),
        F.sum(F.ln("p")).alias("log_p"),
    )
