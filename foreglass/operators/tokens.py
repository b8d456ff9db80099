"""Token tables: one row per token, with sentence number and position."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from foreglass.functions import text as X
from foreglass.scale import BROADCAST_BYTES, small_slices, value_bytes, written_once


def sentences(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """One row per sentence piece: ``(row_id, sentence_no, sentence)``."""
    return df.select(row_id, F.posexplode(X.sentence_pieces(text)).alias("sentence_no", "sentence"))


def word_rows(df: DataFrame, keys: Iterable[str], text: str, lower: bool = True) -> DataFrame:
    """Whitespace words: ``(keys, pos, word)``; no shuffle."""
    return df.select(*keys, F.posexplode(X.whitespace_tokens(text, lower)).alias("pos", "word"))


def token_table(df: DataFrame, row_id: str, text: str, stop_words: Iterable[str]) -> DataFrame:
    """Tokens with shape, flags and character offsets.

    A token piece carries the white space before it, so the pieces tile the
    text and a running length gives the offsets, added up where the row is.
    """
    kind = df.schema[row_id].dataType
    listed = df.select(F.col(row_id).alias("row"), X.surface_tokens(text).alias("pieces"))
    fields = [("row", kind), ("pos", T.IntegerType()), ("piece", T.StringType()), ("end_char", T.LongType())]
    shape = T.StructType([T.StructField(name, t) for name, t in fields])
    pieces = listed.mapInArrow(_tiled, shape).withColumnRenamed("row", row_id)
    term = X.trimmed("piece")
    return pieces.select(
        row_id,
        "pos",
        term.alias("term"),
        X.token_shape(term).alias("shape"),
        term.rlike(r"^\p{L}+$").alias("is_alpha"),
        F.lower(term).isin(*stop_words).alias("stop_word"),
        (F.col("end_char") - F.length(term)).cast("int").alias("start_char"),
        F.col("end_char").cast("int").alias("end_char"),
    )


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``row, pos, piece, end_char`` of piece lists."""
    for batch in small_slices(batches, "pieces"):
        lists = batch.column("pieces")
        sizes = pc.list_value_length(lists).fill_null(0).to_numpy()
        pieces = lists.flatten()
        ends = np.cumsum(pc.utf8_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64))
        first = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(sizes)), sizes)
        before = np.concatenate([[0], ends])[first]
        columns = [batch.column("row").take(pa.array(row)), np.arange(len(row)) - first[row], pieces, ends - before[row]]
        columns = [columns[0], pa.array(columns[1], pa.int32()), pieces, pa.array(columns[3], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "pos", "piece", "end_char"])


def has_cue(words: Column, cues: Iterable[str]) -> Column:
    """1 if an array of words holds a listed one, else 0; a test inside the row."""
    return F.exists(words, lambda w: F.lower(w).isin(*cues)).cast("int")


def tag_cues(tokens: DataFrame, modal_words: Iterable[str]) -> DataFrame:
    """Coarse and fine tag from a word list: listed words get AUX / MD."""
    modal = F.lower("term").isin(*modal_words)
    return tokens.withColumn("pos_label", F.when(modal, "AUX").otherwise("X")).withColumn(
        "detailed_pos_label", F.when(modal, "MD").otherwise("X")
    )


def sentence_has_tags(tokens: DataFrame, keys: list[str], coarse: str = "AUX", fine: str = "MD") -> DataFrame:
    """1 per sentence if one token carries both tags, else 0.

    Grouped by sentence identity, never by text: equal sentences stay apart.
    """
    both = (F.col("pos_label") == coarse) & (F.col("detailed_pos_label") == fine)
    return tokens.groupBy(*keys).agg(F.bool_or(F.coalesce(both, F.lit(False))).cast("int").alias("is_future"))


def require_rows(df: DataFrame, expected: int) -> DataFrame:
    """The frame itself, after checking its row count."""
    found = df.count()
    if found != expected:
        raise ValueError(f"expected {expected} classified sentences, found {found}")
    return df


def lemmatize(df: DataFrame, row_id: str, text: str, lemmas: DataFrame, name: str = "lemmas") -> DataFrame:
    """Replace words found in a ``(form, lemma)`` table; the rest stay as they are.

    A table of few bytes goes to the tasks and words are replaced inside their rows.
    Beyond that, words meet the table by a join and are put back in order; rows must
    then differ in ``row_id``, and no text moves with the words.
    """
    table = written_once(lemmas.select(F.col("form").alias("word"), "lemma"), "lemmas")
    if value_bytes(table) <= BROADCAST_BYTES:
        return _replaced(df, text, table, name)
    words = word_rows(df, [row_id], text)
    found = words.join(table, "word", "left").select(row_id, "pos", F.coalesce("lemma", "word").alias("lemma"))
    put_back = F.sort_array(F.collect_list(F.struct("pos", "lemma")))
    joined = found.groupBy(row_id).agg(F.array_join(F.transform(put_back, lambda t: t["lemma"]), " ").alias(name))
    return df.join(joined, row_id, "left")


def _replaced(df: DataFrame, text: str, table: DataFrame, name: str) -> DataFrame:
    rows = table.toArrow()
    shared = df.sparkSession.sparkContext.broadcast((rows.column("word").combine_chunks(), rows.column("lemma").combine_chunks()))
    listed = df.withColumn(name, X.whitespace_tokens(text))
    shape = T.StructType([T.StructField(f.name, T.StringType() if f.name == name else f.dataType) for f in listed.schema])

    def replace(batches):
        forms, lemmas = shared.value
        for batch in batches:
            lists = batch.column(name)
            words = lists.flatten()
            found = lemmas.take(pc.index_in(words, value_set=forms))
            sizes = pc.list_value_length(lists).fill_null(0).to_numpy()
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            joined = pc.binary_join(pa.ListArray.from_arrays(offsets, pc.coalesce(found, words)), " ")
            joined = pc.if_else(pa.array(sizes > 0), joined, pa.scalar(None, pa.string()))
            columns = [joined if f == name else batch.column(f) for f in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return listed.mapInArrow(replace, shape)


def tokens_to_arrays(tokens: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Arrays of token columns per sentence, in token order (last sentence kept)."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", *columns)))
    grouped = tokens.groupBy(*keys).agg(ordered.alias("_all"))
    return grouped.select(*keys, *[F.col("_all").getField(c).alias(f"{c}s") for c in columns])


def sentence_arrays(sentences: DataFrame, keys: list[str], sentence: str, columns: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """Arrays ``words`` and ``columns`` of each sentence, made inside its row; sentences without words are left out.

    The same as ``tokens_to_arrays`` of the sentence's words, without taking them apart and
    putting them in order again.
    """
    words = sentences.select(*keys, X.whitespace_tokens(sentence).alias("words")).filter(F.size("words") > 0)
    return words.select(*keys, "words", *[F.transform("words", of).alias(name) for name, of in columns.items()])
