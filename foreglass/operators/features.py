"""Sparse and pooled text features in long form; nothing is ever densified."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from foreglass.functions import text as X
from foreglass.scale import BROADCAST_BYTES, broadcast_if_small, cut_lineage, looked_up, small_slices, value_bytes, written_once


def counted_terms(df: DataFrame, doc_id: str, tokens: Column) -> DataFrame:
    """``(doc_id, terms)`` with the term counts of each text, made inside its row."""
    return X.with_term_counts(df.select(doc_id, tokens.alias("_tokens")), F.col("_tokens")).drop("_tokens")


def word_counts(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Batches with the list ``terms`` of ``counted_terms`` in place of a text, for words between whitespace.

    For work in tasks that goes on with the counts, so that Spark need not list all words of a text.
    """
    for batch in small_slices(batches, text):
        words = pc.ascii_split_whitespace(batch.column(text))
        sizes = pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = words.flatten()
        real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # around blanks at the ends of a text
        doc = np.repeat(np.arange(len(words)), sizes)[real]
        coded = flat.filter(pa.array(real)).dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary)
        place = np.empty(len(order), np.int64)
        place[np.asarray(order)] = np.arange(len(order))
        held, n = np.unique(doc * len(order) + place[np.asarray(coded.indices)], return_counts=True)
        doc, term = np.divmod(held, max(len(order), 1))
        entries = pa.StructArray.from_arrays([coded.dictionary.take(order).take(pa.array(term)), pa.array(n.astype(np.int64))], names=["term", "n"])
        terms = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)), pa.int32()), entries)
        columns = {name: batch.column(name) for name in batch.schema.names if name != text}
        yield pa.RecordBatch.from_arrays([*columns.values(), terms], names=[*columns, "terms"])


def term_index(df: DataFrame, doc_id: str, tokens: Column) -> DataFrame:
    """The counted terms as a written table, for work that reads them several times."""
    return written_once(counted_terms(df, doc_id, tokens), "terms")


def term_statistics(counted: DataFrame) -> DataFrame:
    """Occurrences ``cf`` and documents ``df`` per term; partial counts before the shuffle."""
    rows = X.explode_terms(counted, [])
    return rows.groupBy("term").agg(F.sum("n").alias("cf"), F.count("*").alias("df"))


def fit_vocabulary(counted: DataFrame, n_documents: int, max_features: int) -> DataFrame:
    """The ``max_features`` most frequent terms (ties by term) with their smoothed idf."""
    kept = term_statistics(counted).orderBy(F.desc("cf"), "term").limit(max_features)
    idf = F.ln((1 + F.lit(n_documents)) / (1 + F.col("df"))) + 1
    return cut_lineage(kept.withColumn("idf", idf))


def tfidf_weights(counted: DataFrame, doc_id: str, vocabulary: DataFrame) -> DataFrame:
    """L2-normalised ``(doc_id, term, weight)``.

    The vocabulary has at most ``max_features`` rows and goes to every task; terms are
    looked up and weights normalised where the text's row is, without a shuffle.
    """
    terms = vocabulary.select("term", "idf").toArrow()
    names, idf = terms.column("term").combine_chunks(), terms.column("idf").to_numpy()
    shared = counted.sparkSession.sparkContext.broadcast((names, idf))
    shape = T.StructType(
        [T.StructField(doc_id, counted.schema[doc_id].dataType), T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())]
    )

    def weigh(batches):
        names, idf = shared.value
        for batch in small_slices(batches, "terms"):
            lists = batch.column("terms")
            sizes = pc.list_value_length(lists).fill_null(0).to_numpy()
            doc = np.repeat(np.arange(len(lists)), sizes)
            flat = lists.flatten()
            index = pc.index_in(flat.field("term"), value_set=names).fill_null(-1).to_numpy()
            keep = index >= 0
            doc, index = doc[keep], index[keep]
            raw = flat.field("n").to_numpy(zero_copy_only=False).astype(float)[keep] * idf[index]
            norm = np.sqrt(np.bincount(doc, raw * raw, minlength=len(lists)))
            columns = [batch.column(doc_id).take(pa.array(doc)), names.take(pa.array(index)), pa.array(raw / norm[doc])]
            yield pa.RecordBatch.from_arrays(columns, names=[doc_id, "term", "weight"])

    return counted.select(doc_id, "terms").mapInArrow(weigh, shape)


def collection_tfidf(counted: DataFrame, doc_id: str, n_documents: int) -> DataFrame:
    """tf/length x ln(N / (cf + 1)) where ``cf`` counts all occurrences of a term."""
    length = F.aggregate("terms", F.lit(0).cast("bigint"), lambda total, t: total + t["n"])
    rows = X.explode_terms(counted.withColumn("_length", length), [doc_id, "_length"])
    idf = term_statistics(counted).select("term", F.ln(F.lit(n_documents) / (F.col("cf") + 1)).alias("idf"))
    return rows.join(broadcast_if_small(idf), "term").select(
        doc_id, "term", (F.col("n") / F.col("_length") * F.col("idf")).alias("weight")
    )


def keyword_score(tokens: Column, query: Iterable[str], boosts: Mapping[str, float]) -> Column:
    """tf/length x (idf - boost) x boost, summed over the query terms.

    The idf is 0 for a term the text holds and ln(10^6) otherwise; terms without
    a boost have factor 1 and no deduction. Computed inside the row.
    """
    length = F.size(tokens)
    score = F.lit(0.0)
    for term in query:
        score = score + _keyword_part(tokens, length, term, boosts)
    return F.when(length > 0, score).otherwise(F.lit(0.0))


def _keyword_part(tokens: Column, length: Column, term: str, boosts: Mapping[str, float]) -> Column:
    count = F.size(F.filter(tokens, lambda t: t == F.lit(term)))
    idf = F.when(count > 0, F.lit(0.0)).otherwise(F.ln(F.lit(1e6))) - F.lit(float(boosts.get(term, 0.0)))
    return count / length * idf * F.lit(float(boosts.get(term, 1.0)))


def pooled_vectors(
    counted: DataFrame, doc_id: str, word_vectors: DataFrame, size: int, skip: Iterable[str] = ()
) -> DataFrame:
    """Mean word vector per text; unknown and skipped words do not count.

    A text without any known word gets the zero vector. Given vectors of few bytes go to
    the tasks; of more, each chunk of texts gets those of its own words. Vectors are
    never joined to the words of single texts.
    """
    given = written_once(word_vectors.select(F.col("word").alias("term"), "vector").filter("vector is not null"), "word-vectors")
    skipped = pa.array(list(skip), pa.string())
    rows = counted.select(doc_id, "terms")
    ddl = f"`{doc_id}` {rows.schema[doc_id].dataType.simpleString()}, vector array<double>"

    def pooled(batches, names, matrix):
        for batch in small_slices(batches, "terms", 1 << 16):
            lists = batch.column("terms")
            sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(lists)), sizes)
            flat = lists.flatten()
            term = flat.field("term")
            index = pc.index_in(term, value_set=names).fill_null(-1).to_numpy(zero_copy_only=False)
            keep = (index >= 0) & ~pc.is_in(term, value_set=skipped).to_numpy(zero_copy_only=False)
            doc, index, n = doc[keep], index[keep], flat.field("n").to_numpy(zero_copy_only=False).astype(float)[keep]
            mean = np.zeros((len(lists), size))
            if len(doc):
                begin = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                mean[doc[begin]] = np.add.reduceat(matrix[index] * n[:, None], begin) / np.add.reduceat(n, begin)[:, None]
            ends = pa.array(np.arange(len(lists) + 1) * size, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(doc_id), pa.ListArray.from_arrays(ends, pa.array(mean.ravel()))], names=[doc_id, "vector"])

    def read(table):
        flat = table.column("vector").combine_chunks().flatten()
        return pa.array(table.column("term").to_pylist(), pa.string()), flat.to_numpy(zero_copy_only=False).astype(float).reshape(table.num_rows, size)

    if value_bytes(given) <= BROADCAST_BYTES:
        shared = counted.sparkSession.sparkContext.broadcast(read(given.toArrow()))
        return rows.mapInArrow(lambda batches: pooled(batches, *shared.value), ddl)

    def chunk(texts: pa.Table, found: pa.Table) -> pa.Table:
        return pa.Table.from_batches(pooled(texts.select([doc_id, "terms"]).to_batches(), *read(found)))

    return looked_up(rows, "terms", "term", given, chunk, ddl)


def build_documents(df: DataFrame, text: str) -> DataFrame:
    """``(id, text, metadata)``: all other columns as a string map, id from the content."""
    rest = [c for c in df.columns if c != text]
    pairs = [x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]
    metadata = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    identity = F.sha2(F.to_json(F.struct(F.col(text), *rest)), 256)
    return df.select(identity.alias("id"), F.col(text).alias("text"), metadata.alias("metadata"))


def merge_features(left: DataFrame, right: DataFrame, row_id: str, columns: list[str], name: str = "features"):
    """Feature columns of two tables side by side in one ML vector."""
    from pyspark.ml.feature import VectorAssembler

    joined = left.join(right, row_id)
    return VectorAssembler(inputCols=columns, outputCol=name).transform(joined)
