"""Exact top-k retrieval over sparse texts and dense vectors.

The queries travel to the tasks that hold the documents, in blocks of a bounded
number of postings; each task scores its own documents and gives back at most k
hits per query. The corpus is never shuffled and no pair that cannot win leaves a
task. Sparse scores are summed over the postings that a query and a document share,
so neither terms nor pairs without a common term cost anything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from foreglass.functions import text as X
from foreglass.operators.features import term_statistics
from foreglass.scale import broadcast_if_small, scratch_path, small_slices, top_k, written_once

BLOCK_POSTINGS = 2_000_000  # query terms, or vector elements, that a task holds at a time
AT_ONCE = 1 << 21  # products, or scores, summed at a time


def best_hits(rows: pa.Array, query: np.ndarray, score: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The best ``k`` hits of every query, ties by row id; queries are numbers."""
    place = np.asarray(pc.rank(rows, sort_keys="ascending", tiebreaker="first")).astype(np.int64)
    order = np.lexsort((place, -score, query))
    rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
    order = order[rank < k]
    return rows.take(pa.array(order)), query[order], score[order]


class _Hits:
    """Best k hits per query seen so far in one task, as three growing arrays."""

    def __init__(self, k: int, queries: pa.Array) -> None:
        self.k, self.queries, self.held, self.size = k, queries, [], 0

    def add(self, rows: pa.Array, scores: np.ndarray, queries: np.ndarray, least: float | None = 0.0) -> None:
        """Scores (rounded; one line for each of ``queries``) of a batch's rows; only those above ``least`` count."""
        if scores.shape[1] > self.k:
            keep = scores >= np.partition(scores, -self.k, axis=1)[:, -self.k, None]
        else:
            keep = np.ones(scores.shape, bool)
        if least is not None:
            keep &= scores > least
        query, row = np.nonzero(keep)
        if len(query):
            self.held.append((rows.take(pa.array(row)), queries[query], scores[query, row]))
            self.size += len(query)
        if self.size > 200_000:
            self.held, self.size = [self.best()], 0

    def best(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        rows, query, score = zip(*self.held)
        return best_hits(pa.concat_arrays(rows), np.concatenate(query), np.concatenate(score), self.k)

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            rows, query, score = self.best()
            yield pa.RecordBatch.from_arrays([self.queries.take(pa.array(query)), rows, pa.array(score)], names=["query_id", "row_id", "score"])


def _hit_shape(queries: DataFrame, corpus: DataFrame) -> T.StructType:
    kinds = (queries.schema["query_id"].dataType, corpus.schema["row_id"].dataType, T.DoubleType())
    return T.StructType([T.StructField(n, t) for n, t in zip(("query_id", "row_id", "score"), kinds)])


def _ranked(
    queries: DataFrame, size, score: Callable[[DataFrame], DataFrame], shape: T.StructType, name: str, k: int, block: int
) -> DataFrame:
    """Score the queries in blocks of about ``block`` of ``size`` and merge what the tasks found."""
    kept = written_once(queries.withColumn("_size", size.cast("bigint")), "queries")
    total = kept.agg(F.sum("_size")).first()[0] or 0
    blocks = max(1, -(-total // block))
    part = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    if blocks == 1:
        found = score(kept.drop("_size"))
    else:
        path = scratch_path(queries.sparkSession, name)
        for i in range(blocks):
            score(kept.filter(part == i).drop("_size")).write.mode("append").parquet(path)
        found = queries.sparkSession.read.schema(shape).parquet(path)
    return top_k(found, ["query_id"], [F.desc("score"), "row_id"], k)


# ---- sparse ----------------------------------------------------------------


def _score_sparse(corpus: DataFrame, postings: pa.Table, terms: pa.Table, weigh, k: int, shape: T.StructType) -> DataFrame:
    """``corpus (row_id, terms)`` x ``postings (query_id, term, weight)``.

    ``terms (term, ...)`` are the terms a document weight needs; ``weigh`` turns
    counts into weights. A batch's postings are sorted by term once; a query then sums
    the runs of its own terms.
    """
    if postings.num_rows == 0 or terms.num_rows == 0:
        return corpus.sparkSession.createDataFrame([], shape)
    names = terms.column("term").combine_chunks()
    at = pc.index_in(postings.column("term").combine_chunks(), value_set=names)
    known = pc.is_valid(at).to_numpy(zero_copy_only=False)
    ids = pc.unique(postings.column("query_id").combine_chunks())
    which = pc.index_in(postings.column("query_id").combine_chunks(), value_set=ids).to_numpy(zero_copy_only=False)[known]
    order = np.argsort(which, kind="stable")
    asked = at.to_numpy(zero_copy_only=False)[known].astype(np.int64)[order]
    weights = postings.column("weight").to_numpy()[known][order]
    edges = np.searchsorted(which[order], np.arange(len(ids) + 1))
    shared = corpus.sparkSession.sparkContext.broadcast((names, asked, weights, edges, ids))

    def scan(batches):
        names, asked, weights, edges, ids = shared.value
        wanted = np.zeros(len(names) + 1, bool)
        wanted[asked] = True
        hits = _Hits(k, ids)
        for batch in small_slices(batches, "terms", AT_ONCE // 2):
            lists, rows = batch.column("terms"), batch.column("row_id")
            flat = lists.flatten()
            sizes = pc.list_value_length(lists).fill_null(0).to_numpy()
            doc = np.repeat(np.arange(len(rows)), sizes)
            n = flat.field("n").to_numpy(zero_copy_only=False).astype(float)
            index = pc.index_in(flat.field("term"), value_set=names).fill_null(-1).to_numpy()
            length = np.bincount(doc, n, minlength=len(rows))
            keep = index >= 0
            doc, index, n = doc[keep], index[keep], n[keep]
            weight = weigh(n, index, doc, length)
            own = wanted[index]
            by_term = np.argsort(index[own], kind="stable")
            doc, index, weight = doc[own][by_term], index[own][by_term], weight[own][by_term]
            first, last = np.searchsorted(index, asked), np.searchsorted(index, asked, "right")
            counts = last - first
            so_far = np.r_[0, np.cumsum(counts)][edges]
            lo = 0
            while lo < len(ids):  # as many queries at a time as fit
                hi = min(int(np.searchsorted(so_far, so_far[lo] + AT_ONCE, "right")) - 1, lo + AT_ONCE // len(rows))
                hi = min(max(hi, lo + 1), len(ids))
                mine = slice(edges[lo], edges[hi])
                line = np.repeat(np.arange(hi - lo), np.diff(edges[lo : hi + 1]))
                many = counts[mine]
                place = np.arange(many.sum()) + np.repeat(first[mine] - np.r_[0, np.cumsum(many)[:-1]], many)
                key = np.repeat(line, many) * len(rows) + doc[place]
                scores = np.bincount(key, weight[place] * np.repeat(weights[mine], many), minlength=(hi - lo) * len(rows))
                hits.add(rows, np.round(scores, 6).reshape(hi - lo, -1), np.arange(lo, hi))
                lo = hi
        yield from hits.batches()

    return corpus.select("row_id", "terms").mapInArrow(scan, shape)


def tfidf_top_k(
    corpus: DataFrame, queries: DataFrame, vocabulary: DataFrame, k: int, block_postings: int = BLOCK_POSTINGS
) -> DataFrame:
    """Best documents per query by TF-IDF cosine: ``(query_id, rank, row_id, score)``.

    ``corpus (row_id, terms)`` and ``queries (query_id, terms)`` hold term
    counts; the fitted vocabulary has at most ``max_features`` rows, which go to the
    tasks with the queries. Ids may be of any type.
    """
    from foreglass.operators.features import tfidf_weights

    terms = vocabulary.select("term", "idf").toArrow()
    idf = terms.column("idf").to_numpy()
    shape = _hit_shape(queries, corpus)

    def weigh(n, index, doc, length):
        raw = n * idf[index]
        size = np.sqrt(np.bincount(doc, raw * raw, minlength=len(length)))
        return raw / size[doc]

    def score(block):
        return _score_sparse(corpus, tfidf_weights(block, "query_id", vocabulary).toArrow(), terms, weigh, k, shape)

    return _ranked(queries, F.size("terms"), score, shape, "tfidf-hits", k, block_postings)


def bm25_top_k(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    k1: float = 1.5,
    b: float = 0.75,
    epsilon: float = 0.25,
    block_postings: int = BLOCK_POSTINGS,
) -> DataFrame:
    """Best documents per query by Okapi BM25; a negative idf becomes epsilon x mean idf."""
    words = F.aggregate("terms", F.lit(0).cast("bigint"), lambda total, t: total + t["n"])
    size = corpus.agg(F.count("*").alias("n"), F.avg(words).alias("length")).first()
    raw = F.ln(F.lit(size["n"]) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
    statistics = written_once(term_statistics(corpus).select("term", raw.alias("raw")), "term-statistics")
    floor = epsilon * (statistics.agg(F.avg("raw")).first()[0] or 0.0)
    average = size["length"] or 1.0
    shape = _hit_shape(queries, corpus)

    def score(block):
        rows = X.explode_terms(block, ["query_id"]).withColumnRenamed("n", "weight")
        postings = rows.withColumn("weight", F.col("weight").cast("double")).toArrow()
        known = statistics.join(broadcast_if_small(rows.select("term").distinct()), "term", "left_semi")
        terms = known.select("term", F.when(F.col("raw") < 0, F.lit(floor)).otherwise(F.col("raw")).alias("idf")).toArrow()
        idf = terms.column("idf").to_numpy()

        def weigh(n, index, doc, length):
            return idf[index] * n * (k1 + 1) / (n + k1 * (1 - b + b * length[doc] / average))

        return _score_sparse(corpus, postings, terms, weigh, k, shape)

    return _ranked(queries, F.size("terms"), score, shape, "bm25-hits", k, block_postings)


# ---- dense -----------------------------------------------------------------


def vector_top_k(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str = "cosine",
    key: str | None = None,
    block_elements: int = BLOCK_POSTINGS,
) -> DataFrame:
    """Nearest vectors per query: ``(query_id, rank, row_id, score)``.

    ``corpus (row_id, vector[, key])``, ``queries (query_id, vector[, key])``.
    With ``cosine`` the score is the similarity; with ``l2`` it is the squared
    distance and smaller is nearer. With ``key`` only rows whose key equals the
    query's are scored, as for a metadata condition. Missing vectors, and vectors with
    missing elements, are nobody's neighbours.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError(f"unknown metric {metric}")
    columns = ["vector", *([key] if key else [])]
    whole = F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())
    corpus, queries = corpus.filter(whole), queries.filter(whole)
    shape = _hit_shape(queries, corpus)

    def score(block):
        rows = block.select("query_id", *columns).toArrow()
        if rows.num_rows == 0:
            return corpus.sparkSession.createDataFrame([], shape)
        asked = rows.column("query_id")
        matrix = _matrix(rows.column("vector").combine_chunks())
        keys = np.array(rows.column(key).to_pylist(), dtype=object) if key else None
        shared = corpus.sparkSession.sparkContext.broadcast(
            (asked.combine_chunks(), _unit(matrix) if metric == "cosine" else matrix, keys)
        )

        def scan(batches):
            asked, matrix, keys = shared.value
            hits = _Hits(k, asked)
            for batch in batches:
                if not batch.num_rows:
                    continue
                vectors = _matrix(batch.column("vector"))
                if metric == "cosine":
                    vectors = _unit(vectors)
                own = np.array(batch.column(key).to_pylist(), dtype=object) if key else None
                groups = set(own) & set(keys) if key else [None]
                for value in groups:
                    here = np.flatnonzero(own == value) if key else np.arange(batch.num_rows)
                    there = np.flatnonzero(keys == value) if key else np.arange(len(asked))
                    rows = batch.column("row_id").take(pa.array(here))
                    for part in np.array_split(there, -(-len(there) * len(here) // AT_ONCE)):
                        scores = matrix[part] @ vectors[here].T
                        if metric == "l2":
                            scores = 2 * scores - (vectors[here] ** 2).sum(1) - (matrix[part] ** 2).sum(1)[:, None]
                        hits.add(rows, np.round(scores, 6), part, None)
            yield from hits.batches()

        return corpus.select("row_id", *columns).mapInArrow(scan, shape)

    found = _ranked(queries, F.size("vector"), score, shape, "vector-hits", k, block_elements)
    return found.withColumn("score", F.round(-F.col("score") + 0.0, 6)) if metric == "l2" else found


def _matrix(lists) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def _unit(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; a zero row stays zero."""
    size = np.sqrt((matrix**2).sum(axis=1, keepdims=True))
    return np.divide(matrix, size, out=np.zeros_like(matrix), where=size > 0)


def diversified(
    corpus: DataFrame, queries: DataFrame, k: int, fetch_k: int | None = None, relevance: float = 0.5
) -> DataFrame:
    """Maximal marginal relevance: of the ``fetch_k`` nearest, pick k that differ.

    Each pick maximises relevance x similarity to the query minus the rest times
    the highest similarity to a vector already picked (ties: better rank). A
    group holds ``fetch_k`` rows and the query.
    """
    fetch_k = fetch_k or k
    near = vector_top_k(corpus, queries, fetch_k).select("query_id", "row_id", "rank", "score")
    members = corpus.select("row_id", "vector").join(broadcast_if_small(near), "row_id")

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank", ignore_index=True)
        unit = _unit(np.array(frame["vector"].tolist(), dtype=float))
        alike = unit @ unit.T
        to_query = frame["score"].to_numpy()
        chosen, left = [], list(range(len(frame)))
        while left and len(chosen) < k:
            gain = [
                relevance * to_query[i] - (1 - relevance) * (alike[i, chosen].max() if chosen else 0.0) for i in left
            ]
            chosen.append(left.pop(int(np.argmax(np.round(gain, 9)))))
        picked = frame.loc[chosen, ["query_id", "row_id", "score"]]
        return picked.assign(rank=np.arange(1, len(picked) + 1))

    shape = T.StructType([*_hit_shape(queries, corpus).fields, T.StructField("rank", T.IntegerType())])
    return members.groupBy("query_id").applyInPandas(pick, shape)


def joined_hits(*lists: DataFrame) -> DataFrame:
    """Hits of several retrievers, each document once per query with its best score."""
    rows = [hits.select("query_id", "row_id", "score") for hits in lists]
    stacked = rows[0]
    for more in rows[1:]:
        stacked = stacked.unionByName(more)
    return stacked.groupBy("query_id", "row_id").agg(F.max("score").alias("score"))


def fused_ranks(*lists: DataFrame, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion: sum of 1 / (constant + rank) over the lists."""
    rows = [hits.select("query_id", "row_id", "rank") for hits in lists]
    stacked = rows[0]
    for more in rows[1:]:
        stacked = stacked.unionByName(more)
    part = 1 / (F.lit(float(constant)) + F.col("rank"))
    return stacked.groupBy("query_id", "row_id").agg(F.sum(part).alias("score"))
