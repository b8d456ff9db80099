"""Exact nearest vectors from cells around centres.

Every vector is placed in the cell of its nearest centre and keeps its distance to it.
By the triangle inequality a vector at distance ``r`` of a centre is at least ``|d - r|``
away from a query at distance ``d`` of that centre. A query looks into the cells of its
nearest centres first; its k-th hit there is a bound with which whole cells, and rings
inside cells, are left out. The result is the one of comparing everything.

Centres are fitted on a bounded sample, since they decide only how much can be left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from foreglass.operators.retrieve import BLOCK_POSTINGS, _hit_shape, _Hits, _matrix, _ranked, _unit
from foreglass.scale import top_k, written_once

RING_ROWS = 256  # vectors that are left out or scored together
MAX_PUSHED = 1000  # values of a filter that are worth handing to the scan
ROUNDING = 1e-6  # scores are rounded to six digits, so this much lower may still tie


@dataclass
class VectorIndex:
    """``rows (row_id, vector, cell, distance[, key])`` sorted by key, cell and distance; radii of the cells."""

    rows: DataFrame
    centres: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    size: int
    metric: str
    key: str | None


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector can have neighbours: of the right length, each element a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def _distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    squares = (left**2).sum(1)[:, None] + (right**2).sum(1) - 2 * (left @ right.T)
    return np.sqrt(np.maximum(squares, 0))


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's rounds on a sample; a centre that loses all its vectors stays where it is."""
    sample = sample[np.lexsort(sample.T)]  # the order that the sample came in must not matter
    centres = sample[np.random.RandomState(7).permutation(len(sample))[:cells]].copy()
    for _ in range(rounds):
        nearest = np.concatenate([_distances(part, centres).argmin(1) for part in np.array_split(sample, -(-len(sample) // 4096))])
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def build_index(
    corpus: DataFrame, metric: str = "cosine", key: str | None = None, most_cells: int = 2048, sample_rows: int = 20_000
) -> VectorIndex:
    """Place every vector of ``corpus (row_id, vector[, key])``; ``metric`` is ``cosine`` or ``l2``.

    There are as many cells as the square root of the rows, at most ``most_cells``; at most
    ``sample_rows`` vectors, by a hash of their ids, fit the centres. Missing vectors, those
    with missing or infinite elements, and those of another length than most are left out.
    Rows are split by key, cell and distance, so neither a frequent key nor a full cell ends
    in one task. With ``cosine`` vectors are placed at length 1, and a zero vector at zero.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError(f"unknown metric {metric}")
    columns = ["row_id", "vector", *([key] if key else [])]
    corpus = corpus.select("row_id", F.col("vector").cast("array<double>").alias("vector"), *columns[2:])
    dims = corpus.filter("vector is not null").agg(F.mode(F.size("vector"))).first()[0] or 1
    corpus = corpus.filter(usable(F.col("vector"), dims))
    n = corpus.count()
    share = int(min(1.0, sample_rows / max(n, 1)) * (1 << 30))
    chosen = F.pmod(F.xxhash64("row_id"), F.lit(1 << 30)) < share
    drawn = corpus.filter(chosen).select("vector").limit(2 * sample_rows).toArrow()
    sample = _matrix(drawn.column("vector").combine_chunks()) if drawn.num_rows else np.zeros((1, dims))
    if metric == "cosine":
        sample = _unit(sample)
    centres = fit_centres(sample, max(1, min(math.isqrt(n), most_cells)))
    shared = corpus.sparkSession.sparkContext.broadcast(centres)

    def place(batches):
        centres = shared.value
        for batch in batches:
            cells, distances = [np.zeros(0, np.int32)], [np.zeros(0)]
            for lo in range(0, batch.num_rows, 4096):
                vectors = _matrix(batch.column("vector").slice(lo, 4096))
                away = _distances(_unit(vectors) if metric == "cosine" else vectors, centres)
                cells.append(away.argmin(1).astype(np.int32))
                distances.append(away.min(1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(cells)), pa.array(np.concatenate(distances))],
                names=[*batch.schema.names, "_cell", "_distance"],
            )

    shape = T.StructType([*corpus.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_distance", T.DoubleType())])
    order = [*columns[2:], "_cell", "_distance"]
    placed = corpus.mapInArrow(place, shape).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written_once(placed, "vector-index")
    radii = rows.groupBy("_cell").agg(F.min("_distance").alias("lo"), F.max("_distance").alias("hi")).toArrow().to_pydict()
    inner, outer = np.full(len(centres), np.inf), np.full(len(centres), -np.inf)  # an empty cell is never near
    inner[radii["_cell"]], outer[radii["_cell"]] = radii["lo"], radii["hi"]
    return VectorIndex(rows, centres, inner, outer, n, metric, key)


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int = 2, count_reads: bool = False) -> DataFrame:
    """Nearest vectors of ``queries (query_id, vector[, key])``: ``(query_id, rank, row_id, score)``.

    Scores and ties are those of ``retrieve.vector_top_k``: similarity for ``cosine``, squared
    distance for ``l2``, equal ones by row id. Every query is given once. With a key only rows of
    the query's key count (a null one has none); the keys of a block of queries are a filter
    on the scan. A query that finds fewer than ``k`` hits in its ``probes`` nearest cells looks
    into all others. ``count_reads`` gives ``(query_id, scored, rows)`` instead: how many
    vectors each query was compared with, of how many.
    """
    key = index.key
    dims = index.centres.shape[1]
    given = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"), *([key] if key else []))
    given = given.filter(usable(F.col("vector"), dims))
    if key:
        given = given.filter(F.col(key).isNotNull())
    shape = _hit_shape(given, index.rows)
    counted = T.StructType([shape["query_id"], T.StructField("scored", T.LongType())])

    def score(block: DataFrame) -> DataFrame:
        asked = block.toArrow()
        if not asked.num_rows:
            return block.sparkSession.createDataFrame([], counted if count_reads else shape)
        ids = asked.column("query_id").combine_chunks()
        matrix = _matrix(asked.column("vector").combine_chunks())
        if index.metric == "cosine":
            matrix = _unit(matrix)
        keys = asked.column(key).combine_chunks() if key else None
        away = _distances(matrix, index.centres)
        slack = 1e-6 * (1 + np.sqrt((matrix**2).sum(1)) + np.sqrt((index.centres**2).sum(1)).max())
        some = np.isfinite(index.outer)
        first = np.zeros(away.shape, bool)
        near = np.where(some, away, np.inf).argsort(1, kind="stable")[:, :probes]
        np.put_along_axis(first, near, True, axis=1)
        first &= some
        reach = np.full(len(ids), np.inf)
        begun = written_once(top_k(_scan(index, ids, matrix, keys, away, first, reach, slack, k, shape), ["query_id"], [F.desc("score"), "row_id"], k), "near-hits")
        worst = begun.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).filter(F.col("n") >= k).toArrow()
        at = pc.index_in(worst.column("query_id").combine_chunks(), value_set=ids).to_numpy(zero_copy_only=False).astype(np.int64)
        least = worst.column("score").to_numpy() - ROUNDING
        # the distance at which a vector still has that score
        reach[at] = np.sqrt(np.maximum(0, 2 - 2 * least if index.metric == "cosine" else -least))
        margin = (reach + slack)[:, None] + 1e-6 * np.where(some, index.outer, 0)
        rest = some & ~first & (away - index.outer <= margin) & (index.inner - away <= margin)
        if count_reads:
            whole = np.full(len(ids), np.inf)
            parts = [(first, whole), (rest, reach)]
            one, two = (_scan(index, ids, matrix, keys, away, need, r, slack, k, counted) for need, r in parts)
            return one.unionByName(two)
        return begun.select(*shape.names).unionByName(_scan(index, ids, matrix, keys, away, rest, reach, slack, k, shape))

    size = F.lit(max(dims, len(index.centres)))
    if count_reads:
        reads = score(given).groupBy("query_id").agg(F.sum("scored").alias("scored"))
        return reads.withColumn("rows", F.lit(index.size).cast("long"))
    found = _ranked(given, size, score, shape, "vector-index-hits", k, BLOCK_POSTINGS)
    return found.withColumn("score", F.round(-F.col("score") + 0.0, 6)) if index.metric == "l2" else found


def _scan(index: VectorIndex, ids, matrix, keys, away, need, reach, slack, k: int, shape: T.StructType) -> DataFrame:
    """Hits of the queries in the cells that they ``need``, in rings that meet their ``reach``."""
    metric, key = index.metric, index.key
    rows = index.rows
    cells = np.flatnonzero(need.any(0))
    if len(cells) <= MAX_PUSHED:
        rows = rows.filter(F.col("_cell").isin(cells.tolist()))
    if key:
        values = pc.unique(keys).to_pylist()
        if len(values) <= MAX_PUSHED:
            rows = rows.filter(F.col(key).isin(values))
    counting = "scored" in shape.names
    wanted = {int(c): np.flatnonzero(need[:, c]) for c in cells}
    shared = rows.sparkSession.sparkContext.broadcast((ids, matrix, keys, away, wanted, reach, slack))

    def scan(batches):
        ids, matrix, keys, away, wanted, reach, slack = shared.value
        hits, scored = _Hits(k, ids), np.zeros(len(ids), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, distance = batch.column("_cell").to_numpy(), batch.column("_distance").to_numpy()
            new = np.r_[True, cell[1:] != cell[:-1]]
            if key:
                own = pc.index_in(batch.column(key), value_set=pc.unique(keys)).fill_null(-1).to_numpy(zero_copy_only=False)
                theirs = pc.index_in(keys, value_set=pc.unique(keys)).to_numpy(zero_copy_only=False)
                new |= np.r_[True, own[1:] != own[:-1]]
            starts = np.flatnonzero(new)
            for a, b in zip(starts, np.r_[starts[1:], len(cell)]):
                queries = wanted.get(int(cell[a]), np.zeros(0, np.int64))
                if key:
                    queries = queries[theirs[queries] == own[a]]
                if not len(queries):
                    continue
                to_centre = away[queries, cell[a]]
                for lo in range(a, b, RING_ROWS):
                    hi = min(lo + RING_ROWS, b)
                    low, high = distance[lo:hi].min(), distance[lo:hi].max()
                    margin = reach[queries] + slack[queries] + 1e-6 * high
                    near = queries[(to_centre - high <= margin) & (low - to_centre <= margin)]
                    if not len(near):
                        continue
                    scored[near] += hi - lo
                    if counting:
                        continue
                    vectors = _matrix(batch.column("vector").slice(lo, hi - lo))
                    if metric == "cosine":
                        vectors = _unit(vectors)
                    scores = matrix[near] @ vectors.T
                    if metric == "l2":
                        scores = 2 * scores - (vectors**2).sum(1) - (matrix[near] ** 2).sum(1)[:, None]
                    hits.add(batch.column("row_id").slice(lo, hi - lo), np.round(scores, 6), near, None)
        if counting:
            yield pa.RecordBatch.from_arrays([ids, pa.array(scored)], names=["query_id", "scored"])
        else:
            yield from hits.batches()

    return rows.mapInArrow(scan, shape)
