"""Exact top-k over an inverted index in blocks, which skips blocks that cannot hold a winner.

A block holds the postings of a few documents that share their heaviest terms, and each
term's highest weight in it. The bound of a query on a block is the sum of its weights
times those highs. A query first scores the blocks of its best bounds; the k-th score found
there is a floor, and of all other blocks only those whose bound reaches it are scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from foreglass.functions import text as X
from foreglass.operators.features import tfidf_weights, word_counts
from foreglass.operators.retrieve import best_hits
from foreglass.scale import broadcast_if_small, small_slices, top_k, written_once

BLOCK_ROWS = 64
BLOCKS_AT_ONCE = 64  # blocks of a Parquet row group, as Spark may read a whole one (or 4096 rows) into memory
AT_ONCE = 1 << 18  # terms that a task takes apart at a time
SLACK = 1e-6  # scores are rounded to six places
LEADERS = 2  # blocks that a query scores first


@dataclass
class Index:
    """``blocks`` is a written table with one row a block; ``n_blocks`` of them."""

    blocks: DataFrame
    n_blocks: int


def _block(ids: pa.Array, doc: np.ndarray, terms: pa.Array, weights: np.ndarray) -> list[pa.Array]:
    """Columns of one block from its postings, in order of documents: terms with highs, and documents and weights term by term."""
    coded = terms.dictionary_encode()
    code = np.asarray(coded.indices)
    order = np.argsort(code.astype(np.uint16) if len(coded.dictionary) <= 1 << 16 else code, kind="stable")  # two bytes sort by radix
    code = code[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    names = coded.dictionary.take(pa.array(code[first]))
    high = np.maximum.reduceat(weights[order], first) if len(first) else np.zeros(0)
    one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    starts = pa.array(np.r_[first, len(code)], pa.int32())
    return [one(ids), one(names), one(starts), one(pa.array(high)), one(pa.array(doc[order])), one(pa.array(weights[order]))]


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _keyed(batches: Iterator[pa.RecordBatch], value: str) -> Iterator[pa.RecordBatch]:
    """Terms and values of every row as two lists, the sum of its values, and the terms of its two highest (of equal ones, the last)."""
    for batch in small_slices(batches, "terms", AT_ONCE):
        lists = batch.column("terms")
        sizes, flat = _sizes(lists), lists.flatten()
        term, values = flat.field("term"), flat.field(value).to_numpy(zero_copy_only=False).astype(float)
        ends = np.cumsum(sizes)
        some = np.flatnonzero(sizes)
        places, left = np.full((2, len(sizes)), -1), values.copy()
        for place in places if len(some) else ():
            high = np.maximum.reduceat(left, (ends - sizes)[some])
            last = np.maximum.reduceat(np.where(left == np.repeat(high, sizes[some]), np.arange(len(left)), -1), (ends - sizes)[some])
            place[some] = np.where(high > -np.inf, last, -1)
            left[last] = -np.inf
        starts = pa.array(np.r_[0, ends], pa.int32())
        sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes), values, len(sizes))
        keys = [term.take(pa.array(place, mask=place < 0)) for place in places]
        columns = [pa.ListArray.from_arrays(starts, term), pa.ListArray.from_arrays(starts, pa.array(values)), pa.array(sums), *keys]
        yield pa.RecordBatch.from_arrays([batch.column("row_id"), *columns], names=["row_id", "names", "values", "sum", "one", "two"])


def _keyed_table(rows: DataFrame, key: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Rows that ``key`` makes as ``_keyed`` does, written, as range bounds are sampled from them."""
    kind = rows.schema["row_id"].dataType.simpleString()
    ddl = f"row_id {kind}, names array<string>, values array<double>, sum double, one string, two string"
    return written_once(rows.mapInArrow(key, ddl), "keyed")


def build(weighted: DataFrame, block_rows: int = BLOCK_ROWS) -> Index:
    """Index of ``weighted (row_id, terms array<struct<term, weight>>)``; weights are 0 or more.

    Documents are range-partitioned by their heaviest two terms, so that blocks hold
    documents that answer the same queries. Rows without terms can answer none and are
    left out.
    """
    return _packed(_keyed_table(weighted.select("row_id", "terms"), lambda batches: _keyed(batches, "weight")), block_rows)


def _packed(keyed: DataFrame, block_rows: int, weigh: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Index:
    """Blocks of keyed rows; ``weigh(values, document of each)`` makes weights of values that are none."""
    order = ["one", "two", F.xxhash64("row_id")]
    placed = keyed.filter("one is not null").repartitionByRange(*order).sortWithinPartitions(*order)
    kind = keyed.schema["row_id"].dataType.simpleString()
    place = "tinyint" if block_rows <= 128 else "int"  # of a document in its block: one byte a posting, of four
    ddl = f"rows array<{kind}>, names array<string>, starts array<int>, highs array<double>, docs array<{place}>, weights array<double>"

    def pack(batches):
        for ids, names, values in _pieces(batches, block_rows):
            doc, flat = np.repeat(np.arange(len(names)), _sizes(names)), np.asarray(values.flatten())
            weights = weigh(flat, doc) if weigh else flat
            columns = _block(ids, doc.astype(np.int8 if place == "tinyint" else np.int32), names.flatten(), weights)
            yield pa.RecordBatch.from_arrays(columns, names=["rows", "names", "starts", "highs", "docs", "weights"])

    packed = placed.select("row_id", "names", "values").mapInArrow(pack, ddl).withColumn("block", F.monotonically_increasing_id())
    blocks = written_once(packed, "blocks", **{"parquet.block.row.count.limit": str(BLOCKS_AT_ONCE)})
    return Index(blocks, blocks.count())


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, ...]]:
    """Columns of ``size`` rows at a time, across batches."""
    kept, held = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, size - held)
            kept, held, at = [*kept, part], held + part.num_rows, at + part.num_rows
            if held == size:
                yield _columns(kept)
                kept, held = [], 0
    if held:
        yield _columns(kept)


def _columns(parts: list[pa.RecordBatch]) -> tuple[pa.Array, ...]:
    return tuple(c.combine_chunks() for c in pa.Table.from_batches(parts).combine_chunks().columns)


def _postings(table: pa.Table) -> tuple:
    """Plain arrays of ``(query_id, term, weight)``: ids, terms, and by query its number, that of its term, and the weight."""
    query, term = (table.column(c).combine_chunks() for c in ("query_id", "term"))
    ids, terms = pc.unique(query), pc.unique(term)
    which = np.asarray(pc.index_in(query, value_set=ids))
    order = np.argsort(which, kind="stable")
    number = np.asarray(pc.index_in(term, value_set=terms))
    return ids, terms, which[order].astype(np.int64), number[order].astype(np.int64), table.column("weight").to_numpy()[order]


class _Asked:
    """Postings of a block of queries; made in the task, as workers cannot load objects of this package."""

    def __init__(self, ids: pa.Array, terms: pa.Array, query: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        self.ids, self.terms, self.query, self.term, self.weight = ids, terms, query, term, weight

    def places(self, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        """For each block, and each posting, the place of its term in the block, -1 if it has none."""
        names = batch.column("names")
        number = pc.index_in(names.flatten(), value_set=self.terms).fill_null(-1).to_numpy(zero_copy_only=False)
        for own in np.split(number, np.cumsum(_sizes(names))[:-1]):
            here = np.flatnonzero(own >= 0)
            place = np.full(len(self.terms), -1)
            place[own[here]] = here
            yield place[self.term]

    def bounds(self, place: np.ndarray, highs: np.ndarray) -> np.ndarray:
        """Highest score that any document of the block can have, for every query."""
        here = place >= 0
        top = np.maximum(self.weight[here], 0) * highs[place[here]]
        return np.bincount(self.query[here], top, len(self.ids))


def _lists(batch: pa.RecordBatch, row: int, *names: str) -> list:
    return [batch.column(n)[row].values for n in names]


def _scored(asked: _Asked, wanted: np.ndarray, place: np.ndarray, starts: np.ndarray, docs: np.ndarray, weights: np.ndarray, n: int):
    """Queries, documents and scores above 0 of one block, of the wanted queries."""
    use = (place >= 0) & wanted[asked.query]
    begin, count = starts[place[use]], np.diff(starts)[place[use]]
    at = np.arange(count.sum()) + np.repeat(begin - np.r_[0, np.cumsum(count)[:-1]], count)
    here = np.unique(asked.query[use])
    line = np.searchsorted(here, asked.query[use])
    key = np.repeat(line * n, count) + docs[at]
    score = np.round(np.bincount(key, weights[at] * np.repeat(asked.weight[use], count), len(here) * n), 6)
    some = np.flatnonzero(score > 0)
    return here[some // n], some % n, score[some]


def _leaders(index: Index, shared, kind: str) -> DataFrame:
    """Blocks of the best bounds of every query; reads names and highs only."""

    def bound(batches):
        asked = _Asked(*shared.value)
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for row, place in enumerate(asked.places(batch)):
                (highs,) = _lists(batch, row, "highs")
                bounds = asked.bounds(place, np.asarray(highs))
                some = np.flatnonzero(bounds > 0)
                best.append((some, np.full(len(some), batch.column("block")[row].as_py()), bounds[some]))
            if best:
                query, block, bounds = (np.concatenate(c) for c in zip(*best))
                order = np.lexsort((-bounds, query))
                rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
                order = order[rank < LEADERS]
                best = [(query[order], block[order], bounds[order])]
        if best:
            query, block, bounds = best[0]
            yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(query)), pa.array(block), pa.array(bounds)], names=["query_id", "block", "bound"])

    found = index.blocks.select("block", "names", "highs").mapInArrow(bound, f"query_id {kind}, block long, bound double")
    return top_k(found, ["query_id"], [F.desc("bound"), "block"], LEADERS)


def _scan(blocks: DataFrame, shared, floors, k: int, ddl: str, count_reads: bool) -> DataFrame:
    """Hits of every query at or above its floor, at most k a task; with ``count_reads`` the blocks scored, instead."""

    def scan(batches):
        asked, floor = _Asked(*shared.value), floors.value
        reads = np.zeros(len(asked.ids), np.int64)
        held: list[tuple] = []
        size, ids = 0, []
        for batch in batches:
            for row, place in enumerate(asked.places(batch)):
                (highs,) = _lists(batch, row, "highs")
                bounds = asked.bounds(place, np.asarray(highs))
                wanted = (bounds > 0) & (bounds >= floor - SLACK)
                reads += wanted
                if count_reads or not wanted.any():
                    continue
                rows, starts, docs, weights = _lists(batch, row, "rows", "starts", "docs", "weights")
                query, doc, score = _scored(asked, wanted, place, np.asarray(starts), np.asarray(docs), np.asarray(weights), len(rows))
                stay = score >= floor[query] - SLACK
                ids.append(rows.take(pa.array(doc[stay])))
                held.append((query[stay], score[stay]))
                size += int(stay.sum())
                if size > 200_000:
                    ids, held = _best(ids, held, k)
                    size = -len(held[0][0])
        if count_reads:
            yield pa.RecordBatch.from_arrays([asked.ids, pa.array(reads)], names=["query_id", "n"])
        elif held:
            ids, held = _best(ids, held, k)
            query, score = held[0]
            yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(query)), ids[0], pa.array(score)], names=["query_id", "row_id", "score"])

    columns = ["names", "highs"] if count_reads else ["rows", "names", "starts", "highs", "docs", "weights"]
    return blocks.select(*columns).mapInArrow(scan, ddl)


def _best(ids: list[pa.Array], held: list[tuple], k: int) -> tuple[list[pa.Array], list[tuple]]:
    """The best hits of every query so far."""
    query, score = (np.concatenate(c) for c in zip(*held))
    rows, query, score = best_hits(pa.concat_arrays(ids), query, score, k)
    return [rows], [(query, score)]


def search(index: Index, postings: DataFrame, k: int, count_reads: bool = False) -> DataFrame:
    """Best documents of every query: ``query_id, rank, row_id, score`` (above 0), ties by id.

    ``postings (query_id, term, weight)`` go to the tasks as they are, so pass queries in
    blocks of a bounded number of postings. With ``count_reads`` it returns ``query_id,
    read, blocks``: how many blocks each query had to score.
    """
    spark = postings.sparkSession
    kinds = {"query": postings.schema["query_id"].dataType.simpleString(), "row": index.blocks.schema["rows"].dataType.elementType.simpleString()}
    ddl = f"query_id {kinds['query']}, row_id {kinds['row']}, score double"
    table = postings.select("query_id", "term", "weight").toArrow()
    if not table.num_rows or not index.n_blocks:
        empty = spark.createDataFrame([], f"query_id {kinds['query']}, read long, blocks int" if count_reads else f"query_id {kinds['query']}, rank int, row_id {kinds['row']}, score double")
        return empty
    asked = _postings(table)
    ids = asked[0]
    shared = spark.sparkContext.broadcast(asked)
    none = spark.sparkContext.broadcast(np.zeros(len(ids)))
    leaders = written_once(_leaders(index, shared, kinds["query"]), "leaders")
    first = index.blocks.join(broadcast_if_small(leaders.select("block").distinct()), "block", "left_semi")
    found = top_k(_scan(first, shared, none, k, ddl, False), ["query_id"], [F.desc("score")], k)
    floors = np.zeros(len(ids))
    told = found.filter(F.col("rank") == k).select("query_id", "score").toArrow().combine_chunks()
    if told.num_rows:
        floors[np.asarray(pc.index_in(told.column("query_id").combine_chunks(), value_set=ids))] = told.column("score").to_numpy()
    floor = spark.sparkContext.broadcast(floors)
    if count_reads:
        reads = _scan(index.blocks, shared, floor, k, f"query_id {kinds['query']}, n long", True)
        return reads.groupBy("query_id").agg(F.sum("n").alias("read")).withColumn("blocks", F.lit(index.n_blocks))
    hits = _scan(index.blocks, shared, floor, k, ddl, False)
    return top_k(hits, ["query_id"], [F.desc("score"), "row_id"], k).select("query_id", "rank", "row_id", "score")


def tfidf_index(corpus: DataFrame, vocabulary: DataFrame, block_rows: int = BLOCK_ROWS) -> Index:
    """Index of unit TF-IDF weights; the fitted vocabulary is bounded and goes to the tasks."""
    weights = tfidf_weights(corpus, "row_id", vocabulary)
    lists = weights.groupBy("row_id").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))
    return build(lists, block_rows=block_rows)


def tfidf_search(index: Index, queries: DataFrame, vocabulary: DataFrame, k: int, count_reads: bool = False) -> DataFrame:
    return search(index, tfidf_weights(queries, "query_id", vocabulary), k, count_reads)


@dataclass
class Bm25:
    """Index of term saturations; a query brings the idf of its terms."""

    index: Index
    statistics: DataFrame
    floor: float


def bm25_index(corpus: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, block_rows: int = BLOCK_ROWS) -> Bm25:
    """Index for Okapi BM25 over all terms; a negative idf becomes epsilon x mean idf."""
    keyed = _keyed_table(corpus.select("row_id", "terms"), lambda batches: _keyed(batches, "n"))
    return _bm25(keyed, k1, b, epsilon, block_rows)


def bm25_text_index(texts: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, block_rows: int = BLOCK_ROWS) -> Bm25:
    """The index of the words between whitespace of ``texts (row_id, text)``, lower-cased; texts are read once."""
    lowered = texts.select("row_id", F.lower("text").alias("text"))
    keyed = _keyed_table(lowered, lambda batches: _keyed(word_counts(batches, "text"), "n"))
    return _bm25(keyed, k1, b, epsilon, block_rows)


def _bm25(keyed: DataFrame, k1: float, b: float, epsilon: float, block_rows: int) -> Bm25:
    """Weights are made as blocks are packed, and documents of a term counted in the blocks."""
    size = keyed.agg(F.count("*").alias("n"), F.avg("sum").alias("length")).first()
    average = size["length"] or 1.0

    def weigh(n, doc):
        return n * (k1 + 1) / (n + k1 * (1 - b + b * np.bincount(doc, n)[doc] / average))

    index = _packed(keyed, block_rows, weigh)
    raw = F.ln(F.lit(size["n"]) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
    statistics = written_once(_document_counts(index).select("term", raw.alias("raw")), "term-statistics")
    return Bm25(index, statistics, epsilon * (statistics.agg(F.avg("raw")).first()[0] or 0.0))


def _document_counts(index: Index) -> DataFrame:
    """Documents ``df`` per term; what a block holds of a term is its count there."""

    def count(batches):
        for batch in small_slices(batches, "names", AT_ONCE):
            names, starts = batch.column("names"), np.asarray(batch.column("starts").flatten())
            coded = names.flatten().dictionary_encode()
            held = np.delete(np.diff(starts), np.cumsum(_sizes(names) + 1)[:-1] - 1)  # not from one block to the next
            df = np.bincount(np.asarray(coded.indices), held, len(coded.dictionary)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(df)], names=["term", "df"])

    return index.blocks.select("names", "starts").mapInArrow(count, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def bm25_search(made: Bm25, queries: DataFrame, k: int, count_reads: bool = False) -> DataFrame:
    rows = X.explode_terms(queries, ["query_id"])
    idf = F.when(F.col("raw") < 0, F.lit(made.floor)).otherwise(F.col("raw"))
    postings = rows.join(made.statistics, "term").select("query_id", "term", (F.col("n") * idf).alias("weight"))
    return search(made.index, postings, k, count_reads)
