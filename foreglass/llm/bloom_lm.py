"""Language-model scores from a log-frequency Bloom filter of n-gram counts."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.ipc  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from foreglass.llm.words import Words, mix
from foreglass.scale import written_once

END = np.uint64(0x6A09E667F3BCC909)
BEGIN = np.uint64(0xBB67AE8584CAA73B)
_PAIR = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_STEP = np.uint64(0xD6E8FEB86659FD93)
UNI, BI = 0, 1
OCTAVES = 48
PROBES = 4
BITS_PER_ENTRY = 8
FLUSH_TOKENS = 2_000_000
CHUNK_BYTES = 16 << 20


def tokens(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all rows, each row closed by an end; and per row the number of its first token."""
    rows = len(first) - 1
    head = first + np.arange(rows + 1)
    out = np.full(len(hashes) + rows, END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[head[1:] - 1] = False
    out[inside] = hashes
    return out, head


def pairs(found: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's predecessor, and the hash of the two together."""
    before = np.empty_like(found)
    before[1:] = found[:-1]
    before[head[:-1]] = BEGIN
    return before, mix(before * _PAIR[0] + found * _PAIR[1])


def bucket_bits(text_bytes: int, bytes_per_bucket: int) -> int:
    """Bits of a hash that name its bucket; a bucket has the n-grams of so much text."""
    return max(6, math.ceil(math.log2(max(1, text_bytes / bytes_per_bucket))))


def _bucket_edges(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of sorted keys, named by their highest bits, and the edges of their slices."""
    tops = (keys >> np.uint64(64 - bits)).astype(np.int32)
    first = np.flatnonzero(np.r_[True, tops[1:] != tops[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return tops[first], np.append(first, len(keys))


def _slices(data: np.ndarray, edges: np.ndarray, width: int) -> pa.Array:
    """Binary cells that are consecutive slices of one buffer, ``width`` bytes for each key."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _packed(keys: np.ndarray, kind: int, bits: int, edges: np.ndarray) -> pa.Array:
    """Sorted keys, a cell for each bucket; of bigrams the 40 bits after those that name it, which tell millions apart.

    Bigrams are written as differences, byte place by byte place, so the highest ones
    compress. All buckets are packed at once, so their number costs no time.
    """
    if kind == UNI:
        return _slices(keys, edges, 8)
    low = (keys << np.uint64(bits)) >> np.uint64(24)
    steps = np.diff(low, prepend=np.uint64(0))
    steps[edges[:-1]] = low[edges[:-1]]
    sizes = np.diff(edges)
    start, size = np.repeat(edges[:-1], sizes), np.repeat(sizes, sizes)
    at = 4 * start + np.arange(len(keys))
    out = np.empty(5 * len(keys), np.uint8)
    for place, column in enumerate(steps.view(np.uint8).reshape(-1, 8)[:, :5].T):
        out[at + place * size] = column
    return _slices(out, edges, 5)


def _unpacked(data: bytes, kind: int) -> np.ndarray:
    if kind == UNI:
        return np.frombuffer(data, np.uint64)
    wide = np.zeros((len(data) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(data, np.uint8).reshape(5, -1).T
    return np.cumsum(wide.view(np.uint64).ravel(), dtype=np.uint64)


def count_runs(texts: DataFrame, bits: int) -> DataFrame:
    """Counts of unigrams and bigrams as packed runs per task and bucket: ``kind, bucket, keys, counts``."""

    def count(batches):
        words = Words()
        kept: dict[int, list[np.ndarray]] = {UNI: [], BI: []}
        size = 0

        def flush():
            for kind, parts in kept.items():
                if not parts:
                    continue
                keys, counts = np.unique(np.concatenate(parts), return_counts=True)
                parts.clear()
                buckets, edges = _bucket_edges(keys, bits)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(buckets), kind, np.int32)),
                        pa.array(buckets),
                        _packed(keys, kind, bits, edges),
                        _slices(counts.astype(np.int32), edges, 4),
                    ],
                    names=["kind", "bucket", "keys", "counts"],
                )

        for batch in batches:
            for _, _, hashes, first in words.slices(batch.column("text")):
                found, head = tokens(hashes, first)
                kept[UNI].append(found)
                kept[BI].append(pairs(found, head)[1])
                size += len(found)
                if size >= FLUSH_TOKENS:
                    yield from flush()
                    size = 0
        yield from flush()

    return texts.select("text").mapInArrow(count, "kind int, bucket int, keys binary, counts binary")


def _total(keys: list[bytes], counts: list[bytes], kind: int) -> tuple[np.ndarray, np.ndarray]:
    """One sorted run with summed counts from several."""
    k = np.concatenate([_unpacked(b, kind) for b in keys])
    c = np.concatenate([np.frombuffer(b, np.int32) for b in counts]).astype(np.int64)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[new], np.add.reduceat(c, new)


def merge_runs(runs: DataFrame) -> DataFrame:
    """One row per kind and bucket, with its sums: ``n`` tokens, ``v`` distinct, and how many per quarter octave.

    Unigrams stay a sorted run of exact counts. Bigrams become their segment of the Bloom
    filter, from count one, in ``keys``.
    """
    names = ["kind", "bucket", "keys", "counts", "n", "v", "quarters"]

    def merge(table: pa.Table) -> pa.Table:
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        keys, counts = _total(table.column("keys").to_pylist(), table.column("counts").to_pylist(), kind)
        quarters = np.bincount(np.minimum((4 * np.log2(counts)).astype(np.int64), 4 * OCTAVES - 1), minlength=4 * OCTAVES)
        held = (build_segment(keys, level(counts, 1))[0], b"") if kind == BI else (keys.tobytes(), counts.tobytes())
        row = [kind, bucket, *held, int(counts.sum()), len(keys), quarters.tolist()]
        types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=names)

    ddl = "kind int, bucket int, keys binary, counts binary, n long, v long, quarters array<long>"
    return runs.groupBy("kind", "bucket").applyInArrow(merge, ddl)


def level(counts: np.ndarray, cutoff: int) -> np.ndarray:
    """Quantised log count: 1 from the cutoff, one more at each doubling."""
    return 1 + np.floor(np.log2(counts / cutoff)).astype(np.int64)


def typical(levels: np.ndarray, cutoff: int) -> np.ndarray:
    """Middle of the counts that share a level; 0 for level 0."""
    low = cutoff * 2.0 ** (levels - 1)
    return np.where(levels > 0, (3 * low - 1) / 2, 0.0)


def _positions(keys: np.ndarray, levels: np.ndarray | int, size: np.ndarray | int, probe: int) -> np.ndarray:
    h = mix(keys + np.atleast_1d(np.asarray(levels, np.uint64)) * _STEP)
    spot = (h + np.uint64(probe) * ((h >> np.uint64(32)) | np.uint64(1))) & np.uint64(0xFFFFFFFF)
    return (spot * np.asarray(size, np.uint64)) >> np.uint64(32)


def build_segment(keys: np.ndarray, levels: np.ndarray) -> tuple[bytes, int]:
    """Bloom bits of one bucket: an entry for each level up to the key's own."""
    size = max(64, -(-int(levels.sum()) * BITS_PER_ENTRY // 64) * 64)
    flags = np.zeros(size, bool)
    at = 1
    while len(keys):
        for probe in range(PROBES):
            flags[_positions(keys, at, size, probe)] = True
        at += 1
        more = levels >= at
        keys, levels = keys[more], levels[more]
    return np.packbits(flags).tobytes(), size


@dataclass
class Filter:
    """All segments of one kind, back to back."""

    data: np.ndarray
    offsets: np.ndarray
    sizes: np.ndarray
    bits: int
    cutoff: int

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Probe level after level until one is missing."""
        out = np.zeros(len(keys), np.int64)
        top = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        offset, size = self.offsets[top], self.sizes[top]
        live = np.flatnonzero(size > 0)
        at = 1
        while len(live):
            for probe in range(PROBES):
                spot = _positions(keys[live], at, size[live], probe).astype(np.int64) + offset[live]
                there = (self.data[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8)) & 1
                live = live[there == 1]
                if not len(live):
                    break
            out[live] = at
            at += 1
        return out

    def counts(self, keys: np.ndarray) -> np.ndarray:
        return typical(self.levels(keys), self.cutoff)


class Lookup:
    """Exact counts of sorted keys, found through an index on their highest bits."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = keys, counts
        self.bits = max(1, int(len(keys)).bit_length())
        bounds = np.arange((1 << self.bits) + 1, dtype=np.float64)
        tops = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        self.start = np.searchsorted(tops, bounds[:-1].astype(np.int64))
        self.start = np.append(self.start, len(keys))

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        """Counts, 0 where a key is not there."""
        out = np.zeros(len(wanted), np.int64)
        top = (wanted >> np.uint64(64 - self.bits)).astype(np.int64)
        at, stop = self.start[top], self.start[top + 1]
        live = np.flatnonzero(at < stop)
        while len(live):
            same = self.keys[at[live]] == wanted[live]
            out[live[same]] = self.counts[at[live[same]]]
            live = live[~same]
            at[live] += 1
            live = live[at[live] < stop[live]]
        return out


@dataclass
class Model:
    head: Lookup  # exact counts of the frequent tokens
    texts: int
    tokens: int
    distinct: int
    bits: int

    def log_probabilities(self, own: np.ndarray, before: np.ndarray, both: np.ndarray) -> np.ndarray:
        """Interpolated log10 probabilities from quantised counts; BEGIN has the count of END.

        ``own`` and ``before`` are quantised counts of the tokens, ``both`` of the pairs.
        A history seen often is trusted up to one half.
        """
        single = (own + 1) / (self.tokens + self.distinct + 1)
        trust = 0.5 * before / (before + 8)
        return np.log10(trust * np.minimum(1, both / np.maximum(1, before)) + (1 - trust) * single)


def _sums(merged: DataFrame, column: str, width: int) -> dict[int, list[int]]:
    """Per kind, the element sums of an array column."""
    rows = merged.groupBy("kind").agg(*[F.sum(F.element_at(column, i + 1)).alias(str(i)) for i in range(width)]).collect()
    return {r["kind"]: [r[str(i)] for i in range(width)] for r in rows}


def choose_cutoff(octaves: list[int], least: int, max_bits: int) -> int:
    """Smallest power of two, from ``2**least``, whose entries fit the bits."""
    for a in range(least, OCTAVES):
        if sum(n * (o - a + 1) for o, n in enumerate(octaves) if o >= a) * BITS_PER_ENTRY <= max_bits:
            return 1 << a
    return 1 << OCTAVES


def _head(merged: DataFrame, quarters: list[int], most: int) -> Lookup:
    """Exact counts of the most frequent tokens, at most ``most`` of them."""
    held, edge = 0, 4 * OCTAVES
    while edge > 0 and held + quarters[edge - 1] <= most:
        edge -= 1
        held += quarters[edge]
    if not held:
        return Lookup(np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def pick(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                counts = np.frombuffer(batch.column("counts")[i].as_py(), np.int64)
                keys = np.frombuffer(batch.column("keys")[i].as_py(), np.uint64)
                kept = np.minimum((4 * np.log2(counts)).astype(np.int64), 4 * OCTAVES - 1) >= edge
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[kept].tobytes()], pa.binary()), pa.array([counts[kept].tobytes()], pa.binary())], names=["keys", "counts"]
                )

    rows = merged.filter(F.col("kind") == UNI).select("keys", "counts").mapInArrow(pick, "keys binary, counts binary").toArrow()
    keys = np.concatenate([np.frombuffer(k, np.uint64) for k in rows.column("keys").to_pylist()])
    counts = np.concatenate([np.frombuffer(c, np.int64) for c in rows.column("counts").to_pylist()])
    order = np.argsort(keys)
    return Lookup(keys[order], counts[order])


def train(
    docs: DataFrame,
    usable: Column,
    text_col: str = "text",
    head_tokens: int = 1_000_000,
    bytes_per_bucket: int = 16 << 20,
) -> tuple[Model, DataFrame]:
    """The model, and what is held per hash bucket: ``kind, bucket, keys, counts``.

    Tasks count their n-grams and send packed runs per hash bucket; a bucket holds the
    n-grams of about ``bytes_per_bucket`` of text. All n-grams of the training text are
    held, from count one, at any size: buckets grow in number, and only the tasks that
    answer for a bucket read it. What goes to every worker is at most ``head_tokens``
    exact counts, which save questions and change no result.
    """
    texts = docs.filter(usable).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.count(F.lit(1)).alias("texts")).first()
    bits = bucket_bits(size["bytes"] or 0, bytes_per_bucket)
    merged = written_once(merge_runs(count_runs(texts, bits)), "ngrams")
    sums = {r["kind"]: r for r in merged.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}
    head = _head(merged, _sums(merged.filter(F.col("kind") == UNI), "quarters", 4 * OCTAVES).get(UNI, [0] * 4 * OCTAVES), head_tokens)
    n, v = (sums[UNI]["n"], sums[UNI]["v"]) if UNI in sums else (0, 0)
    return Model(head, size["texts"], n, v, bits), merged.select("kind", "bucket", "keys", "counts")


ASKED = "chunk long, rows binary, kind int, bucket int, keys binary"
SCORED = "id {kind}, n_tokens long, n_known long, log_counts double, score double"


def _written(batch: pa.RecordBatch) -> bytes:
    """A batch as compressed bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _ask(rows: DataFrame, head, bits: int) -> DataFrame:
    """The rows ``uid, id, text`` of each chunk, compressed, and per chunk and bucket the distinct n-grams to look up.

    A chunk is some consecutive rows of a task and has the uid of its first one. Tokens of
    the head are not asked for.
    """
    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], ASKED).schema)

    def scan(batches):
        words, frequent = Words(), Lookup(*head.value)
        kept: dict[int, list[np.ndarray]] = {UNI: [], BI: []}
        chunk, size, held = None, 0, 0

        def flush():
            for kind, parts in kept.items():
                keys = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
                parts.clear()
                if kind == UNI:
                    keys = keys[frequent(keys) == 0]
                buckets, edges = _bucket_edges(keys, bits)
                n = len(buckets)
                if n:
                    cells = [pa.array(np.full(n, chunk)), pa.nulls(n, schema[1].type), pa.array(np.full(n, kind, np.int32)), pa.array(buckets)]
                    cells = [c.cast(f.type) for c, f in zip([*cells, _packed(keys, kind, bits, edges)], schema)]
                    yield pa.RecordBatch.from_arrays(cells, schema=schema)

        for batch in batches:
            text = batch.column("text")
            for lo, hi, hashes, first in words.slices(text):
                chunk = batch.column("uid")[lo].as_py() if chunk is None else chunk
                found, at = tokens(hashes, first)
                kept[UNI].append(found)
                kept[BI].append(pairs(found, at)[1])
                size, held = size + len(found), held + text.slice(lo, hi - lo).nbytes
                row = [chunk, _written(batch.select(["id", "text"]).slice(lo, hi - lo)), None, None, None]
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)
                if size >= FLUSH_TOKENS or held >= CHUNK_BYTES:
                    yield from flush()
                    chunk, size, held = None, 0, 0
        yield from flush()

    return rows.mapInArrow(scan, ASKED)


def _answer(asked: DataFrame, counts: DataFrame, bits: int) -> DataFrame:
    """``chunk, kind, bucket, found``: exact counts of unigrams and filter levels of bigrams, in the order asked."""
    names = ["chunk", "kind", "bucket", "found"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows:
            kind, bucket = asked.column("kind")[0].as_py(), asked.column("bucket")[0].as_py()
            if not held.num_rows:
                look = lambda keys: np.zeros(len(keys), np.int64)
            elif kind == UNI:
                look = Lookup(np.frombuffer(held.column("keys")[0].as_py(), np.uint64), np.frombuffer(held.column("counts")[0].as_py(), np.int64))
            else:
                data = np.frombuffer(held.column("keys")[0].as_py(), np.uint8)
                look = Filter(data, np.zeros(1, np.int64), np.array([8 * len(data)]), bits, 1).levels
            for chunk, keys in zip(asked.column("chunk").to_pylist(), asked.column("keys").to_pylist()):
                found = look(_unpacked(keys, kind)).astype(np.int8 if kind == BI else np.int64)
                out.append((chunk, kind, bucket, found.tobytes()))
        columns = zip(*out) if out else [[]] * 4
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    by = ["kind", "bucket"]
    return asked.groupBy(*by).cogroup(counts.groupBy(*by)).applyInArrow(answer, "chunk long, kind int, bucket int, found binary")


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of whole texts: ``id, n_tokens, n_known, train_tokens, base_score, score``.

    ``base_score`` is exact. ``score`` is the log10 probability by quantised counts: those
    of tokens are exact, those of bigrams come from the Bloom filter. Chunks of texts ask
    every hash bucket once for their distinct n-grams and meet the answers again, so no
    worker needs the whole filter. Null is an empty text, which is its end token alone.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    head = docs.sparkSession.sparkContext.broadcast((model.head.keys, model.head.counts))
    scanned = written_once(_ask(rows, head, model.bits), "asked")
    answers = _answer(scanned.filter("bucket is not null").select("chunk", "kind", "bucket", "keys"), counts, model.bits)
    ddl = SCORED.format(kind=rows.schema["id"].dataType.simpleString())
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], ddl).schema)
    sizes = (model.texts, model.tokens, model.distinct, model.bits)
    tools: list = []  # made once per task

    def found_by(answers: pa.Table, kind: int, dtype: type) -> np.ndarray:
        of = zip(answers.column("kind").to_pylist(), answers.column("bucket").to_pylist(), answers.column("found").to_pylist())
        return np.frombuffer(b"".join(f for _, _, f in sorted(r for r in of if r[0] == kind)), dtype)

    def assemble(texts: pa.Table, answers: pa.Table) -> pa.Table:
        texts = pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in texts.column("rows").to_pylist()])
        if not tools:
            tools.extend([Words(), Model(Lookup(*head.value), *sizes)])
        words, m = tools
        runs = [tokens(hashes, first) for _, _, hashes, first in words.slices(texts.column("text"))]
        found = np.concatenate([t for t, _ in runs])
        lengths = np.concatenate([np.diff(at) for _, at in runs])
        at = np.concatenate([[0], np.cumsum(lengths)])
        each, where = np.unique(found, return_inverse=True)
        exact = m.head(each)
        exact[exact == 0] = found_by(answers, UNI, np.int64)
        quantised = typical(np.where(exact > 0, level(np.maximum(exact, 1), 1), 0), 1)[where]
        before = np.empty(len(found))
        before[1:] = quantised[:-1]
        before[at[:-1]] = typical(level(np.array([m.texts]), 1), 1)[0] if m.texts else 0.0
        _, where_both = np.unique(pairs(found, at)[1], return_inverse=True)
        both = typical(found_by(answers, BI, np.int8).astype(np.int64), 1)[where_both]
        logs = m.log_probabilities(quantised, before, both)
        known, exact_logs = (exact > 0)[where], np.log10(exact + 1.0)[where]
        cells = [lengths, np.add.reduceat(known, at[:-1], dtype=np.int64), np.add.reduceat(exact_logs, at[:-1]), np.add.reduceat(logs, at[:-1])]
        columns = [texts.column("id").cast(schema[0].type), *[pa.array(c, f.type) for c, f in zip(cells, list(schema)[1:])]]
        return pa.Table.from_arrays(columns, schema=schema)

    texts = scanned.filter("bucket is null").select("chunk", "rows")
    scored = texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(assemble, ddl)
    whole = math.log10(model.tokens + model.distinct + 1)
    return scored.select(
        "id",
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        "score",
    )
