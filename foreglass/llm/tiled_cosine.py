"""Near-duplicate vectors by tiles in PCA order: leading dimensions first, the rest bounded by suffix norms."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foreglass.llm.near_dedup import _star
from foreglass.scale import positions, written_once

TILE = 256
BLOCK = 2048  # rows of a block of a small group; blocks grow with the root of the group's size
MOST_IN_BLOCK = 32_768
WIDEST_ROTATION = 2048  # wider vectors are compared in the order they come in
NEAR = 1e-9  # cosines this close to the threshold are taken again from the given components


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components as doubles in one flat array, the bounds of each row, and which rows are whole.

    A row is whole if it is not null, holds no null or non-finite component, and not only zeros.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    flat = column.flatten().cast(pa.float64())
    ends = np.r_[0, np.cumsum(size)]
    values = np.array(flat.fill_null(float("nan"))) + 0.0  # a negative zero becomes a zero
    bad = np.r_[0, np.cumsum(~np.isfinite(values))]
    some = np.r_[0, np.cumsum(values != 0)]
    return values, ends, (bad[ends[1:]] == bad[ends[:-1]]) & (some[ends[1:]] > some[ends[:-1]])


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; each is scaled by a power of two first, which rounds nothing, so no square overflows."""
    rows = np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine in double precision, summed without rounding on the way."""
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max())[1]) for x in (a, b))
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def read_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``id, label, width, key, v``: ``key`` tells equal vectors; width, key and v are null where a vector links with nothing."""

    def read(batches):
        for batch in batches:
            values, ends, whole = _matrix(batch.column("v"))
            whole &= ~np.asarray(batch.column("label").is_null())
            key = [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() if ok else None for a, b, ok in zip(ends, ends[1:], whole)]
            width = pa.array(np.diff(ends), pa.int32(), mask=~whole)
            wanted = pa.array(np.where(whole, np.arange(len(whole)), -1))
            v = batch.column("v").take(pa.array(wanted.to_numpy(), mask=~whole))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), width, pa.array(key, pa.binary()), v], names=["id", "label", "width", "key", "v"]
            )

    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(read, f"id {kinds['id']}, label {kinds['label']}, width int, key binary, v {kinds['v']}")


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """Axes of the unit vectors, the one with most of their squares first, for every width.

    Second moments are summed in the tasks and added row by row; the driver gets width
    squared doubles for each width up to ``WIDEST_ROTATION``. Any rotation gives the
    same links; this one makes the bounds tight early.
    """

    def moments(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for width, _, x in _by_width(batch):
                if width <= WIDEST_ROTATION:
                    sums[width] = sums.get(width, 0) + x.T @ x
        for width, m in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([width] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array(list(m), pa.list_(pa.float64()))], names=["width", "i", "m"]
            )

    def added(table: pa.Table) -> pa.Table:
        rows = np.asarray(table.column("m").combine_chunks().flatten()).reshape(table.num_rows, -1)
        return pa.table({"width": table.column("width").slice(0, 1), "i": table.column("i").slice(0, 1), "m": pa.array([rows.sum(axis=0)], pa.list_(pa.float64()))})

    ddl = "width int, i int, m array<double>"
    rows = classes.select("width", "v").mapInArrow(moments, ddl).groupBy("width", "i").applyInArrow(added, ddl).orderBy("width", "i").collect()
    axes = {}
    for width in {r["width"] for r in rows}:
        _, vectors = np.linalg.eigh(np.array([r["m"] for r in rows if r["width"] == width]))
        axes[width] = np.ascontiguousarray(vectors[:, ::-1])
    return axes


def _by_width(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, rows, their unit vectors) for each width of a batch with ``width, v``."""
    values, ends, _ = _matrix(batch.column("v"))
    size = np.diff(ends)
    for width in np.unique(size):
        rows = np.flatnonzero(size == width)
        yield int(width), rows, _unit(values[ends[rows][:, None] + np.arange(width)])


def _stops(width: int) -> list[int]:
    """How many dimensions are summed before each look at the bounds: 8, 16, 32, ... all."""
    out, at = [], 8
    while at < width:
        out.append(at)
        at *= 2
    return [*out, width]


class Side:
    """One block in PCA coordinates, with suffix norms at every stop and a box around each tile's leading dimensions."""

    def __init__(self, turned: np.ndarray, given: np.ndarray) -> None:
        self.x, self.given, self.stops = turned, given, _stops(turned.shape[1])
        self.rest = [np.sqrt(np.maximum(0.0, (turned[:, s:] ** 2).sum(axis=1))) for s in self.stops]
        self.tiles = [(i, min(i + TILE, len(turned))) for i in range(0, len(turned), TILE)]
        self.low = np.array([turned[a:b, : self.stops[0]].min(axis=0) for a, b in self.tiles])
        self.high = np.array([turned[a:b, : self.stops[0]].max(axis=0) for a, b in self.tiles])


def tile_links(a: Side, i: int, b: Side, j: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked rows of two tiles, as two arrays of row numbers.

    The leading products of all pairs are one matrix; a pair stays while they and the
    product of the suffix norms, which the residual product cannot exceed, reach
    ``least``. Few pairs that stay are followed alone, many as a matrix.
    """
    (p, q), (r, s) = a.tiles[i], b.tiles[j]
    gap = np.maximum(0.0, np.maximum(a.low[i] - b.high[j], b.low[j] - a.high[i]))
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if (gap * gap).sum() > 2 - 2 * least + NEAR:  # unit vectors that far apart have a lower cosine
        return nothing
    stops, at = a.stops, a.stops[0]
    products = a.x[p:q, :at] @ b.x[r:s, :at].T
    left, right, sums = None, None, None
    for n, stop in enumerate(stops):
        if stop > at:
            if left is None:
                products += a.x[p:q, at:stop] @ b.x[r:s, at:stop].T
            else:
                sums += np.einsum("ij,ij->i", a.x[left, at:stop], b.x[right, at:stop])
            at = stop
        if left is None:
            stay = products + np.outer(a.rest[n][p:q], b.rest[n][r:s]) >= least - NEAR
            count = int(stay.sum())
            if not count:
                return nothing
            if count * 8 <= stay.size or stop == stops[-1]:
                u, v = np.nonzero(stay)
                left, right, sums = u + p, v + r, products[u, v]
        else:
            stay = sums + a.rest[n][left] * b.rest[n][right] >= least - NEAR
            left, right, sums = left[stay], right[stay], sums[stay]
    linked = sums >= least + NEAR
    for k in np.flatnonzero(~linked):
        linked[k] = cosine(a.given[left[k]], b.given[right[k]]) >= least
    return left[linked], right[linked]


class Forest:
    """Connected parts of numbered rows."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        at = self.up[rows]
        while (self.up[at] != at).any():
            at = self.up[at]
        return at

    def join(self, row: int, others: np.ndarray) -> None:
        roots = np.unique(self.roots(np.append(others, row)))
        self.up[roots] = roots[0]
        self.up[others] = roots[0]


def block_links(a: Side, b: Side, weight_a: np.ndarray, weight_b: np.ndarray, same: bool, least: float) -> tuple[np.ndarray, np.ndarray, Forest]:
    """Weighted number of links of every row of two blocks, and the parts they form (rows of ``b`` follow those of ``a``).

    With ``same`` both are one block, and every pair in it counts once for each of its rows.
    """
    shift = 0 if same else len(a.x)
    forest = Forest(len(a.x) + (0 if same else len(b.x)))
    n_a, n_b = np.zeros(len(a.x), np.int64), np.zeros(len(b.x), np.int64)
    for i in range(len(a.tiles)):
        for j in range(i if same else 0, len(b.tiles)):
            left, right = tile_links(a, i, b, j, least)
            if same and i == j:
                above = left < right
                left, right = left[above], right[above]
            if not len(left):
                continue
            np.add.at(n_a, left, weight_b[right])
            np.add.at(n_b, right, weight_a[left])
            cuts = np.flatnonzero(np.r_[True, left[1:] != left[:-1]])
            for row, others in zip(left[cuts], np.split(right, cuts[1:])):
                forest.join(int(row), others + shift)
    return n_a, n_b, forest


def _blocks(classes: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    """``uid, block`` and the block's group: classes of a group in the order of their first PCA coordinate, cut evenly."""

    def first(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for width, rows, x in _by_width(batch):
                out[rows] = x @ axes[width][:, 0] if width in axes else x[:, 0]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("uid", "label", "width")], pa.array(out)], names=["uid", "label", "width", "x"])

    kind = classes.schema["label"].dataType.simpleString()
    placed = classes.select("uid", "label", "width", "v").mapInArrow(first, f"uid long, label {kind}, width int, x double")
    ordered = positions(placed, ["label", "width"], ["x"])
    sizes = written_once(ordered.groupBy("label", "width").agg(F.count(F.lit(1)).alias("c")), "group-sizes")
    size = F.least(F.lit(MOST_IN_BLOCK), F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(F.col("c") * F.lit(BLOCK / 4)))))
    joined = ordered.join(sizes, ["label", "width"])
    return joined.select("uid", "label", "width", "x", F.floor((F.col("position") - 1) / size).cast("int").alias("block"))


def vector_links(classes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Counts and connections of linked classes.

    ``classes`` holds ``uid, id, label, width, c, v``: distinct vectors and how many rows
    have each. Vectors of a label and width lie in blocks in the order of their first
    PCA coordinate. Two blocks meet in one task unless their first coordinates are too far
    apart; there, tiles are compared by ``tile_links``. A task holds two blocks of at most
    ``MOST_IN_BLOCK`` vectors, and sends a count and one connection a vector, however many
    pairs it found.

    Returns ``uid, n`` (rows of other classes that a block found linked; to be added up) and
    ``a_id, a_uid, b_id, b_uid``, which connect the same classes as the links do.
    """
    axes = principal_axes(classes)
    held = classes.sparkSession.sparkContext.broadcast(axes)  # width squared doubles, at most 32 MB a width
    blocks = written_once(_blocks(classes, axes), "vector-blocks")
    edges = blocks.groupBy("label", "width", "block").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    edges = written_once(edges, "block-edges")
    other = edges.select("label", "width", F.col("block").alias("b"), F.col("lo").alias("b_lo"))
    radius = math.sqrt(max(0.0, 2 - 2 * least)) + NEAR
    meet = edges.join(other, ["label", "width"]).filter((F.col("b") >= F.col("block")) & (F.col("b_lo") <= F.col("hi") + radius))
    meet = meet.select("label", "width", F.col("block").alias("a"), "b", F.xxhash64("label", "width", "block", "b").alias("pair"))
    sides = meet.select("label", "width", F.col("a").alias("block"), "pair", F.lit(0).alias("side"), (F.col("a") == F.col("b")).alias("same"))
    sides = sides.unionAll(meet.filter("a <> b").select("label", "width", F.col("b").alias("block"), "pair", F.lit(1).alias("side"), F.lit(False).alias("same")))
    sides = written_once(sides, "block-pairs")
    rows = classes.select("uid", "id", "c", "v").join(blocks.select("uid", "label", "width", "block"), "uid")
    dealt = rows.join(sides, ["label", "width", "block"]).select("pair", "label", "width", "block", "side", "same", "uid", "id", "c", "v")

    kind = classes.schema["id"].dataType.simpleString()
    ddl = f"a_id {kind}, a_uid long, b_id {kind}, b_uid long, n long"

    def compare(table: pa.Table) -> pa.Table:
        ids, uids = table.column("id").combine_chunks(), table.column("uid").to_numpy()
        n, edge_from, edge_to = np.zeros(len(uids), np.int64), [], []
        for block_a, block_b in _met(table):
            values, ends, _ = _matrix(table.column("v"))
            width = int(ends[1] - ends[0])
            given = values.reshape(-1, width)
            turn = held.value.get(width)
            side = []
            for rows in (block_a, block_b):
                x = _unit(given[rows])
                x = x @ turn if turn is not None else x
                near = np.lexsort(x[:, min(width, 4) - 1 :: -1].T) if len(x) <= TILE else _compact(x)
                side.append((rows[near], Side(x[near], given[rows[near]])))
            (rows_a, a), (rows_b, b) = side
            weight = table.column("c").to_numpy()
            same = block_a is block_b
            n_a, n_b, forest = block_links(a, b, weight[rows_a], weight[rows_b], same, least)
            n[rows_a] += n_a
            n[rows_b] += n_b
            members = rows_a if same else np.concatenate([rows_a, rows_b])
            root = forest.roots(np.arange(len(members)))
            moved = np.flatnonzero(root != np.arange(len(members)))
            edge_from.append(members[moved])
            edge_to.append(members[root[moved]])
        linked = np.flatnonzero(n)
        start = np.concatenate([linked, *edge_from]).astype(np.int64)
        end = np.concatenate([linked, *edge_to]).astype(np.int64)
        count = np.r_[n[linked], np.zeros(len(start) - len(linked), np.int64)]
        return pa.table({"a_id": ids.take(pa.array(start)), "a_uid": uids[start], "b_id": ids.take(pa.array(end)), "b_uid": uids[end], "n": count})

    found = written_once(dealt.groupBy("pair").applyInArrow(compare, ddl), "vector-links")
    return found.filter("a_uid = b_uid").select(F.col("a_uid").alias("uid"), "n"), found.filter("a_uid <> b_uid").drop("n")


def _met(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the two blocks of a pair; a block that meets itself comes twice as one object."""
    side = table.column("side").to_numpy()
    left = np.flatnonzero(side == 0)
    yield (left, left) if table.column("same")[0].as_py() else (left, np.flatnonzero(side == 1))


def _compact(x: np.ndarray) -> np.ndarray:
    """Order that puts near vectors into one tile: halves by the widest leading dimension, again and again."""
    lead = x[:, : min(8, x.shape[1])]

    def halves(rows: np.ndarray) -> Iterator[np.ndarray]:
        if len(rows) <= TILE:
            yield rows
            return
        part = lead[rows]
        axis = int((part.max(axis=0) - part.min(axis=0)).argmax())
        middle = max(TILE, len(rows) // 2 // TILE * TILE)
        order = np.argpartition(part[:, axis], middle)
        yield from halves(rows[order[:middle]])
        yield from halves(rows[order[middle:]])

    return np.concatenate(list(halves(np.arange(len(x)))))


def near_vectors(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Components of vectors of one label and one length whose cosine is ``least`` or more.

    Returns one row per vector: ``id, n_links`` (other rows linked directly),
    ``component_id`` (smallest id reachable, its own included) and ``kept``. Equal vectors
    are one class from the start, told by a 128-bit digest, so copies are never paired.

    Vectors that are null, empty, zero, or hold null or non-finite components, and those
    of null label, link with nothing. Every row is a vector of its own, also where ids
    repeat. A null id counts as larger than any other: a component of null ids has a null
    id, and its rows are kept. Other columns are ignored. No rows give no rows.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    rows = written_once(read_vectors(vectors, id_col, vector_col, label_col).withColumn("row", F.monotonically_increasing_id()), "vectors")
    key = ["label", "width", "key"]
    smallest = F.min(F.struct(F.col("id").isNull().alias("z"), "id", F.col("row").alias("uid"))).alias("node")
    groups = rows.filter("key is not null").groupBy(*key).agg(smallest, F.count(F.lit(1)).alias("c"))
    groups = written_once(groups.select(*key, "node.id", "node.uid", "c"), "vector-classes")
    own = rows.select(F.col("row").alias("uid"), "v")
    classes = written_once(groups.join(own, "uid").select("uid", "id", "label", "width", "c", "v"), "distinct-vectors")
    counts, edges = vector_links(classes, least)
    node = lambda i, u: F.struct(F.col(i).isNull().alias("z"), F.col(i).alias("id"), F.col(u).alias("uid"))
    roots = _star(edges.select(node("a_id", "a_uid").alias("a"), node("b_id", "b_uid").alias("b")))
    roots = written_once(roots.select(F.col("id.uid").alias("uid"), F.col("root.id").alias("component_id")), "vector-roots")
    linked = counts.groupBy("uid").agg(F.sum("n").alias("n"))
    told = groups.join(linked, "uid", "left").join(roots.withColumn("found", F.lit(True)), "uid", "left")
    component = F.when(F.col("found"), F.col("component_id")).otherwise(F.col("id"))
    told = told.select(*key, (F.col("c") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), component.alias("component_id"), F.lit(True).alias("usable"))
    told = written_once(told, "vector-results")  # read back, the join can split a hot key
    joined = rows.select("id", *key).join(told, key, "left")
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("id"))
    return joined.select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
