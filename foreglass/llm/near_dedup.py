"""Near duplicates by a chosen-path set similarity join on word shingles."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from foreglass.llm.words import Words, mix
from foreglass.scale import written_once

HASHES = 64
BLOOM_BITS = 25  # 4 MiB
SPOKES = 500
PER_DEPTH = 5  # signature places that deeper nodes choose from, fresh ones at each depth


def _multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.RandomState(seed).randint(0, 1 << 62, n).astype(np.uint64) * np.uint64(2) + np.uint64(1)


class Shingler:
    """Sets of hashed word shingles, their fingerprints and minwise signatures."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.words = Words()
        self.place = _multipliers(width + 1, 11)
        self.turn = _multipliers(HASHES // 2, 13)

    def _row_sets(self, hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        n, k = len(hashes), self.width
        runs = np.zeros(max(0, n - k + 1), np.uint64)
        for i in range(k):
            runs += hashes[i : n - k + 1 + i] * self.place[i] if n >= k else runs
        runs = mix(runs)
        out = []
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= k:
                out.append(np.unique(runs[a : b - k + 1]))
            elif b > a:  # too short for a shingle: the whole sequence is one
                whole = (hashes[a:b] * self.place[: b - a]).sum(dtype=np.uint64, keepdims=True)
                out.append(mix(whole + self.place[k:] * np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out

    def sets(self, column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(first row, sorted distinct shingles per row) for slices of a text column."""
        for lo, _, hashes, first in self.words.slices(column):
            yield lo, self._row_sets(hashes, first)

    def signatures(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Signature, and two fingerprint halves, of each set; none may be empty."""
        head = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
        every = np.concatenate(sets)
        out = np.empty((len(sets), HASHES), np.uint32)
        for i, turn in enumerate(self.turn):
            v = every * turn
            v ^= v >> np.uint64(29)
            out[:, 2 * i : 2 * i + 2] = np.minimum.reduceat(v.view(np.uint32).reshape(-1, 2), head, axis=0)
        one = np.add.reduceat(every, head)
        two = np.add.reduceat(mix(every + self.place[0]), head)
        return out.view(np.int32), one.view(np.int64), two.view(np.int64)


def shingle_table(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``id, n, f1, f2, sig``: set size, fingerprint and signature of every text (null sig if empty)."""

    def build(batches):
        shingler = Shingler(width)
        for batch in batches:
            for lo, sets in shingler.sets(batch.column("text")):
                n = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(n)
                one, two = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
                signs: list = [None] * len(n)
                if len(some):
                    sig, one[some], two[some] = shingler.signatures([sets[i] for i in some])
                    for row, i in enumerate(some):
                        signs[i] = sig[row]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, len(n)), pa.array(n), pa.array(one), pa.array(two), pa.array(signs, pa.list_(pa.int32()))],
                    names=["id", "n", "f1", "f2", "sig"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(build, f"id {kind}, n long, f1 long, f2 long, sig array<int>")


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows of one key after the other, from batches sorted by the key."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(key))
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if kept and np.asarray(kept[-1].column(key))[0] != keys[a]:
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(batch.slice(a, b - a))
    if kept:
        yield pa.Table.from_batches(kept)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Row tuples as record batches."""
    kept: list[tuple] = []
    for row in rows:
        kept.append(row)
        if len(kept) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), schema)], schema=schema)
            kept = []
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), schema)], schema=schema)


def connected(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[list[int]]:
    """Connected parts of 0..n-1; ``near(i, others)`` tells which of the others are linked to i.

    Each member is compared once, with those that belong to no part yet. A part of
    close copies costs little more than one comparison a member, and no link that
    matters is left out.
    """
    free = np.arange(n)
    while len(free):
        part, free = [int(free[0])], free[1:]
        for member in part:  # grows while it is gone through
            if not len(free):
                break
            hit = near(member, free)
            part.extend(free[hit].tolist())
            free = free[~hit]
        yield part


def likely_parts(n: np.ndarray, sig: np.ndarray, least: float, ratio: float) -> Iterator[list[int]]:
    """Parts, of two or more, that likely links connect among a node's members."""

    def near(i: int, others: np.ndarray) -> np.ndarray:
        size = (n[others] >= ratio * n[i]) & (n[i] >= ratio * n[others])
        size[size] = (sig[others[size]] == sig[i]).sum(axis=1) >= least * HASHES
        return size

    return (part for part in connected(len(n), near) if len(part) > 1)


def linked(a: np.ndarray, b: np.ndarray, share: tuple[int, int]) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least ``share`` (numerator, denominator)."""
    up, down = share
    if min(len(a), len(b)) * down < up * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return down * both >= up * (len(a) + len(b) - both)


def exact_parts(sets: list[np.ndarray], share: tuple[int, int]) -> Iterator[list[int]]:
    """Parts of two or more texts that exact links connect."""
    near = lambda i, others: np.fromiter((linked(sets[i], sets[j], share) for j in others), bool, len(others))
    return (part for part in connected(len(sets), near) if len(part) > 1)


def _some_texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of the wanted ids, and few others, without moving all texts.

    The ids go into a Bloom filter of ``BLOOM_BITS`` bits, whatever their number, which
    every task gets; the join that follows takes out what passes by chance. With very
    many ids the filter lets more texts through to that join, and loses none.
    """
    parts = 64

    def mark(batches):
        flags = np.zeros(1 << BLOOM_BITS, bool)
        for batch in batches:
            for spot in _spots(np.asarray(batch.column("h"))):
                flags[spot] = True
        rows = np.packbits(flags).reshape(parts, -1)
        some = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([rows[i].tobytes() for i in some], pa.binary())], names=["part", "data"])

    def either(table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(b, np.uint8) for b in table.column("data").to_pylist()]
        return pa.table({"part": table.column("part").slice(0, 1), "data": pa.array([np.bitwise_or.reduce(rows).tobytes()], pa.binary())})

    marked = wanted.select(F.xxhash64("id").alias("h")).mapInArrow(mark, "part int, data binary")
    found = marked.groupBy("part").applyInArrow(either, "part int, data binary").collect()
    whole = np.zeros((parts, (1 << BLOOM_BITS) // 8 // parts), np.uint8)
    for row in found:
        whole[row["part"]] = np.frombuffer(row["data"], np.uint8)
    held = texts.sparkSession.sparkContext.broadcast(whole.tobytes())

    def keep(batches):
        flags = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            there = np.ones(batch.num_rows, bool)
            for spot in _spots(np.asarray(batch.column("h"))):
                there &= (flags[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8)) & 1 == 1
            if there.any():
                yield batch.filter(pa.array(there))

    rows = texts.select("id", "text", F.xxhash64("id").alias("h"))
    return rows.mapInArrow(keep, rows.schema).select("id", "text")


def _spots(hashes: np.ndarray) -> Iterator[np.ndarray]:
    """Bit positions of ids in the Bloom filter."""
    for i in range(3):
        yield (mix(hashes.view(np.uint64) + np.uint64(i)) >> np.uint64(64 - BLOOM_BITS)).astype(np.int64)


def _confirmed(rows: DataFrame, texts: DataFrame, width: int, share: tuple[int, int]) -> DataFrame:
    """Exactly connected members of each part: pairs ``a, b`` of a part's first member and another.

    ``rows`` holds ``part, member, hub``; full sets of the texts are compared. In a part
    with a hub, members are compared with the hub alone, else all with all.
    """
    kind = rows.schema["member"].dataType.simpleString()
    ddl = f"a {kind}, b {kind}"
    out = to_arrow_schema(rows.sparkSession.createDataFrame([], ddl).schema)

    def confirm(batches):
        shingler = Shingler(width)

        def sets(batches):
            for batch in batches:
                for lo, found in shingler.sets(batch.column("text")):
                    columns = [batch.column(c).slice(lo, len(found)) for c in ("part", "member", "hub")]
                    packed = pa.array([s.tobytes() for s in found], pa.binary())
                    yield pa.RecordBatch.from_arrays([*columns, packed], names=["part", "member", "hub", "set"])

        def links(batches):
            for group in _groups(sets(batches), "part"):
                full = [np.frombuffer(s, np.uint64) for s in group.column("set").to_pylist()]
                names = group.column("member").to_pylist()
                hubs = np.flatnonzero(group.column("hub").to_numpy(zero_copy_only=False))
                for hub in hubs:
                    yield from ((names[hub], names[i]) for i in range(len(full)) if i != hub and linked(full[hub], full[i], share))
                if not len(hubs):
                    for part in exact_parts(full, share):
                        yield from ((names[part[0]], names[i]) for i in part[1:])

        yield from _batched(links(batches), out)

    rows = written_once(rows, "members")
    some = _some_texts(texts, rows.select(F.col("member").alias("id")).distinct())
    full = rows.join(some, F.col("member") == F.col("id")).select("part", "member", "hub", "text")
    return full.repartition("part").sortWithinPartitions("part").mapInArrow(confirm, ddl)


def _likely(lists: DataFrame, sets: DataFrame, least: float, ratio: float) -> DataFrame:
    """Distinct ``members array`` of likely parts of the given member lists, by their signatures."""
    kind = lists.schema["members"].dataType.elementType.simpleString()
    rows = lists.select(F.xxhash64("members").alias("node"), F.explode("members").alias("member"))

    ddl = f"members array<{kind}>"
    out = to_arrow_schema(lists.sparkSession.createDataFrame([], ddl).schema)

    def compare(batches):
        def parts():
            for group in _groups(batches, "node"):
                names = group.column("member").to_pylist()
                n = np.asarray(group.column("n").combine_chunks())
                sig = np.asarray(group.column("sig").combine_chunks().flatten()).reshape(len(n), HASHES)
                for part in likely_parts(n, sig, least, ratio):
                    if len(found := sorted({names[i] for i in part})) > 1:
                        yield (found,)

        yield from _batched(parts(), out)

    own = sets.select(F.col("id").alias("member"), "n", "sig")
    full = rows.join(own, "member").select("node", "member", "n", "sig")
    return full.repartition("node").sortWithinPartitions("node").mapInArrow(compare, ddl).distinct()


def _star(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large and small stars: ``id, root`` for every linked id.

    Every step moves edges towards smaller ids with one minimum per id (partial
    aggregates) and one join; rounds grow with the logarithm of the longest chain.
    """

    def large(e: DataFrame) -> DataFrame:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionAll(least.select("u", F.col("m").alias("v")))

    tidy = lambda e: e.filter("u <> v").distinct()
    state = written_once(tidy(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), "links")
    before = None
    while True:
        now = tuple(state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return state.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = now
        state = written_once(tidy(small(tidy(large(state)))), "stars")


def _children(members: DataFrame, sets: DataFrame, depth: int, base: int, branches: int) -> DataFrame:
    """Members of the children of nodes: each node chooses ``branches`` signature places, members go by their values."""
    full = members.join(sets.select(F.col("id").alias("rep"), "sig"), "rep")
    paths = []
    for b in range(branches):
        place = F.pmod(F.xxhash64("path"), F.lit(PER_DEPTH)) + b
        place = (F.pmod(place, F.lit(PER_DEPTH)) + base + (depth - 2) * PER_DEPTH + 1).cast("int")
        paths.append(F.xxhash64("path", place, F.element_at("sig", place)))
    return full.select(F.explode(F.array(*paths)).alias("path"), "rep", "label")


def near_links(
    sets: DataFrame,
    texts: DataFrame,
    width: int,
    share: tuple[int, int] = (80, 100),
    trees: int = 3,
    branches: int = 2,
    node_limit: int = 2000,
    margin: float = 0.2,
) -> DataFrame:
    """Exact links ``a, b`` that connect similar sets, found by recursive branching.

    The root of each tree, and each larger node below, chooses ``branches`` places of the
    minwise signature, and its members go to the child of the value they have there; sets
    of similarity s share a child with probability ``1 - (1 - s) ** branches``. A node of
    at most ``node_limit`` members is compared exhaustively, by signature within a margin
    of four standard errors and then on full sets. A larger node first compares all its
    members with one of them; those linked to it are known to be connected, and a child
    that holds none but connected members needs no work. What is still large when the
    signature is used up is compared exhaustively block by block.
    """
    up, down = share
    least, ratio = up / down - margin, up / down
    kind = sets.schema["id"].dataType.simpleString()
    base = trees * branches
    roots = [F.xxhash64(F.lit(i), F.element_at("sig", i + 1)) for i in range(base)]
    members = sets.select(F.explode(F.array(*roots)).alias("path"), F.col("id").alias("rep"), F.col("id").alias("label"))
    lists, links = [], []
    last = 1 + (HASHES - base) // PER_DEPTH
    for depth in range(1, last + 1):
        members = written_once(members, "nodes")
        # Children of which all members are connected already are done: one label.
        sizes = members.groupBy("path").agg(F.count(F.lit(1)).alias("c"), F.min("label").alias("l1"), F.max("label").alias("l2"))
        sizes = written_once(sizes.filter("c > 1 and l1 <> l2").select("path", "c"), "sizes")
        leaves = members.join(sizes.filter(F.col("c") <= node_limit).select("path"), "path")
        lists.append(leaves.groupBy("path").agg(F.array_sort(F.collect_set("rep")).alias("members")).select("members"))
        large = sizes.filter(F.col("c") > node_limit)
        if large.isEmpty():
            break
        inside = written_once(members.join(large, "path"), "large")
        if depth == last:
            lists.append(_blocks(inside, node_limit))
            break
        loose = F.struct((F.col("rep") != F.col("label")).alias("done"), F.xxhash64("rep", "path").alias("h"), F.col("rep").alias("pivot"), "label")
        pivots = inside.groupBy("path").agg(F.min(loose).alias("p")).select("path", F.col("p.pivot").alias("pivot"), F.col("p.label").alias("joined"))
        pairs = inside.join(pivots, "path").filter("rep <> pivot")
        found = written_once(_confirmed(_spokes(pairs, sets, least, ratio), texts, width, share).distinct(), "pivot-links")
        links.append(found)
        absorbed = pairs.join(found, (F.col("pivot") == F.col("a")) & (F.col("rep") == F.col("b")), "left")
        label = F.when(F.col("a").isNotNull() & (F.col("rep") == F.col("label")), F.col("joined")).otherwise(F.col("label"))
        rest = absorbed.select("path", "rep", label.alias("label"))
        rest = rest.unionAll(pivots.select("path", F.col("pivot").alias("rep"), F.col("joined").alias("label")))
        members = _children(rest, sets, depth + 1, base, branches)
    every = reduce(DataFrame.unionAll, lists).filter(F.size("members") > 1).distinct()
    parts = _likely(every, sets, least, ratio)
    rows = parts.select(F.xxhash64("members").alias("part"), F.explode("members").alias("member"), F.lit(False).alias("hub"))
    links.append(_confirmed(rows, texts, width, share))
    return reduce(DataFrame.unionAll, links).select(F.col("a").cast(kind), F.col("b").cast(kind))


def _spokes(pairs: DataFrame, sets: DataFrame, least: float, ratio: float) -> DataFrame:
    """Likely links to the pivots as parts with a hub, of about ``SPOKES`` members each."""
    own = sets.select(F.col("id").alias("rep"), "n", "sig")
    hub = sets.select(F.col("id").alias("pivot"), F.col("n").alias("hub_n"), F.col("sig").alias("hub_sig"))
    same = F.size(F.filter(F.zip_with("sig", "hub_sig", lambda x, y: x == y), lambda x: x))
    size = (F.col("n") >= ratio * F.col("hub_n")) & (F.col("hub_n") >= ratio * F.col("n"))
    # a pivot has as many rows as its members have parts, so that no task meets all members of a node
    splits = F.ceil(F.col("c") / SPOKES)
    dealt = pairs.select("pivot", "rep", "c", F.pmod(F.xxhash64("rep"), splits).alias("split"))
    dealt_hubs = pairs.select("pivot", "c").distinct().join(hub, "pivot").withColumn("split", F.explode(F.sequence(F.lit(0).cast("long"), splits - 1)))
    likely = dealt.join(own, "rep").join(dealt_hubs, ["pivot", "c", "split"]).filter(size & (same >= least * HASHES))
    rows = likely.select(F.xxhash64("pivot", "c", "split").alias("part"), "pivot", F.col("rep").alias("member")).distinct()
    hubs = rows.select("part", F.col("pivot").alias("member"), F.lit(True).alias("hub")).distinct()
    return rows.select("part", "member", F.lit(False).alias("hub")).unionAll(hubs)


def _blocks(inside: DataFrame, node_limit: int) -> DataFrame:
    """Member lists that together hold every pair of a node, for nodes that do not fall apart."""
    blocks = F.ceil(F.col("c") / (node_limit // 2)).cast("int")
    placed = inside.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("rep"), blocks)})
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = other.select("path", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep")
    return pair.groupBy("path", "i", "j").agg(F.array_sort(F.collect_set("rep")).alias("members")).select("members")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, share: tuple[int, int] = (80, 100), **options
) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of at least ``share``.

    A set holds the distinct ``width``-word shingles of a text (A-Z lower-cased; of a
    shorter text, its whole sequence). Equal sets are one class from the start, so copies
    are never paired. Links between classes are found by ``near_links`` and confirmed on
    full sets of 64-bit hashes; components are the smallest ids reachable.

    Returns ``id, n_shingles, component_id, kept``. A null text, or one without words, is
    linked with nothing. Rows of null id stand alone: no component, kept. Rows that share
    an id are one document, which is linked by any of their texts.
    """
    table = written_once(shingle_table(docs, id_col, text_col, width), "shingles")
    usable = table.filter("n > 0 and id is not null")
    key = ["n", "f1", "f2"]
    best = usable.groupBy(*key).agg(F.min(F.struct("id", "sig")).alias("r"))
    classes = written_once(best.select(*key, F.col("r.id").alias("id"), F.col("r.sig").alias("sig")), "classes")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    links = near_links(classes.select("id", "n", "sig"), texts, width, share, **options)
    # An id with several texts has a class for each; they are one document.
    same = usable.join(classes.select(*key, F.col("id").alias("rep")), key)
    member = same.select("id", "rep").distinct()
    links = links.unionAll(member.filter("id <> rep").join(member.groupBy("id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "id").select("id", "rep"))
    roots = written_once(_star(links), "roots")
    grouped = member.join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left")
    component = grouped.groupBy("id").agg(F.min(F.coalesce("root", "rep")).alias("component"))
    rows = table.select("id", "n").join(component, "id", "left")
    return rows.select(
        "id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
    )
