"""Joins of similar strings and records.

Equal values are one class with a count, so copies are never paired; ``members`` maps
records to classes. Strings within an edit distance are found through an inverted index of
their rarest q-grams, very short ones through what is left after deletions, and records of
a block by bounds on their mean similarity. Candidates are checked in the task that finds
them and only links leave it. Lists that many values share are split into pairs of pieces,
so a task holds a bounded number of values, and every partner of a value is met.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from foreglass.operators.linkage import connected_groups, jaro_winkler_scores
from foreglass.scale import broadcast_if_small, small_slices, written_once

BUCKETS = 1 << 16  # hash buckets in which q-grams are counted
AT_ONCE = 1 << 16  # pairs compared at a time


def value_classes(df: DataFrame, block: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``block columns, compared columns, n``: distinct values and their rows; rows without one of them are left out."""
    every = [*block, *columns]
    return df.dropna(subset=every).groupBy(*every).agg(F.count(F.lit(1)).alias("n"))


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts back to back, and where each begins (one more than texts)."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.r_[0, np.cumsum(size)]


def code_rows(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points as one row a text, filled up with zeros, and the lengths."""
    codes, begin = code_points(texts)
    size = np.diff(begin)
    out = np.zeros((len(texts), int(size.max(initial=0))), np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = codes
    return out, size


def edit_distances(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray, most: int) -> np.ndarray:
    """Edit distances of many pairs (rows of code points) at once; ``most + 1`` stands for all larger ones.

    Only the ``2 * most + 1`` diagonals that a distance of ``most`` can reach are filled,
    and pairs whose diagonals are all beyond it are left alone from then on.
    """
    far = most + 1
    out = np.full(len(a), far)
    at = np.flatnonzero(abs(size_b - size_a) <= most)  # the pairs still looked at
    shift = np.arange(-most, most + 1)
    wide = np.zeros((len(a), max(a.shape[1], b.shape[1]) + 2 * most + 1), b.dtype)
    wide[:, most : most + b.shape[1]] = b
    cost = np.where(shift >= 0, shift, far) * np.ones((len(at), 1), np.int64)
    a, wide, size_a, last = a[at], wide[at], size_a[at], (size_b - size_a)[at] + most
    for i in range(a.shape[1] + 1):
        if i:
            step = cost + (a[:, i - 1 : i] != wide[:, i - 1 : i + 2 * most])
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
            step[:, i + shift < 0] = far
            step[:, i + shift == 0] = i
            for d in range(1, len(shift)):
                step[:, d] = np.minimum(step[:, d], step[:, d - 1] + 1)
            cost = np.minimum(step, far)
        ends = np.flatnonzero(size_a == i)
        out[at[ends]] = cost[ends, last[ends]]
        if i % 8 == 7 or i == a.shape[1] - 1:
            stay = (size_a > i) & (cost.min(axis=1, initial=far) < far)
            if not stay.any():
                break
            if stay.mean() < 0.7:
                at, a, wide, size_a, last, cost = (x[stay] for x in (at, a, wide, size_a, last, cost))
    return out


def shortest_indexed(most: int, q: int) -> int:
    """Length from which a string has more q-grams than ``most`` edits can touch; each end is filled up with ``q - 1`` marks."""
    return max(1, most * q + 2 - q)


def _grams(texts: Sequence[str], q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the q-grams of all texts, their places, and the text of each."""
    codes, begin = code_points(texts)
    size = np.diff(begin)
    padded = np.zeros(len(codes) + 2 * (q - 1) * len(size), np.uint64)  # 0 stands before, 1 behind
    start = begin[:-1] + 2 * (q - 1) * np.arange(len(size))
    owner = np.repeat(np.arange(len(size)), size + 2 * (q - 1))
    place = np.arange(len(padded)) - start[owner]
    padded[place >= size[owner] + q - 1] = 1
    inside = (place >= q - 1) & (place < size[owner] + q - 1)
    padded[inside] = codes.astype(np.uint64) + np.uint64(2)
    first = place < size[owner] + q - 1
    value = np.zeros(len(padded), np.uint64)
    for i in range(q):
        value[: len(padded) - i] = value[: len(padded) - i] * np.uint64(0x9E3779B97F4A7C15) + padded[i:]
        value ^= value >> np.uint64(31)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(29)
    return value[first].view(np.int64), place[first], owner[first]


def gram_counts(classes: DataFrame, text: str, q: int) -> np.ndarray:
    """How often q-grams of each hash bucket occur; ``BUCKETS`` numbers, whatever the table's size."""

    def count(batches):
        sums = np.zeros(BUCKETS, np.int64)
        for batch in small_slices(batches, text):
            grams, _, _ = _grams(batch.column(0).to_pylist(), q)
            sums += np.bincount(grams % BUCKETS, minlength=BUCKETS)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["bucket", "c"])

    found = classes.select(text).mapInArrow(count, "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c")).collect()
    counts = np.zeros(BUCKETS, np.int64)
    for row in found:
        counts[row["bucket"]] = row["c"]
    return counts


def _prefixes(classes: DataFrame, text: str, most: int, q: int) -> DataFrame:
    """Classes with their ``most * q + 1`` rarest q-grams, ``grams`` and ``places``, in one order for all strings.

    Two strings within ``most`` edits share one of these at places at most ``most`` apart:
    an edit touches q grams, so each keeps one of its own, and of equal grams the first
    that both keep is the same one.
    """
    held = classes.sparkSession.sparkContext.broadcast(gram_counts(classes, text, q))
    keep, shortest = most * q + 1, shortest_indexed(most, q)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.schema) + ", grams array<long>, places array<int>"

    def prefix(batches):
        for batch in small_slices(batches, text):
            grams, places, owner = _grams(batch.column(text).to_pylist(), q)
            order = np.lexsort((places, grams, held.value[grams % BUCKETS], owner))
            grams, places, owner = grams[order], places[order], owner[order]
            rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
            long = np.bincount(owner, minlength=batch.num_rows) - (q - 1) >= shortest
            first = (rank < keep) & long[owner]
            ends = pa.array(np.searchsorted(owner[first], np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(v[first], kind)) for v, kind in ((grams, pa.int64()), (places, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*batch.schema.names, "grams", "places"])

    return classes.mapInArrow(prefix, ddl)


def _key_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Rows of one key after the other, from batches sorted by the keys."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        other = np.zeros(batch.num_rows - 1, bool)
        for key in keys:
            c = batch.column(key)
            other |= np.asarray(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)))
        cuts = [0, *(np.flatnonzero(other) + 1), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            part = batch.slice(lo, hi - lo)
            if kept and any(kept[-1].column(k)[0] != part.column(k)[0] for k in keys):
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(part)
    if kept:
        yield pa.Table.from_batches(kept)


def _in_pieces(rows: DataFrame, keys: list[str], identity: list[str], limit: int) -> DataFrame:
    """Rows dealt to groups ``keys, i, j`` of at most about ``limit`` rows, in which every two rows of a key meet once.

    A key of few rows is one group. The rows of a larger key go to pieces by hash, and
    each piece meets each other; ``piece`` is the row's own.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > limit)
    pieces = sizes.select(*keys, F.ceil(F.col("_c") / (limit // 2)).cast("int").alias("_pieces"))
    found = rows.join(broadcast_if_small(pieces), keys, "left").withColumn("_pieces", F.coalesce("_pieces", F.lit(1)))
    placed = found.withColumn("piece", F.pmod(F.xxhash64(*identity), F.col("_pieces")).cast("int"))
    met = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)))
    return met.withColumns({"i": F.least("piece", "_other"), "j": F.greatest("piece", "_other")}).drop("_pieces", "_other")


def _pairs(size: np.ndarray, piece: np.ndarray, i: int, j: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of a group whose lengths (ascending) differ by at most ``most``, some at a time."""
    until = np.searchsorted(size, size + most, "right")
    width = until - np.arange(len(size)) - 1
    for lo, hi in _chunks(width, AT_ONCE):
        left = np.repeat(np.arange(lo, hi), width[lo:hi])
        right = left + 1 + np.arange(len(left)) - np.repeat(np.r_[0, np.cumsum(width[lo:hi])[:-1]], width[lo:hi])
        if i != j:
            across = piece[left] != piece[right]
            left, right = left[across], right[across]
        if len(left):
            yield left, right


def _chunks(width: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    ends, lo = np.cumsum(width), 0
    while lo < len(width):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield lo, hi
        lo = hi


def _padded_chunks(width: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of ascending widths whose number times the last width is at most ``limit``, or of one."""
    lo = 0
    while lo < len(width):
        hi = min(len(width), lo + max(1, limit // max(1, int(width[lo]))))
        fits = np.arange(1, hi - lo + 1) * width[lo:hi] <= limit
        hi = lo + max(1, int(fits.sum()))  # the product ascends
        yield lo, hi
        lo = hi


def _links_of(table: pa.Table, text: str, most: int, allowed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a group within ``most`` edits, once each, and their distances; ``allowed`` filters pairs of rows first."""
    texts = table.column(text).to_pylist()
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(size, kind="stable")
    piece = table.column("piece").to_numpy()[order]
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    out = []
    for left, right in _pairs(size[order], piece, i, j, most):
        left, right = order[left], order[right]
        fits = allowed(left, right)
        left, right = left[fits], right[fits]
        wider = np.argsort(size[right], kind="stable")  # pairs of about one length, as all are filled up to the longest
        left, right = left[wider], right[wider]
        for lo, hi in _padded_chunks(size[right], AT_ONCE * 16):
            x, y = left[lo:hi], right[lo:hi]
            rows, which = np.unique(np.concatenate([x, y]), return_inverse=True)
            codes, _ = code_rows([texts[k] for k in rows])
            distance = edit_distances(codes[which[: len(x)]], size[x], codes[which[len(x) :]], size[y], most)
            near = (distance <= most) & (distance > 0)
            out.append((x[near], y[near], distance[near]))
    return tuple(np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out) if out else ((), (), ())))


def _link_table(table: pa.Table, block: Sequence[str], text: str, a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> pa.Table:
    """``block, a, b, n_a, n_b, distance`` with the smaller text first, each pair once."""
    x, y = table.column(text).take(a), table.column(text).take(b)
    swap = np.array([p > q for p, q in zip(x.to_pylist(), y.to_pylist())], bool)
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    out = {k: table.column(k).take(a) for k in block}
    out |= {"a": table.column(text).take(a), "b": table.column(text).take(b)}
    out |= {"n_a": table.column("n").take(a), "n_b": table.column("n").take(b), "distance": pa.array(distance, pa.int32())}
    found = pa.table(out)
    return found.group_by(found.column_names).aggregate([])


def _run_groups(rows: DataFrame, keys: list[str], ddl: str, work) -> DataFrame:
    """``work(table)`` for every group of equal keys, in tasks that each hold one group at a time."""
    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], ddl).schema)

    def run(batches):
        for group in _key_groups(batches, keys):
            if group.num_rows > 1:
                yield from work(group.combine_chunks()).cast(schema).to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, ddl)


def similar_strings(
    df: DataFrame, text: str, most: int, block: Sequence[str] = (), q: int = 2, limit: int = 4000
) -> DataFrame:
    """Pairs of different strings within ``most`` edits, inside blocks of equal ``block`` columns: exact.

    Returns ``block columns, a, b, n_a, n_b, distance`` with ``a < b``; ``n_a`` and ``n_b``
    are the rows that hold each. Rows without a text or block value are left out.
    Strings shorter than ``shortest_indexed`` meet the strings that are at most ``most``
    longer by what is left of both after deletions.
    """
    if most < 1 or q < 1:
        raise ValueError("most and q must be at least 1")
    block = list(block)
    classes = written_once(value_classes(df, block, [text]), "strings")
    kinds = {f.name: f.dataType.simpleString() for f in classes.schema}
    ddl = ", ".join([*[f"`{k}` {kinds[k]}" for k in block], "a string, b string, n_a long, n_b long, distance int"])
    shortest = shortest_indexed(most, q)

    prefixed = written_once(_prefixes(classes, text, most, q).filter(F.size("grams") > 0), "gram-prefixes")
    at = F.explode(F.arrays_zip("grams", "places"))
    postings = prefixed.withColumn("_at", at).withColumns({"gram": F.col("_at.grams"), "place": F.col("_at.places")}).drop("_at")
    dealt = _in_pieces(postings, [*block, "gram"], [text], limit)

    def by_gram(table: pa.Table) -> pa.Table:
        gram, place = table.column("gram")[0].as_py(), table.column("place").to_numpy()
        grams = np.asarray(table.column("grams").combine_chunks().flatten()).reshape(table.num_rows, -1)
        places = np.asarray(table.column("places").combine_chunks().flatten()).reshape(table.num_rows, -1)

        def first_met_here(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            fits = abs(place[a] - place[b]) <= most
            a, b = a[fits], b[fits]
            both = (grams[a][:, :, None] == grams[b][:, None, :]) & (abs(places[a][:, :, None] - places[b][:, None, :]) <= most)
            first = both.any(axis=2).argmax(axis=1)  # other tasks leave this pair to the first gram they share
            fits[fits] = grams[a, first] == gram
            return fits

        return _link_table(table, block, text, *_links_of(table, text, most, first_met_here))

    indexed = _run_groups(dealt, [*block, "gram", "i", "j"], ddl, by_gram)

    small = classes.filter(F.length(text) < shortest + most).select(*block, text, "n", F.explode(_left_after(text, most)).alias("rest"))
    short = _in_pieces(small, [*block, "rest"], [text], limit)

    def by_rest(table: pa.Table) -> pa.Table:
        size = np.array([len(t) for t in table.column(text).to_pylist()])
        return _link_table(table, block, text, *_links_of(table, text, most, lambda a, b: (size[a] < shortest) | (size[b] < shortest)))

    met = _run_groups(short, [*block, "rest", "i", "j"], ddl, by_rest).distinct()
    return indexed.unionAll(met)


def _left_after(text: str, most: int) -> Column:
    """All strings that up to ``most`` deletions leave of a short text."""

    @F.udf("array<string>", useArrow=True)
    def left(value: str) -> list[str]:
        return sorted({"".join(value[i] for i in kept) for d in range(min(most, len(value)) + 1) for kept in combinations(range(len(value)), len(value) - d)})

    return left(F.col(text))


def _upper_bounds(values: Sequence[str]):
    """For a column of a group: function of (rows a, rows b) that bounds their Jaro-Winkler similarity from above.

    Matched characters are at most those that both hold, counted in 32 classes of
    characters; the common beginning is taken as it is.
    """
    codes, size = code_rows(values)
    inside = np.arange(codes.shape[1]) < size[:, None]
    bags = np.stack([((codes % 32 == k) & inside).sum(axis=1) for k in range(32)], axis=1)
    head = np.where(inside, codes.astype(np.int64), -1 - np.arange(len(codes))[:, None])[:, :4]

    def bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = np.minimum(bags[a], bags[b]).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            jaro = np.where(both > 0, (both / size[a] + both / size[b] + 1) / 3, 0.0)
        same = np.cumprod(head[a] == head[b], axis=1).sum(axis=1)
        score = np.where(jaro > 0.7, jaro + 0.1 * same * (1 - jaro), jaro)
        return np.where((size[a] == 0) & (size[b] == 0), 1.0, score)

    return bound


def similar_records(df: DataFrame, block: Sequence[str], columns: Sequence[str], least: float, limit: int = 1024) -> DataFrame:
    """Pairs of different records of a block whose mean Jaro-Winkler similarity over ``columns`` is at least ``least``: exact.

    Records are classes of equal compared values. Returns ``block columns, <column>_a,
    <column>_b, n_a, n_b, score``. All pairs of a block are bounded from above by their
    lengths, characters and beginnings; the few that stay are scored. Blocks of more than
    ``limit`` classes are compared piece by piece. Rows without a block or compared value
    are left out.
    """
    block, columns = list(block), list(columns)
    if not block or not columns:
        raise ValueError("give block and compared columns")
    classes = written_once(value_classes(df, block, columns), "records")
    kinds = {f.name: f.dataType.simpleString() for f in classes.schema}
    names = [f"{c}_{side}" for side in "ab" for c in columns]
    ddl = ", ".join([*[f"`{k}` {kinds[k]}" for k in block], *[f"`{x}` string" for x in names], "n_a long, n_b long, score double"])
    dealt = _in_pieces(classes, block, columns, limit)

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in columns])
        values = {c: table.column(c).to_pylist() for c in columns}
        bounds = [_upper_bounds(v) for v in values.values()]
        piece = table.column("piece").to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        lefts, rights, scores = [], [], []
        for a, b in _pairs(np.zeros(table.num_rows, np.int64), piece, i, j, 0):
            stay = sum(bound(a, b) for bound in bounds) / len(columns) >= least - 1e-9
            a, b = a[stay], b[stay]
            if len(a):
                score = sum(_scores(values[c], a, b) for c in columns) / len(columns)
                near = score >= least - 1e-9
                lefts.append(a[near])
                rights.append(b[near])
                scores.append(score[near])
        a, b, score = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (lefts, rights, scores))
        out = {k: table.column(k).take(a) for k in block}
        out |= {f"{c}_a": table.column(c).take(a) for c in columns} | {f"{c}_b": table.column(c).take(b) for c in columns}
        return pa.table(out | {"n_a": table.column("n").take(a), "n_b": table.column("n").take(b), "score": pa.array(score, pa.float64())})

    return _run_groups(dealt, [*block, "i", "j"], ddl, compare)


def _scores(values: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaro-Winkler similarities; each distinct pair of values is compared once."""
    pairs, which = np.unique(np.stack(np.unique(values, return_inverse=True)[1][np.stack([a, b])], axis=1), axis=0, return_inverse=True)
    kinds = np.unique(values).tolist()
    return jaro_winkler_scores([kinds[x] for x in pairs[:, 0]], [kinds[y] for y in pairs[:, 1]])[which.ravel()]


def resolved(df: DataFrame, record: str, block: Sequence[str], columns: Sequence[str], least: float) -> DataFrame:
    """``record, group``: records connected by equal values or by ``similar_records``; group is the smallest record.

    Records without a block or compared value are their own group. Links connect one
    record of each class, so copies cost nothing in the iteration.
    """
    block, columns = list(block), list(columns)
    every = [*block, *columns]
    rows = written_once(df.select(record, *every), "records-to-resolve")
    first = written_once(rows.dropna(subset=every).groupBy(*every).agg(F.min(record).alias("first")), "first-records")
    side = lambda s: first.select(*block, *[F.col(c).alias(f"{c}_{s}") for c in columns], F.col("first").alias(s))
    links = similar_records(rows, block, columns, least)
    for s in "ab":
        links = links.join(side(s), [*block, *[f"{c}_{s}" for c in columns]])
    ends = F.explode(F.array("a", "b")).alias("first")
    members = links.select(ends, F.struct("a", "b").alias("link"))
    groups = connected_groups(members, "first", "link")
    known = first.join(groups, "first", "left")
    found = known.select(*every, F.coalesce("group", "first").alias("group"))
    return rows.join(written_once(found, "resolved"), every, "left").select(record, F.coalesce("group", F.col(record)).alias("group"))
