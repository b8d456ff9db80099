"""Contiguous shards of near equal bytes, with columns and SQL functions only."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F, Window

from foreglass.scale import written_once

KEY_BITS = 60
FIRST_BITS = 16
MORE_BITS = 6


class Atom(NamedTuple):
    """A range of the group order: one group, or several not looked into."""

    low: int
    bits: int  # low bits that the range leaves open
    size: int
    rows: int
    single: bool


def greedy(sums: list[int], capacity: int, shards: int) -> list[int] | None:
    """Fill shards from the left; the index after each, or None if they don't suffice."""
    ends, at = [], 0
    while at < len(sums) - 1:
        end = bisect_right(sums, sums[at] + capacity) - 1
        if end == at or len(ends) == shards:
            return None
        ends.append(end)
        at = end
    return ends


def smallest_capacity(sums: list[int], largest: int, shards: int) -> int:
    """Binary search for the least capacity at which greedy filling needs at most ``shards``."""
    total = sums[-1]
    low = max(largest, -(-total // shards))
    high = max(low, -(-total // shards) + largest)  # every full shard holds more than the mean here
    while low < high:
        middle = (low + high) // 2
        if greedy(sums, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def open_ranges(atoms: list[Atom], capacity: int, shards: int) -> list[Atom]:
    """Ranges of several groups in which a cut may fall at a capacity the search has not ruled out."""
    sums = [0, *accumulate(a.size for a in atoms)]
    least = max([-(-sums[-1] // shards), *(a.size for a in atoms if a.single)])
    if least >= capacity:
        return []
    found, at = set(), 0
    for i in range(1, shards):
        at = max(at, bisect_right(sums, sums[at] + least) - 1)  # no cut at `least` comes earlier
        late = bisect_left(sums, min(sums[-1], i * capacity))  # none at `capacity` comes later
        found.update(range(at, min(late, len(atoms))))
    return [a for k, a in enumerate(atoms) if k in found and not a.single]


def even_cuts(sums: list[int], capacity: int, shards: int) -> list[int]:
    """Cuts within ``capacity``, each as near to an even share of what is left as can be."""
    latest = [len(sums) - 1]
    for _ in range(shards - 1):
        latest.append(bisect_left(sums, sums[latest[-1]] - capacity))
    cuts, at = [], 0
    for left in range(shards, 1, -1):
        low, high = max(at, latest[left - 1]), bisect_right(sums, sums[at] + capacity) - 1
        goal = sums[at] + (sums[-1] - sums[at]) / left
        near = bisect_left(sums, goal)
        if near > 0 and near < len(sums) and goal - sums[near - 1] <= sums[near] - goal:
            near -= 1
        at = min(max(near, low), high)
        cuts.append(at)
    return cuts


def _atoms(rows: DataFrame, bits: int, within: list[Atom] | None = None) -> list[Atom]:
    """Sums per range of ``2**bits`` keys, in order; at most a few ten thousand."""
    if within is not None:
        wide = within[0].bits
        rows = rows.filter(F.shiftright("key", wide).isin([a.low >> wide for a in within]))
    found = rows.groupBy(F.shiftright("key", bits).alias("k")).agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"), (F.min("key") == F.max("key")).alias("single")
    )
    return sorted(Atom(r["k"] << bits, bits, r["size"], r["rows"], r["single"]) for r in found.collect())


def _plan(rows: DataFrame, shards: int) -> tuple[list[int], list[Atom], int]:
    """First keys of shards 1, 2, ..; ranges with a shard of their own; most rows in a shard."""
    bits = KEY_BITS - FIRST_BITS
    atoms = _atoms(rows, bits)
    while True:
        hot, left, total = [], shards, sum(a.size for a in atoms)
        for a in sorted(atoms, key=lambda a: -a.size):
            if left == 1 or a.size * left <= total:
                break
            hot.append(a)
            left, total = left - 1, total - a.size
        aside = set(hot)
        rest = [a for a in atoms if a not in aside]
        sums = [0, *accumulate(a.size for a in rest)]
        largest = max([0, *(a.size for a in rest)])
        capacity = smallest_capacity(sums, largest, left) if rest else 0
        unclear = [a for a in hot if not a.single] or (open_ranges(rest, capacity, left) if rest else [])
        unclear = [a for a in unclear if a.bits == max(x.bits for x in unclear)]
        if not unclear or unclear[0].bits == 0:
            break
        seen = set(unclear)
        atoms = sorted([a for a in atoms if a not in seen] + _atoms(rows, max(0, unclear[0].bits - MORE_BITS), unclear))
    cuts = even_cuts(sums, capacity, left) if rest else []
    starts = [rest[c].low if c < len(rest) else 1 << KEY_BITS for c in cuts]
    counts = [0, *accumulate(a.rows for a in rest)]
    edges = [0, *cuts, len(rest)]
    most = max([1, *(a.rows for a in hot), *(counts[b] - counts[a] for a, b in zip(edges, edges[1:]))])
    return starts, hot, most


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", extra_bytes: int = 16) -> DataFrame:
    """Cut the ordered groups of equal texts into ``shards`` runs with the least possible largest run.

    Groups are ordered by a 60-bit hash of the text, so equal texts share a key and a
    shard. Spark sums sizes per key range; the driver binary-searches the smallest
    capacity that greedy filling can meet, over at most a few ten thousand sums. Ranges
    in which a cut could still move are summed again in finer ranges until every cut
    lies between two groups, so the capacity is exact while the driver never sees more
    than ``2**16`` sums plus the open ranges. A group above the mean shard takes a shard
    of its own, numbered last, and the rest is shared among the others.

    Slots number the rows of a shard without gaps: rows are numbered per (shard, hash
    bucket of the row) and offset by the counts of earlier buckets, with about as many
    buckets as a bucket has rows, so neither a hot shard nor the summary fills one task.

    Returns ``id, size, text_crc32, shard, slot``. Null text has no bytes; a null id is
    an id like others. Repeated rows get a slot each. An empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written_once(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + extra_bytes).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(text), 64 - KEY_BITS).alias("key"),
        ),
        "sizes",
    )
    starts, hot, most = _plan(rows, shards)
    shard: Column = F.lit(0)
    for first in starts:
        shard = shard + (F.col("key") >= F.lit(first).cast("long")).cast("int")
    for i, own in enumerate(hot):
        inside = F.shiftright("key", own.bits) == F.lit(own.low >> own.bits).cast("long")
        shard = F.when(inside, shards - len(hot) + i).otherwise(shard)
    buckets = math.isqrt(most) + 1
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("part", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(buckets)))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "text_crc32"))
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return (
        placed.withColumn("inside", inside)
        .join(offsets, ["shard", "part"])
        .select("id", "size", "text_crc32", "shard", (F.col("before") + F.col("inside") - 1).alias("slot"))
    )
