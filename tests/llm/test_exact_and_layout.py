"""Exact dedup, sharding and mixing against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from foreglass.llm import exact_dedup, mixing, sharding

BLANKS = " \t\n\x0b\x0c\r"
# Extra columns have the names that operators use inside.
SCHEMA = "doc_id long, text string, source string, label string, key long, size string, uid string, n string, body string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "z", "w", "v") for r in rows], SCHEMA)


def some_rows(seed=1, n=120):
    rnd = random.Random(seed)
    long = "".join(rnd.choice("ab ") for _ in range(40_000))
    rows = [(i, "".join(rnd.choice("ab \n") for _ in range(rnd.choice([0, 1, 3, 6]))), rnd.choice(["s", "t", "é", None])) for i in range(n)]
    rows += [(1000, long, "s"), (1001, long + " ", "t"), (1002, long + "a", "s"), (1003, long[:-1] + "é", "s"), (1004, long, "s")]
    rows += [(2000 + i, "copy of one text", "hot") for i in range(90)]
    rows += [(None, "copy of one text", None), (None, None, None), (5, None, "s"), (7, "twice", "s"), (7, "twice", "s"), (8, " \t ", "s")]
    return rows


def bare(text):
    return "".join(c for c in text or "" if c not in BLANKS)


def test_exact_groups(spark):
    rows = some_rows()
    found = exact_dedup.exact_groups(frame(spark, rows), head=4, width=8, growth=4, widest=4096).collect()
    groups = defaultdict(list)
    for i, (doc, text, _) in enumerate(rows):
        groups[bare(text)].append((-len(text or ""), doc is None, doc or 0, i))
    expected = Counter()
    for text, members in groups.items():
        members.sort()
        for rank, (_, null, doc, _) in enumerate(members):
            keep = None if members[0][1] else members[0][2]
            expected[(None if null else doc, keep, len(members), rank == 0, hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((r.id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found) == expected


def test_exact_groups_of_nothing(spark):
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0


def best_capacity(sizes, shards):
    """Least largest run over all contiguous cuts, by dynamic programming."""
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        nxt = [0] + [float("inf")] * len(sizes)
        for end in range(1, len(sizes) + 1):
            total = 0
            for start in range(end - 1, -1, -1):
                total += sizes[start]
                nxt[end] = min(nxt[end], max(best[start], total))
        best = nxt
    return best[-1]


@pytest.mark.parametrize("shards", [1, 3, 7])
def test_smallest_capacity_and_even_cuts(shards):
    rnd = random.Random(shards)
    for _ in range(30):
        sizes = [rnd.choice([1, 2, 5, 40]) for _ in range(rnd.randint(1, 25))]
        sums = [0]
        for s in sizes:
            sums.append(sums[-1] + s)
        capacity = sharding.smallest_capacity(sums, max(sizes), shards)
        assert capacity == best_capacity(sizes, shards)
        cuts = [0, *sharding.even_cuts(sums, capacity, shards), len(sizes)]
        assert cuts == sorted(cuts)
        assert max(sums[b] - sums[a] for a, b in zip(cuts, cuts[1:])) <= capacity


@pytest.mark.parametrize("first_bits", [2, 16])
def test_shards(spark, monkeypatch, first_bits):
    monkeypatch.setattr(sharding, "FIRST_BITS", first_bits)
    rows = some_rows(n=400)
    found = sharding.shard_documents(frame(spark, rows), shards=5).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r.id, r.size, r.text_crc32) for r in found) == Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t, _ in rows)
    homes, slots = defaultdict(set), defaultdict(list)
    for r in found:
        homes[r.text_crc32].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in homes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(5))


def test_shards_are_minimax_at_any_resolution(spark, monkeypatch):
    rows = [(i, f"text {i} " + "x" * (i * 7 % 50), "s") for i in range(300)]
    largest = []
    for bits in (1, 4, 16):
        monkeypatch.setattr(sharding, "FIRST_BITS", bits)
        sums = Counter()
        keyed = sharding.shard_documents(frame(spark, rows), shards=6).collect()
        for r in keyed:
            sums[r.shard] += r.size
        largest.append(max(sums.values()))
    assert len(set(largest)) == 1


def test_shards_of_nothing(spark):
    assert sharding.shard_documents(frame(spark, []), shards=4).count() == 0


def targets(sizes, weights=(5, 2, 1)):
    """Share by weight, cut at three times the size, reshare, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        others = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[o] for o in others) for s in others}
        above = {s for s in others if share[s] > 3 * sizes[s]}
        if not above:
            return {**share, **{s: 3.0 * sizes[s] for s in full}}
        full |= above


def test_mix(spark):
    rows = some_rows(n=300) + [(9000 + i, "one two three four five " * 20, "big") for i in range(40)]
    found = mixing.mix_sources(frame(spark, rows)).collect()
    again = mixing.mix_sources(frame(spark, rows[::-1])).collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, again))
    words = lambda t: len([w for w in (t or "").translate({ord(c): " " for c in BLANKS}).split(" ") if w])
    assert Counter((r.id, r.source, r["size"]) for r in found) == Counter((d, s, words(t)) for d, t, s in rows)
    sizes, taken = Counter(), Counter()
    for d, t, s in rows:
        sizes[s] += words(t)
    goal = targets(dict(sizes))
    for r in found:
        taken[r.source] += r.taken
        assert r.taken <= 3 * r["size"] and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(goal[r.source])
    for s in goal:
        assert abs(taken[s] - goal[s]) <= 0.5


def test_mix_of_nothing(spark):
    assert mixing.mix_sources(frame(spark, [])).count() == 0
    blank = frame(spark, [(1, None, "s"), (2, "", None)])
    assert [(r.taken, r.copies, r.target) for r in mixing.mix_sources(blank).collect()] == [(0, 0, 0.0)] * 2


@pytest.mark.parametrize("operator", [exact_dedup.exact_groups, sharding.shard_documents, mixing.mix_sources])
def test_plans_stay_in_the_engine(spark, operator):
    plan = operator(frame(spark, some_rows(n=20)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
