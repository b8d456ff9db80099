"""The corpus pipeline, stage by stage and as a whole."""

import os
from collections import Counter

import pytest

import corpus_pipeline
from foreglass.llm import registry

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not there")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_registry_has_all_queries():
    assert {int(n[2:].split("_")[0]) for n in registry.queries() if n.startswith("op")} == set(range(1, 14))
    assert "pipeline" in registry.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near duplicates", "benchmark passages", "source weights", "shards"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], SMALL).cache())
    return frames


def test_columns(stages):
    assert all(f.columns == COLUMNS for f in stages[:-1])
    assert stages[-1].columns == ["doc_id", "size", "shard", "slot"]


def test_stages_only_take_rows_away(stages):
    for before, after in zip(stages[:3], stages[1:4]):
        gone = Counter(map(tuple, after.collect())) - Counter(map(tuple, before.collect()))
        assert not gone
        assert 0 < after.count() <= before.count()
    kept = {tuple(r) for r in stages[3].collect()}
    assert {tuple(r) for r in stages[4].collect()} <= kept
    assert max(Counter(r.doc_id for r in stages[4].collect()).values()) <= 3


def test_stage_decisions_match_their_operators(spark, stages):
    from foreglass.llm import decontaminate, near_dedup

    found = near_dedup.near_duplicates(stages[1], width=5)
    assert {r.id for r in found.filter("kept").collect()} == {r.doc_id for r in stages[2].collect()}
    hits = decontaminate.find_items(stages[2], spark.read.parquet(f"{SMALL}/benchmark.parquet")).filter("n_hit = 0")
    assert {r.id for r in hits.collect()} == {r.doc_id for r in stages[3].collect()}


def test_run_is_the_stages(spark, stages):
    assert Counter(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == Counter(map(tuple, stages[-1].collect()))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


def shingles(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c.lower() if c.isascii() else c for c in text or "").split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates_by_brute_force(stages):
    rows = sorted(stages[1].collect(), key=lambda r: r.doc_id)
    sets, group = [shingles(r.text) for r in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if both and 100 * both >= 80 * (len(a) + len(b) - both):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    assert Counter(map(tuple, stages[2].collect())) == Counter(tuple(r) for i, r in enumerate(rows) if group[i] == i)


def test_benchmark_passages_by_brute_force(spark, stages):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    windows = set()
    for row in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = words(row.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    clean = lambda w: not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    assert Counter(map(tuple, stages[3].collect())) == Counter(tuple(r) for r in stages[2].collect() if clean(words(r.text)))


def test_mix_and_shards_take_every_row(spark, stages):
    from foreglass.llm import mixing

    copies = {r.id: r.copies for r in mixing.mix_sources(stages[3]).collect()}
    assert Counter(r.doc_id for r in stages[4].collect()) == Counter({i: c for i, c in copies.items() if c})
    placed = stages[5].collect()
    size = lambda r: 16 + len((r.text or "").encode())
    assert Counter((r.doc_id, r["size"]) for r in placed) == Counter((r.doc_id, size(r)) for r in stages[4].collect())
    for shard in {r.shard for r in placed}:
        assert sorted(r.slot for r in placed if r.shard == shard) == list(range(sum(r.shard == shard for r in placed)))


LONG = "one text that has more than five words and comes again"
ODD = [
    (None, None, None, None, None), (1, None, None, None, 0), (1, "", "en", "s", 0), (2, "a b", None, None, None),
    (1, LONG, "en", "s", 1), (1, LONG, "en", "s", 1), (1, LONG, "de", "t", 1), (None, LONG, "en", "s", 1), (None, LONG, "en", "s", 1), (2, LONG, "en", "s", 1),
]


def test_near_duplicates_leave_one_row_of_each_group(spark):
    left = [tuple(r) for r in STAGES["near duplicates"](spark, spark.createDataFrame(ODD, SCHEMA), SMALL).collect()]
    assert Counter(left)[1, LONG, "en", "s", 1] + Counter(left)[1, LONG, "de", "t", 1] == 1
    assert Counter(r for r in left if r[1] != LONG) == Counter(ODD[:4])
    nameless = STAGES["near duplicates"](spark, spark.createDataFrame([r for r in ODD if r[0] is None], SCHEMA), SMALL).collect()
    assert Counter(r.text for r in nameless) == {None: 1, LONG: 1}


def test_mix_counts_rows_of_one_id_one_by_one(spark):
    rows = [(1, "word " * n, "en", "s", n) for n in range(1, 30)] + [(None, "other " * 5, "en", "t", 1)] * 3
    mixed = STAGES["source weights"](spark, spark.createDataFrame(rows, SCHEMA), SMALL).collect()
    taken = Counter(tuple(r) for r in mixed)
    assert not set(taken) - set(rows) and max(taken[r] for r in rows[:29]) <= 3 and taken[rows[-1]] <= 9
    words = {s: sum(len(r[1].split()) * n for r, n in taken.items() if r[3] == s) for s in "st"}
    assert abs(words["s"] - 405) < 30 and abs(words["t"] - 45) < 6  # t is full at three times its words


def test_other_stages_take_odd_rows(spark):
    odd = spark.createDataFrame(ODD, SCHEMA)
    assert Counter(map(tuple, STAGES["benchmark passages"](spark, odd, SMALL).collect())) == Counter(ODD)
    assert len(STAGES["shards"](spark, odd, SMALL).collect()) == len(ODD)
    good = Counter(map(tuple, STAGES["quality"](spark, odd, SMALL).collect()))
    assert all(good[r] in (0, Counter(ODD)[r]) for r in ODD) and not good - Counter(ODD)


def test_stages_take_empty_tables_and_clashing_names(spark):
    names = ["row", "doc", "copies", "_copies", "a.b"]
    wide = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in ODD], f"{SCHEMA}, " + ", ".join(f"`{n}` int" for n in names))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, wide.limit(0), SMALL).count() == 0, name
        found = stage(spark, wide, SMALL)
        assert found.columns == (wide.columns if name != "shards" else ["doc_id", "size", "shard", "slot"]), name
        assert set(map(tuple, found.collect())) <= set(map(tuple, wide.collect())) or name == "shards"
