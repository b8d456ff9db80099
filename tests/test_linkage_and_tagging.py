import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from foreglass.operators import linkage as L, tagging as H


def test_jaro_winkler_known_values():
    known = {("MARTHA", "MARHTA"): 0.961111, ("DWAYNE", "DUANE"): 0.84, ("DIXON", "DICKSONX"): 0.813333, ("a", "b"): 0.0}
    known |= {("", ""): 1.0, ("", "x"): 0.0, ("CRATE", "TRACE"): 0.733333}
    scores = L.jaro_winkler_scores([a for a, _ in known], [b for _, b in known])
    assert [round(float(s), 6) for s in scores] == list(known.values())


def test_jaro_winkler_matches_another_engine(spark):
    import random

    import duckdb

    rnd = random.Random(2)
    pairs = [tuple("".join(rnd.choice("abcdé ") for _ in range(rnd.randint(1, 14))) for _ in range(2)) for _ in range(500)]
    scores = L.jaro_winkler_scores([a for a, _ in pairs], [b for _, b in pairs])
    con = duckdb.connect()
    plain = [(a, b, s) for (a, b), s in zip(pairs, scores) if "é" not in a + b]  # the other engine counts bytes
    for a, b, s in plain:
        assert con.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0] == pytest.approx(s, abs=1e-9)


def test_neighbours_are_complete_for_small_blocks(spark):
    rows = [(i, "hot" if i < 40 else f"k{i % 5}", f"n{i * 7 % 50:02d}") for i in range(60)] + [(99, None, "x")]
    df = spark.createDataFrame(rows, "i bigint, k string, name string")
    got = {(r.anchor, r.i) for r in L.neighbour_pairs(df, "i", ["k"], ["name"], 4).collect()}
    want = set()
    for key in {k for _, k, _ in rows if k}:
        order = [i for _, i in sorted((n, i) for i, k, n in rows if k == key)]
        want |= {(order[x], order[y]) for y in range(len(order)) for x in range(max(0, y - 4), y)}
    assert got == want
    assert sum(1 for a, b in got if a >= 40) == 5 * 6  # four records a block: all six pairs


def test_links_join_the_same_records_as_pairs(spark):
    rows = [(1, "x", "p"), (2, "x", "q"), (3, "y", "q"), (4, "z", None), (5, None, "r"), (6, "z", "s"), (7, None, None)]
    df = spark.createDataFrame(rows, "i bigint, source string, target string")
    links = L.block_links(df, "i", ["source", "target"])
    assert sorted((r.key_name, r.anchor, r.i) for r in links.collect()) == [
        ("source", 1, 2), ("source", 4, 6), ("target", 2, 3),
    ]
    groups = L.connected_groups(L.key_members(df, "i", ["source", "target"]), "i", "key")
    assert {r.i: r.group for r in groups.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 4}
    counts = L.block_pair_counts(df, "i", ["source"])
    assert {r.key: r.pairs for r in counts.collect()} == {"x": 1, "y": 0, "z": 1}


def test_long_chain_and_hot_key(spark):
    chain = [(i, f"c{j}") for i in range(70) for j in (i, i + 1)]
    hot = [(1000 + i, "hot") for i in range(200)]
    groups = L.connected_groups(spark.createDataFrame(chain + hot, "i bigint, key string"), "i", "key")
    assert {(r.group, r["count"]) for r in groups.groupBy("group").count().collect()} == {(0, 70), (1000, 200)}


def test_string_columns(spark):
    df = spark.createDataFrame([(1, "Amazon", "k"), (2, "Amazin", "k"), (3, None, "k")], "i bigint, name string, k string")
    pairs = L.linked_values(L.block_links(df, "i", ["k"]), df, "i", ["name"])
    got = {r.i: r for r in L.name_distances(pairs, "name").collect()}
    assert (got[2].name_distance, got[2].phonetic_distance, got[2].phonetic_a) == (1, 0, "A525")
    scores = {r.i: r.s for r in pairs.select("i", L.string_similarity("name_a", "name_b").alias("s")).collect()}
    assert scores[2] == pytest.approx(0.933333, abs=1e-6) and scores[3] is None


TRAIN = [
    ("Ada says oil rises", "S O T O"), ("Bo says gas falls", "S O T O"), ("oil rises", "T O"), ("Ada rises Ada", "S O T"),
]


def model(spark, threshold=None):
    rows = [(i, p, w, t) for i, (ws, ts) in enumerate(TRAIN) for p, (w, t) in enumerate(zip(ws.split(), ts.split()))]
    tokens = spark.createDataFrame(rows, "sid bigint, pos int, word string, tag string")
    return H.transition_table(tokens, ["sid"]), H.emission_table(tokens, threshold), tokens


def test_counts(spark):
    steps, emissions, tokens = model(spark, threshold=1)
    got = {(r.from_tag, r.to_tag): (r.n, r.p) for r in steps.collect()}
    assert got[("<s>", "S")] == (3, 0.75) and got[("O", "T")] == (3, 1.0) and got[("S", "O")] == (3, 1.0)
    # Bo, gas and falls are seen once: they become the unknown mark
    found = {(r.tag, r.word): r.n for r in emissions.collect()}
    assert found[("S", H.UNKNOWN)] == 1 and found[("O", H.UNKNOWN)] == 1 and ("S", "Bo") not in found
    arrays = tokens.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("pos", "tag"))).getField("tag").alias("tags"))
    same = H.transitions_of_arrays(arrays)
    assert {tuple(r) for r in same.collect()} == {tuple(r) for r in steps.select(*same.columns).collect()}


@pytest.mark.parametrize("max_bytes", [1 << 20, 1])
def test_viterbi_is_the_best_of_all_paths(spark, max_bytes):
    steps, emissions, _ = model(spark)
    sentences = ["Ada says Ada rises", "falls", "zzz oil Bo Ada says", "rises rises oil"]
    df = spark.createDataFrame([(i, s.split()) for i, s in enumerate(sentences)] + [(9, [])], "sid bigint, words array<string>")
    got = {}
    decoded = H.decode(df, ["sid"], steps, emissions, "viterbi", max_bytes)
    for r in decoded.orderBy("sid", "pos").collect():
        got.setdefault(r.sid, []).append((r.word, r.predicted_tag))
    step = {(r.from_tag, r.to_tag): r.p for r in steps.collect()}
    emit = {(r.tag, r.word): r.p for r in emissions.collect()}
    tags = sorted({t for _, t in step})

    def score(words, path):
        total, before = 0.0, "<s>"
        for w, t in zip(words, path):
            total += np.log(step.get((before, t), 1e-9)) + np.log(emit.get((t, w), 1e-9))
            before = t
        return total

    assert set(got) == {0, 1, 2, 3}
    for i, s in enumerate(sentences):
        words = s.split()
        best = max(score(words, p) for p in itertools.product(tags, repeat=len(words)))
        assert [w for w, _ in got[i]] == words
        assert score(words, [t for _, t in got[i]]) == pytest.approx(best)


def test_greedy_and_accuracy(spark):
    steps, emissions, tokens = model(spark)
    sentences = tokens.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).getField("word").alias("words"))
    greedy = H.decode(sentences, ["sid"], steps, emissions, "greedy")
    assert H.tag_accuracy(greedy, tokens, ["sid"]).first()["accuracy"] == 1.0
    with pytest.raises(ValueError):
        H.decode(sentences, ["sid"], steps, emissions, "beam")


@pytest.mark.parametrize("max_bytes", [1 << 20, 1])
def test_equal_keys_stay_two_sentences(spark, max_bytes):
    steps, emissions, _ = model(spark)
    df = spark.createDataFrame([(1, ["oil", "rises"]), (1, ["gas", "falls"])], "sid bigint, words array<string>")
    decoded = H.decode(df, ["sid"], steps, emissions, "viterbi", max_bytes).collect()
    assert sorted((r.pos, r.word) for r in decoded) == [(0, "gas"), (0, "oil"), (1, "falls"), (1, "rises")]
