"""Work inside tasks is bounded by bytes, not by the rows that Arrow puts into a batch."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from foreglass.functions import text as X
from foreglass.operators import features as T, learn as L, sequence as Q, similar as S, tagging as H, tokens as K
from foreglass.scale import looked_up, small_slices


def test_shares_of_texts_beyond_the_vocabulary(spark):
    common = [(i, ["oil", "gas"]) for i in range(20)]
    rows = [*common, (20, ["rare"]), (21, ["rarer", "rarest"]), (22, []), (23, None)]
    words = spark.createDataFrame(rows, "doc_id int, words array<string>")
    found = {r["doc_id"]: sum(r["topics"]) for r in L.topics(words, "words", 2, vocabulary=2, rounds=2).collect()}
    assert len(found) == 24 and all(abs(found[i] - 1) < 1e-6 for i in range(22)) and found[22] == found[23] == 0


def test_pairs_of_very_different_lengths_are_not_filled_up_together(monkeypatch):
    texts = ["a" * 30 + f"{i:06d}" for i in range(400)] + ["b" * 40_000 + x for x in ("x", "y")]
    table = pa.table({"t": texts, "piece": np.zeros(len(texts), np.int32), "i": [0] * len(texts), "j": [0] * len(texts)})
    cells, plain = [], S.edit_distances

    def watched(a, *rest):
        cells.append(a.size)
        return plain(a, *rest)

    monkeypatch.setattr(S, "edit_distances", watched)
    a, b, distance = S._links_of(table, "t", 1, lambda a, b: np.ones(len(a), bool))
    found = {tuple(sorted((texts[x], texts[y]))) for x, y in zip(a, b)}
    near = lambda x, y: sum(p != q for p, q in zip(x[-6:], y[-6:])) == 1
    assert found == {(x, y) for x in texts for y in texts if x < y and len(x) == len(y) and near(x, y)}
    assert max(cells) <= S.AT_ONCE * 16


def test_slices_hold_all_rows_and_few_values():
    rnd = np.random.default_rng(0)
    lists = [None if i % 7 == 0 else ["w"] * int(n) for i, n in enumerate(rnd.integers(0, 50, 300))]
    texts = [None if x is None else "é" * len(x) for x in lists]
    batch = pa.RecordBatch.from_pydict({"i": list(range(300)), "l": pa.array(lists, pa.list_(pa.string())), "t": texts})
    for column, width in (("l", 1), ("t", 2)):
        parts = list(small_slices(iter([batch, batch.slice(0, 0)]), column, 100))
        assert [x for p in parts for x in p.column("i").to_pylist()] == list(range(300))
        sizes = [sum(width * len(x or ()) + 1 for x in p.column(column).to_pylist()) for p in parts]
        assert len(parts) > 50 and all(s <= 101 or p.num_rows == 1 for s, p in zip(sizes, parts))


def test_large_tables_are_looked_up_by_chunks_of_rows(spark):
    lists = [(i, [f"w{(i * k) % 41}" for k in range(i % 9)] if i % 10 else None) for i in range(200)]
    rows = spark.createDataFrame(lists, "i int, ws array<string>").repartition(3)
    table = spark.createDataFrame([(f"w{k}", k) for k in range(0, 41, 2)], "w string, n long")

    def work(part, found):
        n = dict(zip(found.column("w").to_pylist(), found.column("n").to_pylist()))
        sums = [sum(n.get(w, 0) for w in ws or ()) for ws in part.column("ws").to_pylist()]
        return pa.table({"i": part.column("i"), "s": pa.array(sums, pa.int64()), "most": pa.array([part.num_rows] * len(sums), pa.int64())})

    got = looked_up(rows, "ws", "w", table, work, "i int, s long, most long", limit=20).collect()
    held = {f"w{k}": k for k in range(0, 41, 2)}
    assert {r["i"]: r["s"] for r in got} == {i: sum(held.get(w, 0) for w in ws or ()) for i, ws in lists}
    assert len(got) == 200 and max(r["most"] for r in got) <= 20


def test_vectors_and_scores_are_not_joined_to_single_words(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i + k) % 30}" for k in range(i % 12))) for i in range(90)], "d int, t string")
    counted = T.counted_terms(docs, "d", X.whitespace_tokens("t"))
    vectors = spark.createDataFrame([(f"w{k}", [float(k), 1.0]) for k in range(25)], "word string, vector array<float>")
    ask = lambda: {r["d"]: [round(x, 9) for x in r["vector"]] for r in T.pooled_vectors(counted, "d", vectors, 2, ["w3"]).collect()}
    direct = ask()
    monkeypatch.setattr(T, "BROADCAST_BYTES", 0)
    assert ask() == direct and len(direct) == 90
    plan = T.pooled_vectors(counted, "d", vectors, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Summarizer" not in plan and "CoGroup" in plan

    words = docs.select("d", X.whitespace_tokens("t").alias("words")).withColumn("tags", F.transform("words", lambda w: F.substring(w, 2, 1)))
    spread = words.select(F.explode(F.arrays_zip("words", "tags")).alias("t")).select(F.col("t.words").alias("word"), F.col("t.tags").alias("tag"))
    steps, emissions = H.transitions_of_arrays(words), H.emission_table(spread, threshold=20)
    for method in H.DECODERS:
        found = [{r["d"]: r["predicted"] for r in H.decoded_arrays(words, ["d"], steps, emissions, method, b).collect()} for b in (0, 1 << 20)]
        assert found[0] == found[1] and len(found[0]) == 82
    tokens = words.select("d", F.posexplode("tags").alias("pos", "tag"))
    exact = H.tag_accuracy(H.decode(words, ["d"], steps, emissions, max_bytes=0), tokens, ["d"]).first()
    arrays = H.array_accuracy(H.decoded_arrays(words, ["tags"], steps, emissions, max_bytes=0)).first()
    assert exact["tokens"] == arrays["tokens"] and abs(exact["accuracy"] - arrays["accuracy"]) < 1e-12


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_labels_and_arrays_are_made_inside_rows(spark):
    texts = [(3, "aa bbbb aa cccccccc"), (1, "bbbb aa bbbb dddddddd eeeeeeee"), (2, ""), (4, None), (7, "aa")]
    docs = spark.createDataFrame(texts, "d int, t string").repartition(3)
    of = lambda w: F.when(F.length(w) > 7, "LONG").when(F.length(w) > 3, "MID").otherwise("SHORT")
    rows = docs.select("d", X.whitespace_tokens("t").alias("words")).withColumn("labels", F.transform("words", of))
    tokens = K.word_rows(docs, ["d"], "t").withColumn("label", of("word"))

    wanted = ["LONG_1", "LONG_2", "MID_1", "SHORT_1"]
    wide = Q.wide_labels_of_arrays(rows, "d", "words", "labels", wanted)
    per = Q.wide_labels(docs, Q.numbered_labels(tokens, "label", ["pos"], per=["d"]), "d", wanted, "word")
    assert sorted(wide.collect(), key=lambda r: r["d"]) == sorted(per.collect(), key=lambda r: r["d"])
    assert shuffles(wide) == 0 < shuffles(per)

    one = K.sentences(docs, "d", "t")
    keys = ["d", "sentence_no"]
    arrays = K.sentence_arrays(one, keys, "sentence", {"labels": of})
    again = K.tokens_to_arrays(K.word_rows(one, keys, "sentence").withColumn("label", of("word")), keys, ["word", "label"])
    assert sorted(map(tuple, arrays.collect())) == sorted(map(tuple, again.collect())) and shuffles(arrays) == 0 < shuffles(again)


def test_labels_are_numbered_over_all_from_arrays(spark):
    """As by tokens, also with documents without labels, missing documents and labels."""
    rows = [(3, ["B", "A", "B"]), (1, ["A", None, "A"]), (None, ["A", "C"]), (2, []), (4, None), (5, ["B"] * 70 + ["A"])]
    df = spark.createDataFrame(rows, "d long, labels array<string>")
    tokens = df.select("d", F.posexplode("labels").alias("pos", "label"))
    by_tokens = Q.numbered_labels(tokens, "label", ["d", "pos"]).select("d", "pos", "unique_label")
    found = Q.numbered_labels_of_arrays(df, "d", "labels")
    told = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert told(found) == told(by_tokens) and found.count() == 79
