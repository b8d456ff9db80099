import pytest
from pyspark.sql import functions as F

from foreglass.operators import (
    evaluate as E,
    experiments as XP,
    graph as G,
    profile as P,
    relational as R,
    sampling as S,
    sequence as Q,
    tokens as K,
)


def test_null_handling_in_filters(spark):
    df = spark.createDataFrame([(1, "a", "a"), (2, None, "a"), (3, None, None)], "i int, x string, y string")
    assert [r.i for r in R.differs(df, "x", "a").collect()] == [2, 3]
    assert [r.i for r in R.columns_differ(df, "x", "y").collect()] == [2]
    assert [r.int_label for r in R.label_to_int(df, "x", "a").collect()] == [1, 0, 0]
    with pytest.raises(ValueError):
        R.require_columns(df, ["x", "nope"])
    with pytest.raises(ValueError):
        R.named_dataset(df, "robots")
    with pytest.raises(ValueError):
        R.named_dataset(df, "human")


def test_natural_join_matches_missing_keys(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (None, "q")], "k int, b string")
    assert sorted((r.a, r.b) for r in R.natural_join(a, b).collect()) == [("x", "p"), ("y", "q")]


def test_slot_pairs_and_alignment(spark):
    left = spark.createDataFrame([(i, "a" if i < 3 else "b") for i in range(5)], "l int, k string")
    right = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(10)], "r int, k string")
    grid = R.slot_pairs(left.drop("k"), right.drop("k"), "l", "r", per_left=4, heads=2)
    assert sorted((r.l, r.r) for r in grid.collect()) == [(a, b) for a in (0, 1) for b in range(4)]
    keyed = R.slot_pairs(left, right, "l", "r", per_left=2, key="k")
    assert sorted((r.l, r.r) for r in keyed.collect()) == [(0, 1), (0, 3), (1, 1), (1, 3), (2, 1), (2, 3), (3, 0), (3, 2), (4, 0), (4, 2)]
    one = left.withColumnRenamed("l", "row_id")
    assert R.alignment(one, one, ["k"]).first()["aligned"] is True
    assert R.alignment(one, one.filter("row_id > 0"), ["k"]).first()["different"] == 1


def test_attach_keeps_rows(spark):
    base = spark.createDataFrame([(1,), (2,)], "row_id int")
    out = spark.createDataFrame([(1, "m", 1), (1, "n", 0)], "row_id int, model string, prediction int")
    rows = {r["row_id"]: (r["m Prediction"], r["n Prediction"]) for r in R.attach_model_outputs(base, out, ["m", "n"]).collect()}
    assert rows == {1: (1, 0), 2: (None, None)}


def test_votes(spark):
    rows = [
        (1, 1, "prediction"), (1, 2, " prediction "), (1, 3, "neutral"),
        (2, 1, "a"), (2, 2, "b"),
        (3, 1, "a"), (3, 2, "b"), (3, 3, "a"), (3, 4, "b"),
        (4, 1, "a\n\nb"), (4, 2, "b"),
    ]
    df = spark.createDataFrame(rows, "s int, vote_pos int, reply string")
    votes = P.judge_votes(df, ["s"], "reply", ["vote_pos"])
    got = {r.s: r.majority_label for r in P.vote_verdicts(votes, ["s"], ["vote_pos"]).collect()}
    assert got == {1: "prediction", 2: P.ALL_DIFFERENT, 3: "b", 4: "b"}
    assert P.label_votes(votes, ["s"], ["vote_pos"]).count() == 12


def test_majority_of_columns(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 0, None), (None, None, None), (2, 2, 0)], "a int, b int, c int")
    assert [r[0] for r in df.select(P.majority_of_columns(["a", "b", "c"])).collect()] == [1, 0, None, 2]


def test_vocabulary(spark):
    words = spark.createDataFrame([(w,) for w in "a a a a b b b b b c c d".split()], "word string")
    got = P.thresholded_vocabulary(P.word_counts(words), 3).orderBy("index").collect()
    assert [(r.word, r["index"], r.n, r.n_types) for r in got] == [("< unk >", 0, 3, 2), ("b", 1, 5, 1), ("a", 2, 4, 1)]


def rated(spark):
    rows = [(1, 1, 1, 1, 0, 1), (2, 0, 0, 1, 1, None), (3, 1, 1, 1, 0, 1), (4, 0, 0, 1, 1, 0)]
    return spark.createDataFrame(rows, "row_id int, y int, perfect int, constant int, complement int, holes int")


def test_metrics(spark):
    models = ["perfect", "constant", "complement", "holes"]
    counts = E.outcome_counts(rated(spark), "y", models)
    got = {r.model: r for r in E.binary_metrics(counts).collect()}
    assert got["perfect"].f1 == 1 and got["complement"].accuracy == 0 and got["complement"].precision == 0
    assert got["constant"].recall == 1 and got["constant"].precision == 0.5
    assert got["holes"].accuracy == 0.75
    ratios = {r.model: r.misclassified for r in E.error_ratios(counts).collect()}
    assert ratios == {"perfect": 0, "constant": 0.5, "complement": 1, "holes": 0.25}
    area = {r.model: r.auc for r in E.auc(rated(spark), "y", models[:3], partitions=3).collect()}
    assert area == {"perfect": 1.0, "constant": 0.5, "complement": 0.0}
    summary = {r.model: r for r in E.evaluate_models(rated(spark), "y", models[:3]).collect()}
    assert summary["constant"].auc == 0.5 and summary["constant"].precision_class_0 == 0
    matrix = {(r.model, r.actual): (r.predicted_0, r.predicted_1) for r in E.confusion_matrix(counts, [0, 1]).collect()}
    assert matrix[("constant", 0)] == (0, 2) and matrix[("holes", 0)] == (1, 0)


def test_kappas(spark):
    df = rated(spark)
    got = {(r.model_1, r.model_2): r.kappa for r in E.cohens_kappa(df, ["y", "perfect", "complement"]).collect()}
    assert got[("y", "perfect")] == 1 and got[("y", "complement")] == -1
    assert E.cohens_kappa(df, ["y", "constant"]).first()["kappa"] == 0
    same = E.fleiss_kappa(df, ["y", "perfect"]).first()
    assert same["kappa"] == 1 and same["valid"] is True
    holes = E.fleiss_kappa(df, ["y", "holes"]).first()
    assert holes["valid"] is False and holes["kappa"] is None


def test_run_averages(spark):
    rows = [
        ("e1_imbalanced", 4, 0, "a", 0.8), ("e1_imbalanced", 42, 0, "a", 0.6), ("e1_imbalanced", 4, 1, "a", 0.9),
        ("e1_imbalanced", 4, 1, "b", 0.5), ("e1_imbalanced", 42, 0, "b", 0.5),
        ("e2_oversampled", 4, 0, "a", 0.7), ("e2_oversampled", 4, 0, "b", 0.7),
    ]
    runs = spark.createDataFrame(rows, "experiment string, seed int, version int, model string, accuracy double")
    newest = XP.latest_versions(runs, ["experiment", "seed"])
    assert newest.count() == 6
    averaged = {(r.experiment, r.model): r for r in XP.average_runs(newest, ["experiment"], ["accuracy"]).collect()}
    assert averaged[("e1_imbalanced", "a")].accuracy_mean == 0.75
    assert averaged[("e2_oversampled", "a")].accuracy_std is None
    assert abs(averaged[("e1_imbalanced", "mean_row")].accuracy_mean - 0.625) < 1e-12
    text = XP.mean_and_std_text(XP.average_runs(newest, ["experiment"], ["accuracy"]), ["experiment"], ["accuracy"])
    got = {(r.experiment, r.model): r.accuracy for r in text.collect()}
    assert got[("e1_imbalanced", "a")] == "0.7500 ± 0.2121" and got[("e2_oversampled", "b")] == "0.7000"
    means = spark.createDataFrame(
        [("imbalanced", "P", 0.8708), ("oversampled", "P", 0.8276), ("undersampled", "P", 0.7554)],
        "experiment string, model string, accuracy double",
    )
    row = XP.cross_dataset_margins(means, ["accuracy"]).first()
    # worked numbers: mean 0.8179, spread 0.0476 over the three sets
    assert round(row.accuracy_mean_across_datasets, 4) == 0.8179 and round(row.accuracy_margin, 4) == 0.1154
    tie = spark.createDataFrame([("x", "b", 0.5), ("x", "a", 0.5)], "experiment string, model string, accuracy double")
    assert (XP.accuracy_per_dataset(tie).first().best_model, XP.accuracy_per_dataset(tie).first().worst_model) == ("a", "a")


def test_sequences(spark):
    snippets = spark.createDataFrame(
        [("v", 2.0, "up. And"), ("v", 1.0, "Oil goes"), ("v", 3.0, "then.Down."), ("w", 0.0, "no stop")],
        "video string, start double, text string",
    )
    got = sorted((r.video, r.sentence_no, r.sentence) for r in Q.rebuilt_sentences(snippets, "video", ["start"], "text").collect())
    joined = "Oil goes up. And then.Down."
    assert [s for v, _, s in got if v == "v"] == joined.split(".")
    assert got[-1] == ("w", 0, "no stop")

    lines = spark.createDataFrame(
        [("f", 0, "a"), ("f", 1, "b"), ("f", 2, ""), ("f", 3, "c"), ("g", 0, ""), ("g", 1, "d")], "file string, line bigint, w string"
    )
    ids = Q.marker_rows_to_ids(lines, "file", "line", F.col("w") == "", partitions=2)
    assert sorted((r.file, r.w, r.sentence_no) for r in ids.collect()) == [("f", "a", 0), ("f", "b", 0), ("f", "c", 1), ("g", "d", 1)]

    series = spark.createDataFrame([("s", i, float(i)) for i in range(6)] + [("t", 0, 1.0)], "s string, t int, p double")
    windows = sorted((r.x, r.y) for r in Q.look_back_windows(series, ["s"], ["t"], "p", 3).collect())
    assert windows == [([0.0, 1.0, 2.0], 3.0), ([1.0, 2.0, 3.0], 4.0), ([2.0, 3.0, 4.0], 5.0)]
    tail = Q.tail_split(series, ["s"], ["t"], 2)
    assert sorted((r.s, r.t) for r in tail.filter("is_test").collect()) == [("s", 4), ("s", 5), ("t", 0)]

    words = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["x"]), (3, [])], "i int, w array<string>")
    pairs = Q.word_pairs(words, ["i"], "w")
    assert sorted((r.word_1, r.word_2) for r in pairs.collect()) == [("a", "b"), ("b", "a")]


def test_pair_counts_move_occurrences_once_and_spread_hot_pairs(spark, monkeypatch):
    from collections import Counter

    rows = [(i, ["a", "b"] * (i % 7) + [f"w{i % 5}", "é", "a"][: i % 4]) for i in range(300)] + [(300, []), (301, None)]
    words = spark.createDataFrame(rows, "i int, w array<string>")
    told = [(i, n, *pair) for i, ws in rows for n, pair in enumerate(zip(ws or [], (ws or [])[1:]))]
    counts = Counter(row[2:] for row in told)
    wanted = sorted((*row, counts[row[2:]]) for row in told)
    counted = Q.with_pair_counts(words, ["i"], "w").select("i", "pos", "word_1", "word_2", "n_pair")
    assert sorted(map(tuple, counted.collect())) == wanted
    plan = counted._jdf.queryExecution().sparkPlan().toString()
    whole = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and whole.count("Generate") == 1
    monkeypatch.setattr(Q, "LOOK", 0.5)
    monkeypatch.setattr(Q, "PAIRS_AT_ONCE", 40)  # "a b" and "b a" would fill a task
    spread = Q.with_pair_counts(words, ["i"], "w").select(counted.columns)
    assert sorted(map(tuple, spread.collect())) == wanted
    sizes = Counter(r[0] for r in spread.select(F.spark_partition_id()).collect())
    assert max(sizes.values()) < counts["a", "b"] / 4


def test_markov_chain(spark):
    days = [("u", i, s) for i, s in enumerate("SSRS")] + [("v", 0, "R")]
    df = spark.createDataFrame(days, "u string, t int, s string")
    steps = Q.transition_counts(df, ["u"], ["t"], "s")
    assert {(r.from_state, r.to_state): r.p for r in steps.collect()}[("<s>", "S")] == 0.5
    unknown = spark.createDataFrame([("u", 0, "R"), ("u", 1, "R")], "u string, t int, s string")
    row = Q.chain_log_probability(unknown, ["u"], ["t"], "s", steps).first()
    assert row.possible is False


def test_tokens_and_tense(spark):
    rows = spark.createDataFrame(
        [(1, 0, "AUX", "MD"), (2, 0, "AUX", "VBZ"), (3, 0, "AUX", "VBZ"), (3, 1, "NOUN", "MD"), (4, 0, None, None)],
        "sid int, pos int, pos_label string, detailed_pos_label string",
    )
    flags = K.sentence_has_tags(rows, ["sid"])
    assert {r.sid: r.is_future for r in flags.collect()} == {1: 1, 2: 0, 3: 0, 4: 0}
    assert K.require_rows(flags, 4) is flags
    with pytest.raises(ValueError):
        K.require_rows(flags, 5)
    text = spark.createDataFrame([(1, " Ada's 2 cats,  run")], "i int, x string")
    table = K.token_table(text, "i", "x", ["run"]).orderBy("pos").collect()
    assert [r.term for r in table] == ["Ada", "'", "s", "2", "cats", ",", "run"]
    assert all(" Ada's 2 cats,  run"[r.start_char : r.end_char] == r.term for r in table)
    assert [r.stop_word for r in table][-1] is True and table[3].is_alpha is False
    lemmas = spark.createDataFrame([("cats", "cat")], "form string, lemma string")
    assert K.lemmatize(text, "i", "x", lemmas).first()["lemmas"] == "ada's 2 cats, run"


def test_sampling(spark):
    rows = spark.createDataFrame([(i, 1 if i % 5 == 0 else 0) for i in range(200)], "i int, y int")
    split = S.split_rows(rows, "i", 0.2, 42, ["y"])
    assert {r.y: r.t for r in split.groupBy("y").agg(F.count_if("is_test").alias("t")).collect()} == {0: 32, 1: 8}
    under = S.resampled(rows, "i", "y", "undersample")
    assert {r.y: r["count"] for r in under.groupBy("y").count().collect()} == {0: 40, 1: 40}
    over = S.resampled(rows, "i", "y", "oversample")
    assert {r.y: r["count"] for r in over.groupBy("y").count().collect()} == {0: 160, 1: 160}
    assert over.filter("copy = 0").count() == 200
    with pytest.raises(ValueError):
        S.resampled(rows, "i", "y", "smote")
    lonely = rows.union(spark.createDataFrame([(999, 7)], "i int, y int"))
    with pytest.warns(UserWarning):
        assert S.split_rows(lonely, "i", 0.2, 42, ["y"]).filter("is_test").count() == 40
    weights = {r.y: r.weight for r in S.class_weights(rows, "y").select("y", "weight").distinct().collect()}
    assert weights == {0: 0.625, 1: 2.5}
    given = S.class_weights(rows, "y", {0: 1.0, 1: 3.0}).filter("y = 1").first()
    assert given["weight"] == 3.0


def test_graph(spark):
    df = spark.createDataFrame([(1, "a", "t", "o", "says"), (2, "a", "t", "o", "claims"), (3, "b", None, "o", "says")], "i int, s string, t string, o string, r string")
    edges = G.statement_edges(df, "i", "s", "t", "o", "r")
    assert {(r.src, r.dst): r.relation for r in edges.collect()} == {("a", "o"): "claims", ("b", "o"): "says", ("o", "t"): None}
    hubs = [r.node for r in G.node_degrees(edges).collect() if r.is_hub]
    assert hubs == ["o"]


def test_pair_means_equal_brute_force(spark):
    import numpy as np

    rnd = np.random.default_rng(1)
    rows = [(i, "a" if i < 9 else "b", rnd.normal(size=3).tolist()) for i in range(14)]
    left = spark.createDataFrame(rows[:7] + rows[9:11], "i int, k string, v array<double>")
    right = spark.createDataFrame(rows[7:9] + rows[11:], "i int, k string, v array<double>")
    got = {r.k: (r.pairs, r.mean_cosine) for r in R.attribute_pair_means(left, right, "k", "v").collect()}
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    for key, (n, mean) in got.items():
        every = [unit(a[2]) @ unit(b[2]) for a in left.collect() for b in right.collect() if a[1] == b[1] == key]
        assert n == len(every) and abs(mean - np.mean(every)) < 1e-12


def test_json_leaves_at_any_depth(spark):
    from foreglass.operators import nested as N

    rows = [
        (1, '{"Event": "Rise", "parts": [{"deep": {"er": ["oil rises", 3, null, true]}}], "x.y": 1.5}'),
        (2, '"RISE alone"'), (3, "[]"), (4, "no json {"), (5, None), (6, '[[["rise"]], {"a": {}}]'),
    ]
    df = spark.createDataFrame(rows, "i long, record string")
    got = sorted(map(tuple, N.json_leaves(df, "i", "record").collect()), key=str)
    assert (1, "$.parts[0].deep.er[0]", "STRING", "oil rises") in got and (1, "$.parts[0].deep.er[1]", "BIGINT", "3") in got
    assert {r[1] for r in got if r[0] == 1} == {"$.Event", "$.x.y", *(f"$.parts[0].deep.er[{k}]" for k in range(4))}
    assert {r[3] for r in got if r[1] == "$.parts[0].deep.er[2]"} == {None}
    hits = sorted(map(tuple, N.json_search(df, "i", "record", "rise").collect()))
    assert hits == [(1, "$.Event", "Rise"), (1, "$.parts[0].deep.er[0]", "oil rises"), (2, "$", "RISE alone"), (6, "$[0][0][0]", "rise")]
    assert N.json_search(df.filter("i = 5"), "i", "record", "rise").count() == 0
