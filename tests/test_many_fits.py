"""Models fitted together against models fitted alone, by plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foreglass.operators import many_fits as M

SHAPE = "row long, x array<double>, y int, part array<int>"


def frame(spark, x, y, part=None, partitions=3):
    part = part if part is not None else [[1]] * len(x)
    rows = [(i, [None if v != v else float(v) for v in a], int(b), list(map(int, p))) for i, (a, b, p) in enumerate(zip(x, y, part))]
    return M.part_rows(spark.createDataFrame(rows, SHAPE).coalesce(1).repartition(partitions) if partitions > 1 else spark.createDataFrame(rows, SHAPE).coalesce(1)).cache()


def plain_perceptron(x, sign, rounds):
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(rounds):
        wrong = 0
        for row, s in zip(x, sign):
            if s * (w @ row + b) <= 0:
                w, b, wrong = w + s * row, b + s, wrong + 1
        if not wrong:
            break
    return np.r_[w, b], wrong


def plain_sgd(x, sign, strength):
    w, b = np.zeros(x.shape[1]), 0.0
    for t, (row, s) in enumerate(zip(x, sign), 1):
        rate = 1 / (strength * (1 / (10 * strength) + t))
        margin = s * (w @ row + b)
        w = w * (1 - rate * strength)
        if margin < 1:
            w, b = w + rate * s * row, b + rate * s
    return np.r_[w, b]


def separable(n=700, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.integers(-9, 10, size=(n, 5)).astype(float)
    keep = abs(x @ [3, -2, 1, 0, 1] + 2) > 3
    return x[keep], (x[keep] @ [3, -2, 1, 0, 1] + 2 > 0).astype(int)


def test_perceptron_on_one_partition_is_the_plain_one(spark):
    x, y = separable()
    fit = M.LinearFit("perceptron", 0)
    found = M.fit_linear(frame(spark, x, y, partitions=1), [fit], rounds=60)[fit]
    want, wrong = plain_perceptron(x, 2 * y - 1, 60)
    assert wrong == 0 and found.tolist() == want.tolist()


def test_perceptron_on_many_partitions_ends_without_mistakes(spark):
    x, y = separable()
    fit = M.LinearFit("perceptron", 0)
    found = M.fit_linear(frame(spark, x, y, partitions=5), [fit], rounds=200)[fit]
    assert ((x @ found[:-1] + found[-1] > 0) == y).all()


def test_sgd_epoch_is_the_plain_one(spark):
    rng = np.random.default_rng(2)
    x, sign = rng.normal(size=(900, 4)), rng.choice([-1, 1], 900)
    w, _ = M.epoch("sgd", np.zeros(5), np.c_[x, np.ones(900)], sign, 1, 1e-4)
    assert np.allclose(w, plain_sgd(x, sign, 1e-4), rtol=1e-8, atol=1e-8)
    x, y = separable()
    fit = M.LinearFit("sgd", 0, 1e-4)
    found = M.fit_linear(frame(spark, x, y), [fit], rounds=30)[fit]
    assert ((x @ found[:-1] + found[-1] > 0) == y).mean() > 0.97


def mixed_runs(seed=3, n=400):
    """Noisy classes, and three runs: all rows, some twice and some left out, and a test set."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1, 2, 0.5, 1] + [0, 1, 0, -3]
    y = (x @ [1, -1, 2, 0.2] + rng.normal(size=n) > -1).astype(int)
    part = np.c_[np.ones(n), rng.integers(0, 3, n), np.where(np.arange(n) % 4, 1, -1)].astype(int)
    return x, y, part


def test_linear_models_of_all_runs(spark):
    x, y, part = mixed_runs()
    rows = frame(spark, x, y, part)
    fits = [M.LinearFit(m, r, **M.STRENGTHS[m]) for m in ("ridge", "linear", "elastic_net", "logistic", "svm") for r in range(3)]
    found = M.fit_linear(rows, fits)
    for fit, w in found.items():
        times = np.maximum(part[:, fit.run], 0)
        a, s = np.repeat(x, times, axis=0), np.repeat(2 * y - 1, times)
        one = np.c_[a, np.ones(len(a))]
        rest = one @ w - s
        if fit.model in ("ridge", "linear"):
            slope = one.T @ rest + np.r_[w[:-1] * fit.strength, 0]
            assert abs(slope).max() < 1e-6
        elif fit.model == "elastic_net":
            slope = one.T @ rest / len(a) + np.r_[w[:-1] * fit.strength / 2, 0]
            assert abs(slope[-1]) < 1e-9 and (abs(slope[:-1]) <= fit.strength / 2 + 1e-9).all()
            some = w[:-1] != 0
            assert np.allclose(slope[:-1][some], -np.sign(w[:-1][some]) * fit.strength / 2, atol=1e-8)
        elif fit.model == "logistic":
            slope = one.T @ (-s / (1 + np.exp(s * (one @ w)))) + np.r_[w[:-1], 0]
            assert abs(slope).max() < 1e-4
        else:
            cost = lambda v: 0.5 * v[:-1] @ v[:-1] + np.maximum(0, 1 - s * (one @ v)).sum()
            rng = np.random.default_rng(0)
            assert all(cost(w) <= cost(w + rng.normal(size=5) * d) + 0.05 for d in (0.001, 0.01, 0.1, 1) for _ in range(200))


def plain_tree(x, g, h, fit, weight, depth=None, level=0):
    """Exact greedy growth: tuples (feature, cut, missing_left, left, right), or a leaf's value."""
    use = weight > 0
    value = lambda m: -fit.rate * (g * weight)[m].sum() / ((h * weight)[m].sum() + fit.penalty)
    worth = lambda m: (g * weight)[m].sum() ** 2 / ((h * weight)[m].sum() + fit.penalty) if m.any() else 0.0
    best = (1e-9, None)
    if level < fit.depth:
        for f in range(x.shape[1]):
            v = x[:, f]
            for missing_left in (True, False):
                for cut in np.unique(v[~np.isnan(v)]):
                    left = np.where(np.isnan(v), missing_left, v <= cut) & use
                    right = use & ~left
                    if (h * weight)[left].sum() >= fit.least and (h * weight)[right].sum() >= fit.least:
                        gain = worth(left) + worth(right) - worth(use)
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, cut, missing_left, left, right))
    if best[1] is None:
        return value(use)
    f, cut, missing_left, left, right = best[1]
    grow = lambda m: plain_tree(x, g, h, fit, np.where(m, weight, 0), level=level + 1)
    return f, cut, missing_left, grow(left), grow(right)


def as_tuples(tree, node=0):
    if tree.feature[node] < 0:
        return tree.value[node]
    left = tree.left[node]
    return tree.feature[node], tree.cut[node], tree.missing_left[node], as_tuples(tree, left), as_tuples(tree, left + 1)


def alike(a, b):
    if isinstance(a, tuple) != isinstance(b, tuple):
        return False
    if not isinstance(a, tuple):
        return abs(a - b) < 1e-9
    return a[:2] == b[:2] and a[2] == b[2] and alike(a[3], b[3]) and alike(a[4], b[4])


def walk(tree, row):
    while isinstance(tree, tuple):
        f, cut, missing_left, left, right = tree
        tree = left if (missing_left if row[f] != row[f] else row[f] <= cut) else right
    return tree


def test_boosted_trees_split_as_a_plain_fit(spark):
    rng = np.random.default_rng(5)
    n = 260
    x = rng.integers(0, 12, size=(n, 3)) + rng.integers(0, 3, size=(n, 3)) / 8
    x[rng.random((n, 3)) < 0.15] = np.nan
    y = (np.nan_to_num(x[:, 0], nan=9) + np.nan_to_num(x[:, 1], nan=2) * 0.7 + rng.normal(size=n) > 9).astype(int)
    part = np.c_[np.ones(n), rng.integers(0, 3, n)].astype(int)
    fits = [M.TreeFit(0, rounds=3, depth=3), M.TreeFit(1, rounds=2, depth=2, penalty=2.0), *M.tree_fits("decision_tree", 1, 0)]
    grown = M.fit_trees(frame(spark, x, y, part), fits)
    for fit, trees in zip(fits, grown):
        weight, score = np.maximum(part[:, fit.run], 0).astype(float), np.zeros(n)
        for tree in trees:
            p = 1 / (1 + np.exp(-score))
            g, h = (p - y, p * (1 - p)) if fit.loss == "logistic" else (0.0 - y, np.ones(n))
            want = plain_tree(x, g, h, fit, weight)
            assert alike(as_tuples(tree), want)
            answer = np.array([walk(want, row) for row in x])
            assert np.allclose(tree.answer(x), answer)
            score += answer
    assert any(not m for t in grown[0] for m, f in zip(t.missing_left, t.feature) if f >= 0)


def test_many_cuts_become_quantiles(spark):
    rng = np.random.default_rng(6)
    x = np.c_[rng.normal(size=3000), rng.integers(0, 4, 3000), np.full(3000, np.nan)]
    cuts = M.quantile_cuts(frame(spark, x, np.zeros(3000)), 32)
    assert cuts[1].tolist() == [0, 1, 2, 3] and len(cuts[2]) == 0
    shares = np.searchsorted(np.sort(x[:, 0]), cuts[0]) / 3000
    assert 28 <= len(cuts[0]) <= 31 and abs(np.diff(shares) - 1 / 32).max() < 0.01


def test_forest_and_grid(spark):
    x, y, part = mixed_runs(n=600)
    part[:, 1] = np.where(np.arange(600) % 5 == 0, -1, part[:, 1])
    part[:, 0] = np.where(np.arange(600) % 3 == 0, -1, 1)
    rows = frame(spark, x, y, part)
    models = [*M.STRENGTHS, *M.TREES]
    found = M.fit_grid(rows, models, [3, 33, 42], trees=8, rounds=20)
    told = M.answers(rows, ["row"], found, models, 3).collect()
    assert len(told) == (part < 0).sum() and {(r.row, r.run) for r in told} == {(i, r) for i, r in zip(*np.nonzero(part < 0))}
    for model in models:
        hits = np.mean([r[model] == r.y for r in told])
        assert hits > 0.75, model
    again = M.fit_grid(rows.repartition(7), ["random_forest"], [3, 33, 42], trees=3)
    assert [as_tuples(t[0]) for t in again["random_forest", 1]] == [as_tuples(t[0]) for t in found["random_forest", 1][:3]]


def test_bootstrap_counts_are_poisson():
    counts = M.poisson_weights(7, np.arange(200_000))
    for k in range(4):
        assert (counts == k).mean() == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.005)


def test_sums_that_meet_by_key_are_the_same(spark, monkeypatch):
    x, y, part = mixed_runs(n=300)
    rows = frame(spark, x, y, part)
    fits = [M.LinearFit("ridge", 0), M.LinearFit("logistic", 1)]
    trees = [M.TreeFit(0, rounds=2, depth=2), M.TreeFit(2, rounds=1, depth=3, plain_counts=True, penalty=0.0)]
    linear, grown = M.fit_linear(rows, fits), M.fit_trees(rows, trees)
    monkeypatch.setattr(M, "DIRECT_BYTES", 0)
    monkeypatch.setattr(M, "SUMS_BYTES", 1)
    spread = rows.repartition(130)
    again, regrown = M.fit_linear(spread, fits), M.fit_trees(spread, trees, cuts=M.quantile_cuts(rows, 64))
    assert all(np.allclose(linear[f], again[f], atol=1e-6) for f in fits)
    assert all(alike(as_tuples(a), as_tuples(b)) for one, two in zip(grown, regrown) for a, b in zip(one, two))


def test_empty_tasks_and_no_rows(spark):
    x, y = separable(40)
    rows = M.part_rows(frame(spark, x, y)).repartition(100)
    fit = M.LinearFit("ridge", 0)
    assert len(M.fit_linear(rows, [fit])[fit]) == 6
    with pytest.raises(ValueError):
        M.fit_linear(rows.filter(F.lit(False)), [fit])


def test_models_are_saved_and_read_back(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel

    from foreglass.operators import learn as L

    x, y = separable(200)
    rows = [(i, list(map(float, a)), int(b)) for i, (a, b) in enumerate(zip(x, y))]
    ready = L.with_vector(spark.createDataFrame(rows, "i long, v array<double>, label int"), "v").cache()
    for name in ("perceptron", "xgboost"):
        fitted = Pipeline(stages=[L.SharedPasses(name=name, seed=1, trees=2)]).fit(ready)
        fitted.write().save(f"{tmp_path}/{name}")
        told = L.predict(ready, {"a": fitted, "b": PipelineModel.load(f"{tmp_path}/{name}")}, "").collect()
        assert all(r.a == r.b for r in told) and np.mean([r.a == r.label for r in told]) > 0.9


def test_driver_gets_one_row_a_node_and_scores_go_on(spark, monkeypatch):
    """However many tasks there are, sums by bin stay with them; trees do not depend on tasks or on when scores are written."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 6))
    x[rng.random((400, 6)) < 0.1] = np.nan
    y = (np.nan_to_num(x[:, 0]) - np.nan_to_num(x[:, 1]) ** 2 + rng.normal(size=400) / 4 > -0.5).astype(int)
    rows, fits = frame(spark, x, y), [M.TreeFit(0, rounds=7, depth=3), M.TreeFit(0, rounds=2, depth=3, bag=5)]
    sent = []
    plain = type(rows).toArrow
    monkeypatch.setattr(type(rows), "toArrow", lambda df: sent.append(plain(df)) or sent[-1])
    cuts = M.quantile_cuts(rows, 64)
    grown = M.fit_trees(rows, fits, cuts=cuts)
    nodes = sum(len(t.feature) for trees in grown for t in trees)
    assert 0 < sum(table.nbytes for table in sent) < 300 * nodes
    monkeypatch.setattr(M, "TASK_CELLS", 300, raising=False)
    monkeypatch.setattr(M, "SCORED_ROUNDS", 3, raising=False)
    again = M.fit_trees(rows, fits, cuts=cuts)
    assert all(alike(as_tuples(a), as_tuples(b)) for before, after in zip(grown, again) for a, b in zip(before, after))


def test_a_pass_works_on_the_rows_of_a_run_only(spark, monkeypatch):
    """Rows that a run does not train on are not looked at for it, and a run without rows keeps zeros."""
    x, y, _ = mixed_runs(n=300)
    part = np.zeros((300, 3), int)
    part[:30, 0], part[30:, 1] = 1, 2
    seen = []
    plain = M._curve
    monkeypatch.setattr(M, "_curve", lambda model, margin, width: seen.append(len(margin)) or plain(model, margin, width))
    monkeypatch.setattr(M, "summed", lambda rows, work, size: dict(sorted(work(iter(rows)).items())))
    frame_rows = M.part_rows(spark.createDataFrame([(i, [float(v) for v in a], int(b), p.tolist()) for i, (a, b, p) in enumerate(zip(x, y, part))], SHAPE))
    batches = frame_rows.toArrow().to_batches()
    found = M._newton(batches, [M.LinearFit("logistic", r) for r in range(3)], x.shape[1] + 1)
    assert max(seen) <= 270 and min(seen) <= 30
    assert not found[M.LinearFit("logistic", 2)].any() and found[M.LinearFit("logistic", 0)].any()
