"""Many models fitted together: every pass over the rows serves all of them.

A row holds its features ``x`` (array of doubles), its class ``y`` (0 or 1), a number ``row``
by which bootstrap samples are drawn, and ``part``, one number for each run (a data set and
a seed): how often the run trains on the row, 0 if not at all, -1 if the run tests on it. Tasks return sums for each fit, which are added
without passing rows or more than a few MB of sums to the driver; the weights go out with
the next pass. Rows are never collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foreglass.scale import written_once

CHUNK = 256
SUMS_BYTES = 64 << 20  # sums that a task holds at a time
DIRECT_BYTES = 16 << 20  # sums of all tasks that may go to the driver as they are
TASK_CELLS = 1 << 20  # features of rows times fits that are worth a task when trees grow
SCORED_ROUNDS = 8  # rounds of boosting whose trees are followed anew by each pass
WIDEST = 2000  # features of which second moments are summed

ONLINE, SQUARES, CURVED = ("perceptron", "sgd"), ("ridge", "linear", "elastic_net"), ("logistic", "svm")


def part_rows(df: DataFrame) -> DataFrame:
    """The four columns in a fixed form; rows without features, class or part are left out."""
    kinds = {"x": "array<double>", "y": "double", "part": "array<int>", "row": "long"}
    rows = df.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()])
    return rows.filter("x is not null and y is not null and part is not null")


def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, classes and parts of a batch; a missing feature is NaN."""
    n = batch.num_rows
    x = np.asarray(batch.column("x").flatten().fill_null(float("nan"))).reshape(n, -1)
    return x, np.asarray(batch.column("y")), np.asarray(batch.column("part").flatten()).reshape(n, -1)


def _added(table: pa.Table) -> pa.Table:
    total = np.asarray(table.column("v").combine_chunks().flatten()).reshape(table.num_rows, -1).sum(axis=0)
    return pa.table({c: table.column(c).slice(0, 1) for c in ("k", "slot")} | {"v": pa.array([total], pa.list_(pa.float64()))})


def summed(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], dict[int, np.ndarray]], task_bytes: int) -> dict[int, np.ndarray]:
    """Sums over all tasks of the arrays that ``work`` returns for each key.

    If the tasks' sums, about ``task_bytes`` each, are few bytes in all, they are added on
    the driver; else they meet by key first, in groups of tasks.
    """
    tasks = rows.rdd.getNumPartitions()
    slots = max(1, tasks // 64)

    def run(batches):
        from pyspark import TaskContext

        out = work(batch for batch in batches if batch.num_rows)
        keys = list(out)
        slot = TaskContext.get().partitionId() % slots
        columns = [pa.array(keys, pa.int64()), pa.array([slot] * len(keys), pa.int64()), pa.array([out[k] for k in keys], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["k", "slot", "v"])

    ddl = "k long, slot long, v array<double>"
    found = rows.mapInArrow(run, ddl)
    if tasks * task_bytes > DIRECT_BYTES:
        found = found.groupBy("k", "slot").applyInArrow(_added, ddl)
        if slots > 1:
            found = found.withColumn("slot", F.lit(0).cast("long")).groupBy("k", "slot").applyInArrow(_added, ddl)
    out: dict[int, np.ndarray] = {}
    for batch in found.toArrow().to_batches():
        for k, v in zip(batch.column("k").to_pylist(), batch.column("v")):
            out[k] = out.get(k, 0) + v.values.to_numpy()
    return dict(sorted(out.items()))


# --- linear models


@dataclass(frozen=True)
class LinearFit:
    """A linear model to fit; ``strength`` weighs its penalty, ``l1`` is the share of the absolute one."""

    model: str
    run: int
    strength: float = 1.0
    l1: float = 0.5


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.nan_to_num(x), np.ones((len(x), 1))], axis=1)


def _least_squares(rows: DataFrame, fits: list[LinearFit], size: int) -> dict[LinearFit, np.ndarray]:
    """Squared error on classes -1 and 1, from second moments: one pass for all fits of all runs."""
    runs = sorted({f.run for f in fits})

    def moments(batches):
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            x, y, part = arrays(batch)
            full = np.concatenate([_with_one(x), 2 * y[:, None] - 1], axis=1)
            for run in runs:
                weight = np.maximum(part[:, run], 0)
                out[run] = out.get(run, 0) + (full * weight[:, None]).T @ full
        return {run: m.ravel() for run, m in out.items()}

    sums = summed(rows, moments, len(runs) * 8 * (size + 1) ** 2)
    found = {}
    for fit in fits:
        m = sums[fit.run].reshape(int(len(sums[fit.run]) ** 0.5), -1)
        n, mean, target = m[-2, -2], m[-2, :-2] / m[-2, -2], m[-2, -1] / m[-2, -2]
        gram, cross = m[:-2, :-2] - n * np.outer(mean, mean), m[:-2, -1] - n * mean * target
        if fit.model == "elastic_net":
            w = _elastic_net(gram / n, cross / n, fit.strength, fit.l1)
        else:
            w = np.linalg.lstsq(gram + (fit.strength if fit.model == "ridge" else 0.0) * np.eye(len(gram)), cross, rcond=None)[0]
        found[fit] = np.r_[w, target - mean @ w]
    return found


def _elastic_net(gram: np.ndarray, cross: np.ndarray, strength: float, l1: float) -> np.ndarray:
    """Coordinate descent on half the mean squared error plus both penalties."""
    w = np.zeros(len(cross))
    for _ in range(1000):
        before = w.copy()
        for i in range(len(w)):
            rest = cross[i] - gram[i] @ w + gram[i, i] * w[i]
            scale = gram[i, i] + strength * (1 - l1)
            w[i] = np.sign(rest) * max(0.0, abs(rest) - strength * l1) / scale if scale > 0 else 0.0
        if abs(w - before).max(initial=0.0) < 1e-10:
            break
    return w


def _curve(model: str, margin: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss of each margin, its slope and its curvature; the hinge is rounded over ``width`` on both sides of 1."""
    if model == "logistic":
        p = 1 / (1 + np.exp(np.clip(margin, -500, 500)))
        return np.logaddexp(0, -margin), -p, p * (1 - p)
    short = 1 + width - margin
    inside = abs(1 - margin) <= width
    loss = np.where(inside, short**2 / (4 * width), np.maximum(0, 1 - margin))
    return loss, np.where(inside, -short / (2 * width), np.where(margin < 1, -1.0, 0.0)), inside / (2 * width)


SHARES = 0.5 ** np.arange(24)  # of a Newton step, compared in one pass


def _newton(rows: DataFrame, fits: list[LinearFit], size: int, rounds: int = 120) -> dict[LinearFit, np.ndarray]:
    """Penalised logistic and hinge losses by Newton steps; a pass serves every fit that still moves.

    One pass gives a fit its slopes and curvatures, the next the losses at many shares of
    the step, of which the best is taken, so losses only fall. The hinge is rounded
    widely at first, so that every row counts, and made sharper where a fit stands still.
    """
    weights = {k: np.zeros(size) for k in range(len(fits))}
    width = {k: 2.0 for k in weights}
    step: dict[int, np.ndarray] = {}  # fits that look for their share of a step
    now: dict[int, float] = {}
    penalty = {k: np.r_[np.full(size - 1, f.strength), 0.0] for k, f in enumerate(fits)}
    open_fits = set(weights)
    for _ in range(rounds):
        if not open_fits:
            break
        at = {k: (fits[k].model, fits[k].run, weights[k], step.get(k), width[k]) for k in sorted(open_fits)}

        def losses(batches, at=at):
            out: dict[int, np.ndarray] = {}
            for batch in batches:
                x, y, part = arrays(batch)
                every, signs = _with_one(x), 2 * y - 1
                own = {run: np.flatnonzero(part[:, run] > 0) for run in {run for _, run, *_ in at.values()}}
                trained = {run: (every[rows], signs[rows], part[rows, run]) for run, rows in own.items() if len(rows)}
                for k, (model, run, w, along, wide) in at.items():
                    if run not in trained:
                        continue
                    x, sign, weight = trained[run]
                    if along is None:
                        loss, slope, curve = _curve(model, sign * (x @ w), wide)
                        hess = (x * (weight * curve)[:, None]).T @ x
                        told = np.r_[weight @ loss, x.T @ (weight * slope * sign), hess.ravel()]
                    else:
                        start, change = sign * (x @ w), sign * (x @ along)
                        told = np.array([weight @ _curve(model, start + share * change, wide)[0] for share in SHARES])
                    out[k] = out.get(k, 0) + told
            return out

        told = summed(rows, losses, len(at) * 8 * (size + 1) ** 2)
        open_fits &= set(told)  # a run without rows to train on keeps its zeros
        for k, sums in told.items():
            w = weights[k]
            if k in step:
                places = w + SHARES[:, None] * step.pop(k)
                full = sums + 0.5 * places**2 @ penalty[k]
                best = int(full.argmin())
                if full[best] < now[k] - 1e-10 * abs(now[k]):
                    weights[k] = places[best]
                    continue
            else:
                slope = sums[1 : size + 1] + penalty[k] * w
                hess = sums[size + 1 :].reshape(size, size) + np.diag(penalty[k])
                hess += np.eye(size) * (1e-9 + 1e-7 * np.trace(hess) / size)
                change = -np.linalg.lstsq(hess, slope, rcond=None)[0]
                if abs(change).max() >= 1e-7 * (1 + abs(w).max()):
                    step[k], now[k] = change, sums[0] + 0.5 * penalty[k] @ w**2
                    continue
            if fits[k].model == "svm" and width[k] > 0.02:
                width[k] /= 2
            else:
                open_fits.discard(k)
    return {fits[k]: w for k, w in weights.items()}


def epoch(model: str, w: np.ndarray, x: np.ndarray, sign: np.ndarray, seen: int, strength: float) -> tuple[np.ndarray, int]:
    """One pass of mistake-driven training over rows in order; returns the weights and the number of mistakes.

    The perceptron adds a row it gets wrong. Hinge-loss SGD shrinks the weights (not
    the intercept) at every row, with a rate of ``1 / (strength * (1/(10 strength) + row number))``,
    and adds rows of a margin below 1. Products inside a chunk come from one matrix.
    """
    w, mistakes, first = w.copy(), 0, 1 / (10 * strength)
    for lo in range(0, len(x), CHUNK):
        part, y = x[lo : lo + CHUNK], sign[lo : lo + CHUNK]
        products = part @ part.T
        shared = products - 1  # without the intercept's one
        scale, plain, intercept = 1.0, part[:, :-1] @ w[:-1], w[-1]
        added = np.zeros(len(part))  # of each row, before scaling
        for i in range(len(part)):
            margin = y[i] * (scale * plain[i] + intercept)
            mistakes += margin <= 0
            if model == "perceptron":
                if margin <= 0:
                    added[i] += y[i]
                    plain += y[i] * shared[i]
                    intercept += y[i]
            else:
                rate = 1 / (strength * (first + seen))
                seen += 1
                scale *= 1 - rate * strength
                if margin < 1:
                    added[i] += rate * y[i] / scale
                    plain += rate * y[i] / scale * shared[i]
                    intercept += rate * y[i]
        w[:-1] = scale * (w[:-1] + added @ part[:, :-1])
        w[-1] = intercept
    return w, mistakes


def _mixed(rows: DataFrame, fits: list[LinearFit], size: int, rounds: int, patience: int = 5) -> dict[LinearFit, np.ndarray]:
    """Iterative parameter mixing: tasks train on their rows from the shared weights, which are averaged by row counts.

    A fit is done when a whole round made no mistake, or when ``patience`` rounds brought
    no fewer mistakes. The weights of the round with the fewest mistakes are kept: a round
    without any ends with the weights that it began with.
    """
    weights, best = {k: np.zeros(size) for k in range(len(fits))}, {k: (np.inf, np.zeros(size), 0) for k in range(len(fits))}
    seen = {k: 1 for k in weights}
    open_fits = set(weights)
    for at_round in range(rounds):
        if not open_fits:
            break
        at = {k: (fits[k].model, fits[k].run, weights[k], seen[k], fits[k].strength) for k in sorted(open_fits)}

        def trained(batches, at=at):
            own = {k: (w, seen, 0, 0) for k, (_, _, w, seen, _) in at.items()}
            for batch in batches:
                x, y, part = arrays(batch)
                x, sign = _with_one(x), 2 * y - 1
                for k, (model, run, _, _, strength) in at.items():
                    times = np.maximum(part[:, run], 0)
                    inside = np.repeat(np.arange(len(x)), times)
                    w, count, wrong, rows_seen = own[k]
                    w, more = epoch(model, w, x[inside], sign[inside], count, strength)
                    own[k] = (w, count + len(inside), wrong + more, rows_seen + len(inside))
            return {k: np.r_[n * w, n, wrong] for k, (w, _, wrong, n) in own.items() if n}

        for k, sums in summed(rows, trained, len(at) * 8 * (size + 2)).items():
            n, wrong = sums[-2], sums[-1]
            mixed = sums[:-2] / n
            start = weights[k]
            if wrong < best[k][0]:
                best[k] = (wrong, start if wrong == 0 else mixed, at_round)
            weights[k], seen[k] = mixed, seen[k] + int(n)
            if wrong == 0 or at_round - best[k][2] >= patience:
                open_fits.discard(k)
    return {fits[k]: w for k, (_, w, _) in best.items()}


def fit_linear(rows: DataFrame, fits: list[LinearFit], rounds: int = 100) -> dict[LinearFit, np.ndarray]:
    """Weights (the intercept last) of every fit. ``rows`` should be a written or cached table of ``part_rows``."""
    first = rows.select(F.size("x").alias("n")).first()
    if first is None:
        raise ValueError("no rows to fit")
    size = first["n"] + 1
    if size - 1 > WIDEST and any(f.model not in ONLINE for f in fits):
        raise ValueError(f"second moments are summed for up to {WIDEST} features")
    out: dict[LinearFit, np.ndarray] = {}
    for names, fitter in ((SQUARES, lambda r, f: _least_squares(r, f, size)), (CURVED, lambda r, f: _newton(r, f, size)), (ONLINE, lambda r, f: _mixed(r, f, size, rounds))):
        own = [f for f in fits if f.model in names]
        if own:
            out |= fitter(rows, own)
    return out


# --- trees


@dataclass(frozen=True)
class TreeFit:
    """Trees to grow on a run.

    ``loss`` is ``logistic`` (boosted) or ``squared`` (shares of class 1). With
    ``plain_counts`` splits are judged by slopes and row counts only (first order), else by
    slopes and curvatures. ``bag`` seeds a bootstrap of rows and a choice of features at each node.
    """

    run: int
    rounds: int = 100
    depth: int = 6
    rate: float = 0.3
    penalty: float = 1.0
    least: float = 1.0  # curvature (or rows) that each side must have
    loss: str = "logistic"
    plain_counts: bool = False
    bag: int | None = None


@dataclass
class Tree:
    """Nodes as lists: ``feature`` -1 is a leaf; values up to ``cut`` go left, missing ones as ``missing_left`` says."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[float] = field(default_factory=lambda: [0.0])
    missing_left: list[bool] = field(default_factory=lambda: [True])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    depth: int = 0

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Node that each row ends in; children of a node are neighbours."""
        feature, cut, missing = np.array(self.feature), np.array(self.cut), np.array(self.missing_left)
        left, node = np.array(self.left), np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            f = feature[node]
            v = x[np.arange(len(x)), np.maximum(f, 0)]
            goes_left = np.where(np.isnan(v), missing[node], v <= cut[node])
            node = np.where(f < 0, node, left[node] + ~goes_left)
        return node

    def answer(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(x)]


def raw_scores(trees: list[Tree], x: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """What trees say of rows, added in order to ``start``."""
    return sum((t.answer(x) for t in trees), np.zeros(len(x)) if start is None else start)


def quantile_cuts(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """Ascending cuts of each feature, at most ``bins - 1``: its distinct values if they are that few, else quantiles."""
    size = rows.select(F.size("x").alias("n")).first()["n"]
    named = rows.select(*[F.when(~F.isnan(F.get("x", F.lit(i))), F.get("x", F.lit(i))).alias(f"x{i}") for i in range(size)])
    few = named.agg(*[F.approx_count_distinct(c).alias(c) for c in named.columns]).first()
    exact = [c for c in named.columns if few[c] < bins]
    kinds = named.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in exact]).first() if exact else {}
    rest = [c for c in named.columns if c not in exact]
    shares = [i / bins for i in range(1, bins)]
    found = dict(zip(rest, named.approxQuantile(rest, shares, 0.1 / bins))) if rest else {}
    found |= {c: kinds[c] for c in exact}
    return [np.unique(np.array(found[c], float)) for c in named.columns]


def _slopes(fit: TreeFit, score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if fit.loss == "squared":
        return score - y, np.ones(len(y))
    p = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
    return p - y, p * (1 - p)


def poisson_weights(seed: int, row: np.ndarray) -> np.ndarray:
    """Bootstrap counts drawn from the row's number, so that retries and other partitionings draw the same."""
    mixed = row.view(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for turn in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(turn)
    share = (mixed >> np.uint64(11)).astype(float) / (1 << 53)
    return np.searchsorted(np.cumsum(np.exp(-1) / np.array([1, 1, 2, 6, 24, 120, 720.0])), share)


def _summed_cells(table: pa.Table) -> pa.Table:
    total = np.asarray(table.column("v").combine_chunks().flatten()).reshape(table.num_rows, -1).sum(axis=0)
    return pa.table({c: table.column(c).slice(0, 1) for c in ("fit", "node", "slot")} | {"v": pa.array([total], pa.list_(pa.float64()))})


def _best_split(table: pa.Table, fits: list[TreeFit], features: int) -> pa.Table:
    """Sums of one node over all tasks, and its best cut among the features that it may use, in one row."""
    total = np.asarray(table.column("v").combine_chunks().flatten()).reshape(table.num_rows, -1).sum(axis=0)
    g, h, c = total.reshape(3, features, -1)  # slopes, curvatures, rows by bin; the last bin is for missing values
    fit = fits[table.column("fit")[0].as_py()]
    judge = c if fit.plain_counts else h
    worth = lambda a, b: np.where(b + fit.penalty > 0, a * a / np.maximum(b + fit.penalty, 1e-300), 0.0)
    sums = [v.sum(axis=1, keepdims=True) for v in (g, h, judge)]
    every, sides = np.arange(features), []
    for missing_left in (True, False):
        left = [np.cumsum(v[:, :-1], axis=1) + (v[:, -1:] if missing_left else 0) for v in (g, h, judge)]
        right = [s - v for s, v in zip(sums, left)]
        gain = worth(left[0], left[2]) + worth(right[0], right[2]) - worth(sums[0], sums[2])
        gain = np.where((left[2] >= fit.least) & (right[2] >= fit.least), gain, 0.0)
        at = gain.argmax(axis=1)
        sides.append([gain[every, at], at, *[v[every, at] for v in (left[0], left[1], right[0], right[1])]])
    chosen = (sides[1][0] > sides[0][0] + 1e-12).astype(int)
    best = [np.where(chosen == 1, b, a) for a, b in zip(*sides)]
    names = ("gain", "bin", "left_g", "left_h", "right_g", "right_h")
    node = table.column("node")[0].as_py()
    if fit.bag is not None:
        take = max(1, int(features**0.5))
        open_to = np.sort(np.random.default_rng([fit.bag, node]).permutation(features)[:take])
    else:
        open_to = every
    f = int(open_to[best[0][open_to].argmax()])  # the first feature of the highest gain
    out = {"fit": table.column("fit")[0].as_py(), "node": node, "feature": f, "missing_left": bool(chosen[f] == 0)}
    out |= {k: v[f].item() for k, v in zip(names, best)} | {"g": sums[0][0, 0].item(), "h": sums[1][0, 0].item()}
    return pa.table({k: pa.array([out[k]]) for k in SPLIT_COLUMNS})


SPLIT = "fit long, node long, feature long, gain double, bin long, missing_left boolean, left_g double, left_h double, right_g double, right_h double, g double, h double"
SPLIT_COLUMNS = [c.split()[0] for c in SPLIT.split(", ")]


def fit_trees(rows: DataFrame, fits: list[TreeFit], bins: int = 64, cuts: list[np.ndarray] | None = None) -> list[list[Tree]]:
    """Trees of every fit, grown level by level together: one job a level for as many fits as fit in memory.

    Rows are written once with the bin of each value, and every few rounds with what the trees so
    far say, so that a pass only follows the last trees. Tasks sum slopes, curvatures and rows by
    fit, node, feature and bin; where the sums of a node meet, the best cut is found, and
    the driver sees one row for each node. A cut maximises ``G^2 / (H + penalty)`` of both
    sides, and a leaf is ``-rate * G / (H + penalty)``. Missing values go to the side that gains more.
    """
    cuts = quantile_cuts(rows, bins) if cuts is None else cuts
    if not cuts:  # nothing to split by
        return [[Tree() for _ in range(f.rounds)] for f in fits]
    widest = max(len(c) for c in cuts) + 2  # bins beyond the last cut, and the missing
    grown: list[list[Tree]] = [[] for _ in fits]
    boosted = [k for k, f in enumerate(fits) if f.loss == "logistic"]
    held, told = _binned(rows, cuts, len(fits)), 0  # rows whose scores hold the first ``told`` rounds
    for at_round in range(max((f.rounds for f in fits), default=0)):
        if boosted and at_round - told == SCORED_ROUNDS:
            held, told = _with_scores(held, fits, boosted, grown, told), at_round
        tasks = held.rdd.getNumPartitions()
        active = [k for k, f in enumerate(fits) if f.rounds > at_round]
        new = {k: Tree() for k in active}
        frontier = {k: [0] for k in active}
        for level in range(max(fits[k].depth for k in active)):
            todo = [k for k in active if frontier[k] and level < fits[k].depth]
            for part in _loads(todo, frontier, len(cuts) * widest * 24):
                work = {k: (fits[k], grown[k][told:] if k in boosted else [], new[k], {n: i for i, n in enumerate(frontier[k])}) for k in part}
                found = _level(held, tasks, fits, work, boosted, len(cuts), widest, level)
                for k in part:
                    frontier[k] = _grow(fits[k], k, new[k], frontier[k], found, level)
        for k in active:
            grown[k].append(new[k])
    for tree in (t for trees in grown for t in trees):  # from bins to values
        places = [(cuts[f], int(c)) if c < len(cuts[f]) else None for f, c in zip(tree.feature, tree.cut)]
        tree.cut = [0.0 if f < 0 else float(at[0][at[1]]) if at else float("inf") for f, at in zip(tree.feature, places)]
    return grown


def _binned(rows: DataFrame, cuts: list[np.ndarray], fits: int) -> DataFrame:
    """Rows with the number of each value's bin in place of the value, spread over the cores if there is work for them."""

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, _, _ = arrays(batch)
            bins = np.empty(x.shape, np.float32)
            for f, cut in enumerate(cuts):
                bins[:, f] = np.where(np.isnan(x[:, f]), np.nan, np.searchsorted(cut, x[:, f], "left"))
            columns = [_lists(bins), *[batch.column(c) for c in ("y", "part", "row")]]
            yield pa.RecordBatch.from_arrays(columns, names=["x", "y", "part", "row"])

    slim = rows.select("x", "y", "part", "row")
    work = slim.count() * len(cuts) * fits
    tasks = min(max(slim.sparkSession.sparkContext.defaultParallelism, slim.rdd.getNumPartitions()), 1 + work // TASK_CELLS)
    return written_once(slim.mapInArrow(place, "x array<float>, y double, part array<int>, row long").repartition(tasks), "bins")


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), pa.array(values.ravel()))


def _with_scores(rows: DataFrame, fits: list[TreeFit], boosted: list[int], grown: list[list[Tree]], told: int) -> DataFrame:
    """Rows with ``score``, what all trees of each boosted fit say of a row that it trains on; ``told`` rounds are in it already."""
    work = rows.sparkSession.sparkContext.broadcast([(fits[k].run, grown[k][told:]) for k in boosted])

    def add(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, _, part = arrays(batch)
            score = _scores(batch, len(boosted)).copy()
            for i, (run, trees) in enumerate(work.value):
                inside = np.flatnonzero(part[:, run] > 0)
                score[inside, i] = raw_scores(trees, x[inside], score[inside, i])
            columns = [batch.column(c) for c in ("x", "y", "part", "row")]
            yield pa.RecordBatch.from_arrays([*columns, _lists(score)], names=["x", "y", "part", "row", "score"])

    return written_once(rows.mapInArrow(add, "x array<float>, y double, part array<int>, row long, score array<double>"), "scores")


def _scores(batch: pa.RecordBatch, fits: int) -> np.ndarray:
    if "score" not in batch.schema.names:
        return np.zeros((batch.num_rows, fits))
    return np.asarray(batch.column("score").flatten()).reshape(batch.num_rows, fits)


def _loads(todo: list[int], frontier: dict[int, list[int]], node_bytes: int) -> Iterator[list[int]]:
    """Fits in groups whose sums stay below ``SUMS_BYTES`` in a task, or single fits."""
    part, held = [], 0
    for k in todo:
        size = len(frontier[k]) * node_bytes
        if part and held + size > SUMS_BYTES:
            yield part
            part, held = [], 0
        part.append(k)
        held += size
    if part:
        yield part


def _level(rows, tasks, fits, work, boosted, features, widest, level) -> dict[tuple[int, int], dict]:
    """Best cut of the open nodes of some fits, by one job."""
    work = rows.sparkSession.sparkContext.broadcast(work)
    place_of = {k: i for i, k in enumerate(boosted)}
    slots = max(1, tasks // 64)

    def sums(batches):
        from pyspark import TaskContext

        out: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, parts = arrays(batch)
            bins = np.where(np.isnan(x), widest - 1, x).astype(np.int64)
            said, row, own = _scores(batch, len(boosted)), np.asarray(batch.column("row")), {}
            for k, (fit, before, tree, spots) in work.value.items():
                if fit.run not in own:
                    own[fit.run] = np.flatnonzero(parts[:, fit.run] > 0)
                inside = own[fit.run]
                weight = parts[inside, fit.run]
                if fit.bag is not None:
                    weight = weight * poisson_weights(fit.bag, row[inside])
                    inside, weight = inside[weight > 0], weight[weight > 0]
                node = tree.leaves(x[inside]) if level else np.zeros(len(inside), np.int64)
                spot = np.full(len(tree.feature), -1)
                spot[list(spots)] = list(spots.values())
                at = spot[node]
                inside, w, at = inside[at >= 0], weight[at >= 0], at[at >= 0]
                if not len(inside):
                    continue
                start = said[inside, place_of[k]] if k in place_of else None
                g, h = _slopes(fit, raw_scores(before, x[inside], start), y[inside])
                place = ((at[:, None] * features + np.arange(features)) * widest + bins[inside]).ravel()
                size = len(spots) * features * widest
                sums = [np.bincount(place, np.repeat(v, features), size) for v in (g * w, h * w, w.astype(float))]
                out[k] = out.get(k, 0) + np.array(sums).reshape(3, len(spots), features, widest)
        for k, total in out.items():
            nodes = list(work.value[k][3])
            columns = [[k] * len(nodes), nodes, [TaskContext.get().partitionId() % slots] * len(nodes)]
            cells = pa.array([total[:, n].ravel() for n in range(len(nodes))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], cells], names=["fit", "node", "slot", "v"])

    def alone(batches):  # the only task has the whole sums
        for cells in sums(batches):
            for i in range(cells.num_rows):
                yield from _best_split(pa.Table.from_batches([cells.slice(i, 1)]), fits, features).to_batches()

    ddl = "fit long, node long, slot long, v array<double>"
    if tasks == 1:
        best = rows.mapInArrow(alone, SPLIT)
    else:
        told = rows.mapInArrow(sums, ddl)
        if slots > 1:
            told = told.groupBy("fit", "node", "slot").applyInArrow(_summed_cells, ddl)
        best = told.groupBy("fit", "node").applyInArrow(lambda table: _best_split(table, fits, features), SPLIT)
    found = {(row["fit"], row["node"]): row for row in best.toArrow().to_pylist()}
    work.unpersist()
    return found


def _grow(fit: TreeFit, k: int, tree: Tree, open_nodes: list[int], found: dict, level: int) -> list[int]:
    """Split the open nodes at their best cut, told as a bin; returns the children that may be split next."""
    value = lambda g, h: -fit.rate * g / max(h + fit.penalty, 1e-300) if h + fit.penalty > 0 else 0.0
    children: list[int] = []
    for node in open_nodes:
        best = found.get((k, node))
        if best is None:
            continue
        if level == 0:
            tree.value[node] = value(best["g"], best["h"])
        if best["gain"] <= 1e-9:
            continue
        tree.feature[node], tree.missing_left[node], tree.left[node] = best["feature"], best["missing_left"], len(tree.feature)
        tree.cut[node] = float(best["bin"])
        for side in ("left", "right"):
            children.append(len(tree.feature))
            tree.feature.append(-1)
            tree.cut.append(0.0)
            tree.missing_left.append(True)
            tree.left.append(0)
            tree.value.append(value(best[f"{side}_g"], best[f"{side}_h"]))
        tree.depth = level + 1
    return children


def tree_fits(model: str, run: int, seed: int, trees: int = 100) -> list[TreeFit]:
    """The fits behind a named model: one, or one for each tree of a forest."""
    share = {"rounds": 1, "rate": 1.0, "penalty": 0.0, "loss": "squared", "depth": 5}
    if model == "decision_tree":
        return [TreeFit(run, **share)]
    if model == "random_forest":
        return [TreeFit(run, **share, bag=seed * 100_003 + i) for i in range(trees)]
    if model == "gradient_boosting":
        return [TreeFit(run, rounds=trees, depth=3, rate=0.1, penalty=0.0, plain_counts=True)]
    if model == "xgboost":
        return [TreeFit(run, rounds=trees)]
    raise ValueError(f"unknown model {model}")


# --- grids


def class_of(model: str, found, x: np.ndarray) -> np.ndarray:
    """Class 0 or 1 of every row by fitted weights, or by fitted trees of one or several fits."""
    if isinstance(found, np.ndarray):
        return (_with_one(x) @ found > 0).astype(np.int32)
    if model in ("decision_tree", "random_forest"):
        return (sum(raw_scores(trees, x) for trees in found) / len(found) > 0.5).astype(np.int32)
    return (raw_scores(found[0], x) > 0).astype(np.int32)


def fit_grid(rows: DataFrame, models: list[str], seeds: list[int], trees: int = 100, rounds: int = 100) -> dict[tuple[str, int], object]:
    """Every model on every run (one seed each): linear models by shared passes, trees level by level together."""
    linear = [LinearFit(m, r, **STRENGTHS.get(m, {})) for m in models if m in STRENGTHS for r in range(len(seeds))]
    found: dict[tuple[str, int], object] = {(f.model, f.run): w for f, w in (fit_linear(rows, linear, rounds) if linear else {}).items()}
    fits, owner = [], []
    for model in models:
        if model not in STRENGTHS:
            for run, seed in enumerate(seeds):
                own = tree_fits(model, run, seed, trees)
                fits += own
                owner += [(model, run)] * len(own)
    for key, grown in zip(owner, fit_trees(rows, fits) if fits else []):
        found.setdefault(key, []).append(grown)
    return found


#: Penalties of the linear models. Squared and logistic losses are summed, the elastic net's is a mean.
STRENGTHS: dict[str, dict] = {
    "perceptron": {},
    "sgd": {"strength": 1e-4},
    "logistic": {"strength": 1.0},
    "ridge": {"strength": 1.0},
    "linear": {"strength": 0.0},
    "elastic_net": {"strength": 0.01},
    "svm": {"strength": 1.0},
}
TREES = ["decision_tree", "random_forest", "gradient_boosting", "xgboost"]


def answers(rows: DataFrame, keep: list[str], found: dict[tuple[str, int], object], models: list[str], runs: int) -> DataFrame:
    """``keep, run, y`` and a column for each model: classes of every row that a run tests on."""
    held = rows.sparkSession.sparkContext.broadcast(found)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    ddl = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["run int", "y int"] + [f"`{m}` int" for m in models])

    def answer(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, part = arrays(batch)
            for run in range(runs):
                test = np.flatnonzero(part[:, run] < 0)
                if len(test):
                    told = [pa.array(class_of(m, held.value[m, run], x[test])) for m in models]
                    own = [batch.column(c).take(pa.array(test)) for c in keep]
                    columns = [*own, pa.array(np.full(len(test), run, np.int32)), pa.array(y[test].astype(np.int32)), *told]
                    yield pa.RecordBatch.from_arrays(columns, names=[*keep, "run", "y", *models])

    return rows.mapInArrow(answer, ddl)
