"""Near vectors, filter audit and periodic runs against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from foreglass.llm import filter_audit, periodic_runs, queries, tiled_cosine

# --- near vectors

VECTORS = "vec_id long, embedding array<double>, label int, id string, uid int, v string, key int, width string, block int, n int, c int"


def vector_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, "z", 3, 4, 5) for r in rows], VECTORS)


def usable(vector, label):
    return bool(vector) and label is not None and all(x is not None and math.isfinite(x) for x in vector) and any(vector)


def brute_vectors(rows, least):
    """Counter of (id, n_links, component_id, kept) by all pairs."""
    near = defaultdict(set)
    for i, (_, a, la) in enumerate(rows):
        for j, (_, b, lb) in enumerate(rows[:i]):
            if la == lb and usable(a, la) and usable(b, lb) and len(a) == len(b):
                x, y = np.array(a) / max(map(abs, a)), np.array(b) / max(map(abs, b))
                if math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y)) >= least:
                    near[i].add(j)
                    near[j].add(i)
    out, seen = Counter(), {}
    for i in range(len(rows)):
        if i in seen:
            continue
        part, todo = {i}, [i]
        while todo:
            fresh = near[todo.pop()] - part
            part |= fresh
            todo += fresh
        ids = [rows[k][0] for k in part if rows[k][0] is not None]
        for k in part:
            seen[k] = min(ids) if ids else None
    for i, (doc, _, _) in enumerate(rows):
        out[doc, len(near[i]), seen[i], doc == seen[i]] += 1
    return out


def chained(rnd, n, width, label, first):
    """Vectors in clusters, chains whose ends are not linked, and strays."""
    rows = []
    for i in range(n):
        if i % 7 and rows:
            base = rnd.choice(rows[-6:])[1]
            size = math.sqrt(sum(x * x for x in base) / width)
            rows.append((first + i, [x + rnd.gauss(0, 0.14 * size) for x in base], label))
        else:
            rows.append((first + i, [rnd.gauss(0, 1) for _ in range(width)], label))
    return rows


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(tiled_cosine, "BLOCK", 40)
    rnd = random.Random(3)
    rows = chained(rnd, 150, 24, 1, 100) + chained(rnd, 60, 24, 2, 1000) + chained(rnd, 40, 3, 1, 2000)
    same = rows[5][1]
    rows += [(3000 + i, list(same), 1) for i in range(30)] + [(3100 + i, [7.5 * x for x in same], 1) for i in range(5)]
    rows += [(4000, None, 1), (4001, [0.0] * 24, 1), (4002, [float("nan")] * 24, 1), (4003, [None] * 24, 1), (4004, [], 1)]
    rows += [(4005, same, None), (4006, [float("inf"), *same[1:]], 1), (None, same, 1), (None, None, None), (None, [-0.0, 1.0], 9), (4007, [0.0, 1.0], 9)]
    rows += [(4008, [1e200, 1e200], 9), (4009, [1e-200, 1e-200], 9), (7, same, 2), (7, same, 2), (None, [1.0, 0.0], 8), (None, [1.0, 0.0], 8)]
    found = tiled_cosine.near_vectors(vector_frame(spark, rows), least=0.98).collect()
    expected = brute_vectors(rows, 0.98)
    assert Counter((r.id, r.n_links, r.component_id, r.kept) for r in found) == expected
    assert max(n for _, n, _, _ in expected) > 30
    assert sum(not kept for *_, kept in expected.elements()) > 60


def test_near_vectors_at_the_threshold(spark):
    """A cosine of exactly the threshold links, whichever way it was rotated."""
    a = [1.0, 0.0, 0.0, 0.0]
    rows = [(1, a, 1), (2, [3.0, 4.0, 0.0, 0.0], 1), (3, [30.0, 0.0, 40.0, 0.0], 1), (4, [3.0, 0.0, 0.0, 4.00000001], 1)]
    found = {r.id: (r.n_links, r.component_id) for r in tiled_cosine.near_vectors(vector_frame(spark, rows), least=0.6).collect()}
    assert found == {1: (2, 1), 2: (1, 1), 3: (1, 1), 4: (0, 4)}


def test_near_vectors_of_text_ids_and_nothing(spark):
    shape = "vec_id string, embedding array<float>, label string"
    rows = [("b", [1.0, 0.0], "s"), ("a", [1.0, 0.01], "s"), ("c", [1.0, 0.0], "t")]
    found = {r.id: (r.n_links, r.component_id, r.kept) for r in tiled_cosine.near_vectors(spark.createDataFrame(rows, shape)).collect()}
    assert found == {"a": (1, "a", True), "b": (1, "a", False), "c": (0, "c", True)}
    assert tiled_cosine.near_vectors(spark.createDataFrame([], shape)).count() == 0


@pytest.mark.parametrize("width", [5, 64, 100])
def test_tiles_equal_all_pairs(width):
    rng = np.random.default_rng(width)
    base = rng.normal(size=(40, width))
    x = np.repeat(base, 15, axis=0) + rng.normal(scale=0.12, size=(600, width))
    unit = tiled_cosine._unit(x)
    _, axes = np.linalg.eigh(unit.T @ unit)
    side = tiled_cosine.Side(unit @ axes[:, ::-1], x)
    n, m, forest = tiled_cosine.block_links(side, side, np.ones(600, int), np.ones(600, int), True, 0.98)
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    assert (n + m == near.sum(axis=1)).all() and near.any()
    assert (forest.roots(np.arange(600))[np.nonzero(near)[0]] == forest.roots(np.arange(600))[np.nonzero(near)[1]]).all()


def test_axes_come_in_order_and_early_stops_happen(spark):
    rng = np.random.default_rng(1)
    rows = [(i, list(map(float, rng.normal(size=12) * np.geomspace(1, 0.01, 12)[::-1])), 1) for i in range(200)]
    classes = vector_frame(spark, rows).selectExpr("12 as width", "embedding as v")
    axes = tiled_cosine.principal_axes(classes)[12]
    x = tiled_cosine._unit(np.array([r[1] for r in rows])) @ axes
    energy = (x * x).sum(axis=0)
    assert (np.diff(energy) <= 1e-9).all() and np.allclose(axes.T @ axes, np.eye(12))


# --- filter audit

DOCS = "doc_id long, text string, source string, part string, mask int, docs int, id string, digest string, first int, c int, good int"


def brute_audit(docs, labels):
    blanks = " \t\n\x0b\x0c\r"

    def words(t):
        for b in blanks:
            t = t.replace(b, " ")
        return [w for w in t.split(" ") if w]

    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x in labels if i is not None and x == 1}
    first = {}
    for doc, text, _ in docs:
        if doc is not None:
            first[text or ""] = min(doc, first.get(text or "", doc))
    rows = []
    for doc, text, source in docs:
        t = text or ""
        w = words(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t)}
        fails |= {"D": any(c in "#$%&*|" for c in t), "E": doc is not None and first[t] < doc}
        rows.append((source or "", {f for f, x in fails.items() if x}, doc in good, doc in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        removed_by = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                removed_by[f] += len(gone)
                out[part, "".join(order), step] = (
                    len(left), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)
                )
        for key in out:
            if key[0] == part:
                out[key] = out[key][:6] + (removed_by[key[1][key[2] - 1]],)
    return out


def audit_rows(seed=2, n=150):
    rnd = random.Random(seed)
    texts = ["", None, "\x0b \t", "Ab " * 250, "aé " * 300, "#" * 3]
    for _ in range(25):
        size = rnd.choice([5, 120, 199, 200, 400])
        texts.append(" ".join(rnd.choice(["a", "b", "Cd", "é€", "$", "w%d" % rnd.randrange(500), "x%d" % rnd.randrange(500)]) for _ in range(size)))
    docs = [(rnd.randrange(10 * n), rnd.choice(texts), rnd.choice(["s", "t", "", None])) for _ in range(n)]
    docs += [(None, texts[3], "s"), (None, None, None), (5, texts[7], "s"), (5, texts[7], "t"), (6, texts[7], "only")]
    labels = [(rnd.randrange(10 * n), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(n)]
    labels += [(d, 1, 0) for d, _, _ in docs[::3]] + [(d, 0, 1) for d, _, _ in docs[::5]] + [(None, 1, 1)]
    return docs, labels


def test_audit_of_documents(spark):
    docs, labels = audit_rows()
    frame = spark.createDataFrame([(*d, "p", 1, 2, "x", "y", 3, 4, 5) for d in docs], DOCS)
    marks = spark.createDataFrame([(*x, "text") for x in labels], "doc_id long, quality int, toxic int, text string")
    found = filter_audit.audit_documents(frame, marks).collect()
    told = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found}
    expected = brute_audit(docs, labels)
    assert len(found) == len(told) == 600 * 4
    assert told == expected
    none = filter_audit.audit_documents(frame.limit(0), marks.limit(0))
    assert none.count() == 0


def test_lattice_counts_every_order():
    for n in (1, 2, 4, 6):
        lattice = filter_audit.Lattice(list("ABCDEF"[:n]))
        assert lattice.reach[lattice.full] == lattice.leave[0] == math.factorial(n)
        assert all(sum(w for i, _, w in lattice.edges if i == f) == math.factorial(n) for f in range(n))
        assert len(lattice.paths()) == n * math.factorial(n)


def test_audit_takes_any_filters(spark):
    rows = spark.range(10).selectExpr("id", "cast(null as string) as part")
    from pyspark.sql import functions as F

    found = filter_audit.audit(rows, F.col("part"), {"low": F.col("id") < 3, "odd": F.col("id") % 2 == 1, "never": F.lit(None).cast("boolean")}, {})
    told = {(r.filter_order, r.step): (r.kept, r.removed, r.shapley) for r in found.collect()}
    assert told["lowoddnever", 1] == (7, 3, 15) and told["oddlownever", 2] == (3, 2, 15) and told["neverlowodd", 3] == (3, 4, 27)
    with pytest.raises(ValueError):
        filter_audit.audit(rows, F.col("part"), {}, {})


# --- periodic runs


def brute_runs(w, times=4, least=6):
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def collapsed(w, runs):
    return [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]


def run_texts(seed, n):
    rnd = random.Random(seed)
    texts = []
    for _ in range(n):
        kinds = rnd.choice([1, 2, 3, 8, 60])
        words = []
        for _ in range(rnd.choice([0, 1, 3, 8])):
            piece = [rnd.choice("abcdefgh"[: min(kinds, 8)]) + (str(rnd.randrange(kinds)) if kinds > 8 else "") for _ in range(rnd.choice([1, 2, 3, 5, 9]))]
            words += piece * rnd.choice([1, 2, 3, 4, 5, 7]) + piece[: rnd.randrange(len(piece))]
        texts.append("".join(w + rnd.choice([" ", "\n", "  ", "\t\x0b"]) for w in words))
    return texts


def test_periodic_runs(spark):
    texts = run_texts(5, 400) + [None, "", "  \r\n", "é " * 6, "é " * 5, "a a " * 9, ("x y " * 3 + "x"), "ha " * 3000 + "end " + "b c d " * 900]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "q " * 8, 1, "x"), (3, "q " * 8, 1, "x"), (3, "q " * 8, 1, "x")]
    found = periodic_runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, runs int, n_words string")).collect()
    blanks = str.maketrans("\t\n\x0b\x0c\r", "     ")
    expected, some = Counter(), 0
    for doc, text, *_ in rows:
        w = [x for x in (text or "").translate(blanks).split(" ") if x]
        runs = brute_runs(w)
        some += len(runs)
        expected[doc, len(w), tuple(runs), " ".join(collapsed(w, runs))] += 1
    assert Counter((r.id, r.n_words, tuple((x.start, x.length, x.period) for x in r.runs), r.collapsed) for r in found) == expected
    assert some > 200


@pytest.mark.parametrize("kinds", [1, 2, 3])
def test_all_runs_of_dense_words(kinds):
    """Strings over few words, where runs nest, overlap and touch."""
    import pyarrow as pa

    rnd = random.Random(kinds)
    for _ in range(300):
        w = [rnd.choice("abc"[:kinds]) for _ in range(rnd.randrange(60))] * rnd.choice([1, 1, 4])
        found = periodic_runs.runs_of(pa.array(w, pa.string()), np.zeros(len(w), int), 4, 6)
        assert [(a, b - a, q) for a, b, q in found.tolist()] == brute_runs(w)


def test_a_rare_word_splits_and_stable_segments_stay():
    codes = np.array([0, 0, 0, 0, 0, 0, 9, 1, 2, 1, 2, 1, 2, 1, 2, 0, 0])
    bounds = periodic_runs.frequent_segments(codes, np.zeros(len(codes), int), 4, 6)
    assert bounds.tolist() == [[0, 6], [7, 15]]


def test_long_texts_do_not_take_quadratic_time():
    import time

    started = time.time()
    codes = np.r_[np.zeros(200_000, int), np.tile(np.arange(5000), 40), np.random.default_rng(0).integers(0, 300, 200_000)]
    bounds = periodic_runs.frequent_segments(codes, np.zeros(len(codes), int), 4, 6)
    found = periodic_runs.lag_scan(codes, bounds, 4, 6)
    assert (200_001, 400_000, 5000) in found or (200_000, 400_000, 5000) in found
    assert time.time() - started < 60


def test_planted_runs_and_the_query(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(i, " \t".join("w%d" % rnd.randrange(40) for _ in range(rnd.choice([0, 1, 7, 50, 120])))) for i in range(300)] + [(None, "a b"), (301, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    expected, planted = Counter(), 0
    for doc, text in rows:
        w = (text or "").replace("\t", " ").split()
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and w:
            planted += 1
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        runs = brute_runs(w)
        sha = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        rest = hashlib.sha256(" ".join(collapsed(w, runs)).encode()).hexdigest()
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        told = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        expected[doc, len(runs), *told, sha, rest] += 1
    assert Counter((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in found) == expected
    assert planted > 15 and sum(n > 0 for _, n, *_ in expected) > 3
