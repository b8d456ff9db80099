"""Similarity joins against all pairs."""

import random

import numpy as np
import pytest

from foreglass.operators import similar as S
from foreglass.operators.linkage import jaro_winkler_scores


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        before = row
    return before[-1]


def words(rnd, n, letters, longest):
    out = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(longest))) for _ in range(n // 2)]
    while len(out) < n:  # edited copies
        w = list(rnd.choice(out))
        for _ in range(rnd.randrange(4)):
            at = rnd.randrange(len(w) + 1)
            w[at : at + rnd.randrange(2)] = rnd.choice(["", rnd.choice(letters)])
        out.append("".join(w))
    return out


@pytest.mark.parametrize("most", [1, 2, 3])
def test_banded_distances(most):
    rnd = random.Random(most)
    pairs = [(rnd.choice(ws), rnd.choice(ws)) for ws in [words(rnd, 300, "abé", 9)] for _ in range(2000)]
    a, size_a = S.code_rows([x for x, _ in pairs])
    b, size_b = S.code_rows([y for _, y in pairs])
    assert S.edit_distances(a, size_a, b, size_b, most).tolist() == [min(distance(x, y), most + 1) for x, y in pairs]


@pytest.mark.parametrize("most, q, limit", [(1, 2, 4000), (2, 2, 10), (2, 3, 50), (3, 3, 4000)])
def test_similar_strings_find_every_pair(spark, most, q, limit):
    rnd = random.Random(most * 10 + q)
    rows = [(rnd.choice(["k", "l"]), w) for w in words(rnd, 160, "abcdeé€𝄞", 16) + ["aaaaaa", "aaaaaaa", "aaaabaaa", "", "a"]]
    rows += [("k", "hot"), ("k", "hot"), ("k", "hat"), ("l", None), (None, "hot")]
    df = spark.createDataFrame(rows, "key string, name string")
    found = S.similar_strings(df, "name", most, ["key"], q=q, limit=limit).collect()
    n = {}
    for row in rows:
        n[row] = n.get(row, 0) + 1
    values = sorted(v for v in n if None not in v)
    want = {
        (k, a, b): (n[k, a], n[k, b], distance(a, b)) for k, a in values for j, b in values if k == j and a < b and abs(len(a) - len(b)) <= most and distance(a, b) <= most
    }
    got = {(r.key, r.a, r.b): (r.n_a, r.n_b, r.distance) for r in found}
    assert len(got) == len(found) and got == want
    assert len(want) > 60


def test_similar_strings_without_blocks(spark):
    df = spark.createDataFrame([("oil will rise",), ("oil will raise",), ("oil wil rise",), ("gas",), (None,), ("gass",)], "name string")
    assert {(r.a, r.b, r.distance) for r in S.similar_strings(df, "name", 2).collect()} == {
        ("oil will raise", "oil will rise", 1), ("oil wil rise", "oil will rise", 1), ("oil wil rise", "oil will raise", 2), ("gas", "gass", 1),
    }
    assert S.similar_strings(df.limit(0), "name", 2).count() == 0


def brute_records(rows, least):
    values = sorted({(k, a, b) for _, k, a, b in rows if None not in (k, a, b)})
    out = {}
    for i, (k, a, b) in enumerate(values):
        for j, c, d in values[i + 1 :]:
            if j == k:
                score = sum(jaro_winkler_scores([a, b], [c, d])) / 2
                if score >= least:
                    out[k, a, c, b, d] = round(float(score), 9)
    return out


@pytest.mark.parametrize("least, limit", [(0.7, 1024), (0.85, 16)])
def test_similar_records_find_every_pair(spark, least, limit):
    rnd = random.Random(7)
    rows = [(i, rnd.choice("kl"), a, rnd.choice(["small", "smell", "large", ""])) for i, a in enumerate(words(rnd, 120, "abcdxy", 12))]
    rows += [(500, "k", None, "small"), (501, None, "a", "small"), (502, "k", "", ""), (503, "k", "", "")]
    df = spark.createDataFrame(rows, "i long, key string, name string, kind string")
    found = S.similar_records(df, ["key"], ["name", "kind"], least, limit).collect()
    want = brute_records(rows, least)
    got = {(r.key, r.name_a, r.name_b, r.kind_a, r.kind_b): round(r.score, 9) for r in found}
    assert len(found) == len(got) and got == want
    assert len(want) > 100


def test_upper_bounds_are_never_too_low():
    rnd = random.Random(3)
    values = words(rnd, 200, "abcdé", 10)
    a, b = np.array([rnd.randrange(200) for _ in range(3000)]), np.array([rnd.randrange(200) for _ in range(3000)])
    exact = jaro_winkler_scores([values[x] for x in a], [values[y] for y in b])
    assert (S._upper_bounds(values)(a, b) >= exact - 1e-9).all()


def test_resolved_records(spark):
    rows = [(5, "k", "amazon", "x"), (2, "k", "amazom", "x"), (9, "k", "amazon", "x"), (4, "k", "amazan", "x"), (1, "l", "amazon", "x"), (7, "k", "shell", "y"), (8, None, "a", "b")]
    df = spark.createDataFrame(rows, "i long, key string, name string, kind string")
    got = {r.i: r.group for r in S.resolved(df, "i", ["key"], ["name", "kind"], 0.9).collect()}
    assert got == {5: 2, 2: 2, 9: 2, 4: 2, 1: 1, 7: 7, 8: 8}
