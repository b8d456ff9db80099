import numpy as np
import pytest
from pyspark.sql import functions as F

from foreglass.operators import vector_index as VI

RNG = np.random.RandomState(3)


def planted(n=600, dims=8, groups=12):
    """Vectors around centres, with repeated rows, zeros, and some that can't be compared."""
    middle = RNG.randn(groups, dims) * 4
    rows = [(i, [float(x) for x in middle[i % groups] + RNG.randn(dims) * 0.3], f"k{i % 3}") for i in range(n)]
    rows += [(n + i, rows[5][1], "k0") for i in range(20)] + [(n + 30 + i, [0.0] * dims, "k1") for i in range(3)]
    odd = [None, [None] * dims, [float("nan")] * dims, [float("inf")] * dims, [1.0] * (dims - 1), []]
    return rows, rows + [(n + 50 + i, v, "k0") for i, v in enumerate(odd)] + [(n + 60, rows[0][1], None)]


def brute(rows, asked, k, metric, keyed):
    out = set()
    for q, v, own in asked:
        if v is None or (keyed and own is None):
            continue
        hits = []
        for r, w, other in rows:
            if keyed and other != own:
                continue
            a, b = np.array(v), np.array(w)
            if metric == "l2":
                s = -round(float(((a - b) ** 2).sum()), 6)
            else:
                s = round(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b) or 1.0)), 6)
            hits.append((-s, r))
        out |= {(q, i + 1, r) for i, (_, r) in enumerate(sorted(hits)[:k])}
    return out


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("keyed", [False, True])
def test_index_finds_what_comparing_everything_finds(spark, metric, keyed):
    rows, given = planted()
    known = rows + [(660, rows[0][1], None)]
    corpus = spark.createDataFrame(given, "row_id long, vector array<double>, key string").repartition(5)
    asked = [rows[i] for i in (0, 5, 77, 301, 620, 622)] + [(9001, [float(x) for x in RNG.randn(8) * 9], "k2"), (9002, [0.0] * 8, "k0")]
    asked = [*asked, (9003, None, "k0"), (9004, rows[3][1], None), (9005, rows[3][1], "none such")]
    queries = spark.createDataFrame(asked, "query_id long, vector array<double>, key string")
    index = VI.build_index(corpus, metric, key="key" if keyed else None)
    found = VI.search(index, queries, 7)
    assert {(r.query_id, r.rank, r.row_id) for r in found.collect()} == brute(known, asked, 7, metric, keyed)


def test_more_hits_than_a_cell_has_and_than_there_are(spark):
    rows, given = planted(60)
    corpus = spark.createDataFrame(given, "row_id long, vector array<double>, key string").drop("key")
    queries = spark.createDataFrame([(r[0], r[1]) for r in rows[:4]], "query_id long, vector array<double>")
    index = VI.build_index(corpus)
    known = rows + [(120, rows[0][1], None)]
    for k in (40, 1000):
        found = {(r.query_id, r.rank, r.row_id) for r in VI.search(index, queries, k).collect()}
        assert found == brute(known, [(*r[:2], None) for r in rows[:4]], k, "cosine", False)


def test_few_vectors_are_compared_and_the_rest_is_no_neighbour(spark):
    rows, given = planted(6000)
    corpus = spark.createDataFrame(given, "row_id long, vector array<double>, key string")
    queries = corpus.filter("row_id % 500 = 0").withColumnRenamed("row_id", "query_id")
    index = VI.build_index(corpus, "l2")
    reads = VI.search(index, queries, 5, count_reads=True)
    total = reads.agg(F.sum("scored"), F.sum("rows"), F.count("*")).first()
    assert total[2] == queries.count() and total[0] < 0.2 * total[1]


def test_empty_tables_and_string_ids(spark):
    none = spark.createDataFrame([], "row_id string, vector array<float>, key string")
    one = spark.createDataFrame([("a", [1.0, 0.0], "x")], "row_id string, vector array<float>, key string")
    ask = one.withColumnRenamed("row_id", "query_id")
    assert VI.search(VI.build_index(none), ask, 3).count() == 0
    assert VI.search(VI.build_index(one), none.withColumnRenamed("row_id", "query_id"), 3).count() == 0
    assert [r.row_id for r in VI.search(VI.build_index(one, key="key"), ask, 3).collect()] == ["a"]
    with pytest.raises(ValueError):
        VI.build_index(one, "manhattan")


def test_cells_and_keys_reach_the_scan(spark):
    rows, given = planted()
    corpus = spark.createDataFrame(given, "row_id long, vector array<double>, key string")
    index = VI.build_index(corpus, key="key")
    matrix, need = np.zeros((1, 8)), np.zeros((1, len(index.centres)), bool)
    need[0, 0] = True
    import pyarrow as pa

    ids, keys = pa.array([1]), pa.array(["k1"])
    away, reach = np.zeros(need.shape), np.zeros(1)
    plan = VI._scan(index, ids, matrix, keys, away, need, reach, reach, 3, VI._hit_shape(corpus.withColumnRenamed("row_id", "query_id"), corpus))
    text = plan._jdf.queryExecution().toString()
    assert "EqualTo(_cell,0)" in text and "EqualTo(key,k1)" in text
