import random

import pytest
from pyspark.sql import functions as F

from foreglass import scale as S


def hot_rows(spark, n=3000):
    """Two thirds of the rows belong to one key."""
    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < 0.66 else f"k{rnd.randrange(9)}", rnd.randrange(500), i, rnd.randrange(7)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, t int, i int, v int").repartition(5, "i")


@pytest.mark.parametrize("partitions", [1, 4, 40])
def test_running_total(spark, partitions):
    rows, df = hot_rows(spark)
    total = S.running_total(df, ["k"], ["t", "i"], F.col("v"), "total", partitions)
    want, sums = {}, {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        sums[k] = sums.get(k, 0) + v
        want[(k, i)] = sums[k]
    assert total.columns == [*df.columns, "total"]
    assert {(r.k, r.i): r.total for r in total.collect()} == want


@pytest.mark.parametrize("partitions", [1, 4, 40])
def test_missing_keys_and_text_order(spark, partitions):
    """NULL keys are a key, NULL orders come first, text orders by code point, missing values add nothing."""
    rnd = random.Random(9)
    rows = [(rnd.choice(["a", None]), rnd.choice([None, "x", "é", "z" * 3]), i, rnd.choice([1, None])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, s string, i int, v int")
    got = {r.i: (r.n, r.total) for r in S.positions(S.running_total(df, ["k"], ["s", "i"], F.col("v"), "total", partitions), ["k"], ["s", "i"], "n", partitions).collect()}
    want, n, sums = {}, {}, {}
    for k, s, i, v in sorted(rows, key=lambda r: (r[0] or "", r[1] is not None, r[1] or "", r[2])):
        n[k], sums[k] = n.get(k, 0) + 1, sums.get(k, 0) + (v or 0)
        want[i] = (n[k], sums[k])
    assert got == want
    assert sorted(r.n for r in S.positions(df, [], ["s"], "n", partitions).collect()) == list(range(1, 201))


def test_equal_rows_are_spread(spark):
    df = spark.range(2000).select(F.lit("same").alias("k"), F.lit(1).alias("t"))
    parts = S.in_order(df, ["k"], ["t"], 8).groupBy("_part").count().collect()
    assert len(parts) == 8 and max(r["count"] for r in parts) < 600
    assert sorted(r.n for r in S.positions(df, ["k"], ["t"], "n", 8).collect()) == list(range(1, 2001))


def test_look_back_over_block_borders(spark):
    rows, df = hot_rows(spark, 400)
    looked = S.look_back(df, ["k"], ["t", "i"], {"a": ("v", 1), "c": ("v", 3)}, partitions=5)
    got = {(r.k, r.i): (r.a, r.c, r._position) for r in looked.collect()}
    assert len(got) == 400
    series = {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        seen = series.setdefault(k, [])
        assert got[(k, i)] == (
            seen[-1] if seen else None, seen[-3] if len(seen) > 2 else None, len(seen) + 1,
        )
        seen.append(v)


def test_quota_is_exact_per_class(spark):
    rows, df = hot_rows(spark)
    quotas = df.groupBy("k").agg(F.floor(F.count("*") * 0.3).alias("quota"))
    marked = S.mark_quota(df, "k", quotas, "i", 7, "taken", digits=1)
    got = {r.k: (r.n, r.taken) for r in marked.groupBy("k").agg(F.count("*").alias("n"), F.count_if("taken").alias("taken")).collect()}
    assert all(taken == int(n * 0.3) for n, taken in got.values())
    again = S.mark_quota(df.repartition(3), "k", quotas, "i", 7, "taken")
    assert sorted(marked.filter("taken").select("i").collect()) == sorted(again.filter("taken").select("i").collect())


def test_zero_and_full_quota(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, i int")
    quotas = spark.createDataFrame([("a", 0), ("b", 1)], "k string, quota int")
    assert [r.i for r in S.mark_quota(df, "k", quotas, "i", 1, "t").filter("t").collect()] == [3]


def test_broadcast_only_when_small(spark):
    df = spark.range(50).withColumn("text", F.repeat(F.lit("x"), 1000))
    assert S.value_bytes(df) > 50_000
    assert "broadcast" in S.broadcast_if_small(df, 100_000)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in S.broadcast_if_small(df, 50_000)._jdf.queryExecution().logical().toString().lower()
    with pytest.raises(ValueError):
        S.rows_within(df, 49)


def test_plain_quota(spark):
    df = spark.range(500).repartition(4)
    taken = [S.mark_rows(df, q, "id", 3, "t", digits=d).filter("t") for q, d in ((120, 1), (120, 4))]
    assert taken[0].count() == 120
    assert sorted(taken[0].collect()) == sorted(taken[1].collect())
    assert S.mark_rows(df, 0, "id", 3, "t").filter("t").count() == 0
    assert S.mark_rows(df, 500, "id", 3, "t").filter("t").count() == 500


def test_local_folders_are_no_shared_ones():
    from foreglass.scale import _reachable

    assert _reachable("file:/w", "local[4]") and _reachable("/w", "local") and _reachable("hdfs://n/w", "yarn")
    assert not _reachable("file:/w", "yarn") and not _reachable("/w", "spark://h:7077") and not _reachable("spark-warehouse/_shared", "local-cluster[2,1,900]")
