import time

from pyspark.sql import functions as F

from foreglass.streaming import batches as B, timed as D

SCHEMA = "k bigint, n int, text string"
BIG = 2**53 + 1  # no floating-point number


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def label(rows):
    return rows.select("k", "text", F.lit(1).alias("label"))


def test_each_key_is_labelled_once_after_aging_and_a_lost_checkpoint(spark, tmp_path):
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    session = D.timed_session(spark, 2)

    def run(checkpoint):
        stream = B.watch_files(session, folder, SCHEMA, glob="*.parquet")
        D.label_stream_timed(stream, label, ["k"], out, f"{tmp_path}/{checkpoint}", 500, ["n"])
        return sorted((r.k or 0, r.text) for r in B.finished(spark, out).collect())

    arrive(spark, folder, [(BIG, 2, "second"), (BIG, 1, "first"), (BIG, None, "none"), (None, None, "z"), (None, 5, "five")])
    assert run("a") == [(0, "five"), (BIG, "first")]
    time.sleep(0.6)
    arrive(spark, folder, [(BIG, 0, "late"), (None, 0, "late"), (7, 1, "new")])
    whole = [(0, "five"), (7, "new"), (BIG, "first")]
    assert run("a") == whole  # the aged keys are found in the results
    assert run("b") == whole  # so are all keys after a lost checkpoint


def test_state_holds_recent_keys_only(spark, tmp_path):
    folder = f"{tmp_path}/in"
    session = D.timed_session(spark, 2)

    def run(keep_ms, checkpoint):
        rows = D.first_rows(B.watch_files(session, folder, SCHEMA, glob="*.parquet"), ["k"], ["n"], keep_ms)
        query = (
            rows.writeStream.format("parquet")
            .option("checkpointLocation", f"{tmp_path}/{checkpoint}")
            .trigger(availableNow=True)
            .start(f"{tmp_path}/out-{checkpoint}")
        )
        query.awaitTermination()
        return query.lastProgress["stateOperators"][0]["numRowsTotal"]

    arrive(spark, folder, [(i, 1, "old") for i in range(40)])
    assert run(500, "short") == 40
    assert run(3_600_000, "long") == 40
    time.sleep(0.6)
    arrive(spark, folder, [(i, 1, "new") for i in range(100, 103)])
    assert run(500, "short") == 3
    assert run(3_600_000, "long") == 43


def test_a_bucket_of_many_keys_takes_two_calls_on_state():
    from types import SimpleNamespace

    calls, state = [], []
    held = SimpleNamespace(
        get=lambda: calls.append("get") or iter(list(state)), appendList=lambda keys: calls.append("appendList") or state.extend(keys)
    )
    handle = SimpleNamespace(getListState=lambda name, kind, keep_ms: held)
    names = ["k", "part", "n", "at"]
    first = D._first_seen([0, 1], [2, 3], names, None, 1000)
    first.init(handle)
    clock = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 5)
    rows = [(i % 50 or None, [i % 2, None], i if i % 3 else None, i, 0) for i in range(200)] + [(float("nan"), [0], i, i, 0) for i in (2, 1)]
    wanted = {}
    for row in sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[3])):
        wanted.setdefault(str(row[:2]), (*row[:3], 5))
    found = list(first.handleInputRows((0,), iter(rows), clock))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, wanted.values()))
    assert list(first.handleInputRows((0,), iter(rows), clock)) == []
    assert calls == ["get", "appendList", "get"]
