import pytest
from pyspark.sql import functions as F, types as T

from foreglass.operators import learn as L
from foreglass.plans import jobs as J
from foreglass.scale import scratch_path
from foreglass.sources import scans as S, sinks as W
from foreglass.streaming import batches as B


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))


def test_batches(spark, tmp_path):
    for i in (1, 2, 10):
        write(tmp_path / "prediction_logs" / f"batch_{i}-prediction" / f"batch_{i}-from_df.csv", f"s,l\nrow {i},1\n")
    read = lambda **kw: sorted((r.batch_id, r.s) for r in S.read_batches(spark, str(tmp_path), "prediction", "s string, l int", **kw).collect())
    assert read() == [(1, "row 1"), (2, "row 2"), (10, "row 10")]
    assert read(start=2, end=9) == [(2, "row 2")]
    assert read(batches=[1, 7, 10]) == [(1, "row 1"), (10, "row 10")]
    with pytest.raises(ValueError):
        read(start=50)
    with pytest.raises(ValueError):
        S.read_table_file(spark, str(tmp_path), "s string", "xlsx")


def test_versions(spark, tmp_path):
    for name in ("runs-v9.csv", "runs-v10.csv", "runs-3.json", "other-1.csv", "plain.csv"):
        write(tmp_path / name, "x\n")
    files = S.list_files(spark, str(tmp_path))
    latest = {(r.prefix, r.extension): r.version for r in S.latest_files(files).collect()}
    assert latest == {("runs", "csv"): 10, ("runs", "json"): 3, ("other", "csv"): 1}
    assert {r.prefix: r.next_version for r in S.next_numbers(files).collect()} == {"runs": 11, "other": 2}
    folders = spark.createDataFrame([(f"e/{f}",) for f in ("seed4", "seed42", "seed42_v2", "seed42_v10", "notes")], "folder string")
    got = {r.seed: (r.version, r.folder) for r in S.latest_seed_folders(folders).collect()}
    assert got == {4: (0, "e/seed4"), 42: (10, "e/seed42_v10")}


def test_versioned_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, "a, \"b\"\nc"), (2, None)], "i int, s string")
    first = W.save_versioned(df, str(tmp_path / "out"), "t", "csv")
    second = W.save_versioned(df, str(tmp_path / "out"), "t", "csv")
    assert first.endswith("t-v1") and second.endswith("t-v2")
    back = S.read_table_file(spark, second, "i int, s string", sep=",", line_breaks_in_cells=True)
    assert sorted(map(tuple, back.collect())) == [(1, "a, \"b\"\nc"), (2, None)]
    with pytest.raises(ValueError):
        W.save_versioned(df, str(tmp_path), "t", "xlsx")
    W.save_versioned(df, str(tmp_path), "flat", "json", include_version=False)
    W.save_versioned(df, str(tmp_path), "flat", "json", include_version=False)
    assert S.read_json_lines(spark, str(tmp_path / "flat")).count() == 2


def test_odd_files(spark, tmp_path):
    write(tmp_path / "p.txt", "Profit @ home rose@positive\nCafé fell@negative\nno label\n", "latin-1")
    got = S.split_at_last(S.read_lines(spark, str(tmp_path / "p.txt"), "ISO-8859-1"), "@", ("s", "l"))
    assert sorted(map(tuple, got.collect())) == [("Café fell", "negative"), ("Profit @ home rose", "positive")]

    write(tmp_path / "tags" / "train", "1\tAda\tB-p_s\n2\tsays\tO\n\n1\toil\tB-p_t\nbad line here\n")
    good, bad = S.read_tag_lines(spark, str(tmp_path / "tags"))
    assert [r.word for r in good.orderBy("file", "line").collect()] == ["Ada", "says", None, "oil"]
    assert [r.content for r in bad.collect()] == ["bad line here"]

    write(tmp_path / "run.log", "1,a\nINFO start\n2,b \n")
    fields = S.log_to_table(S.read_lines(spark, str(tmp_path / "run.log")), ["INFO"])
    assert sorted(r.fields for r in fields.collect()) == [["1", "a"], ["2", "b"]]

    write(tmp_path / "m" / "a.tml", '<?xml version="1.0"?>\n<T>Oil <E>rose</E>\n  today.</T>')
    write(tmp_path / "m" / "b.tml", "<T></T>")
    write(tmp_path / "m" / "c.txt", "no")
    assert [tuple(r) for r in S.read_markup_files(spark, str(tmp_path / "m")).collect()] == [("Oil rose today.", "a.tml")]

    write(tmp_path / "x.csv", "1,2.5\nx,y,z\n3,4\n")
    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("v", T.DoubleType())])
    good, bad = S.read_keeping_broken(spark, str(tmp_path / "x.csv"), schema)
    assert sorted(r.i for r in good.collect()) == [1, 3] and [r[S.BROKEN] for r in bad.collect()] == ["x,y,z"]
    assert S.read_dropping_broken(spark, str(tmp_path / "x.csv"), schema).count() == 2

    write(tmp_path / "a.json", '[{"i": 1}, {"i": 2}]')
    assert S.read_json_array(spark, str(tmp_path / "a.json"), "i int").count() == 2


def test_markup_files_share_folders(spark, tmp_path):
    """A file for every row, also for equal and empty ones, in few folders."""
    out = tmp_path / "out"
    rows = spark.range(230).selectExpr("id", "if(id % 10 = 0, null, concat('<p>', id div 20, '</p>\n<b>x</b>')) as html")
    S.write_markup_files(rows, "id", "html", str(out), per_folder=50)
    files = list(out.glob("**/*.txt"))
    assert len(files) == 230 and max(len(list(f.parent.glob("*.txt"))) for f in files) <= 50
    assert len({f.parent for f in files}) < 40
    found = S.read_markup_files(spark, str(out), ".txt").groupBy("sentence").count().collect()
    want = {}
    for i in range(230):
        if i % 10:
            want[f"{i // 20} x"] = want.get(f"{i // 20} x", 0) + 1
    assert {r.sentence: r["count"] for r in found} == want


def test_stream_restart_labels_every_row_once(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    schema = "i bigint, s string"

    def add(name, rows):
        # files appear one after the other, as new batch folders do
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / name))

    label = lambda rows: rows.select("i", F.length("s").alias("label"))
    run = lambda progress: B.label_stream(
        B.watch_files(spark, str(source), schema, files_per_batch=1, glob="*.parquet"), label, ["i"], out, str(tmp_path / progress)
    )
    add("one", [(1, "a"), (2, "bb")])
    add("two", [(2, "bb"), (3, "ccc")])
    run("p1")
    add("three", [(4, "dddd"), (1, "a")])
    run("p1")  # picks up only the new file
    run("p2")  # a lost checkpoint: everything is read again
    got = sorted((r.i, r.label) for r in B.finished(spark, out).collect())
    assert got == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_failed_batch_is_redone(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    spark.range(20).selectExpr("id as i", "'x' as s").repartition(2).write.parquet(str(source))
    calls = []

    def label(rows):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return rows.select("i", F.lit(1).alias("label"))

    def run():
        stream = B.watch_files(spark, str(source), "i bigint, s string", files_per_batch=1, glob="*.parquet")
        B.label_stream(stream, label, ["i"], out, str(tmp_path / "p"))

    with pytest.raises(Exception):
        run()
    run()
    assert sorted(r.i for r in B.finished(spark, out).collect()) == list(range(20))


def test_running_counts(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    spark.range(30).selectExpr("id % 3 as a", "id % 2 as b").repartition(3).write.parquet(str(source))
    stream = B.watch_files(spark, str(source), "a bigint, b bigint", files_per_batch=1, glob="*.parquet")
    B.running_counts(stream, ["a", "b"], out, str(tmp_path / "p"))
    got = {(r.dimension, r.value): r.n for r in B.current_counts(spark, out).collect()}
    assert got == {("a", "0"): 10, ("a", "1"): 10, ("a", "2"): 10, ("b", "0"): 15, ("b", "1"): 15}


def test_models(spark):
    rows = [(i, [float(i % 10), float(i % 7)], int(i % 10 > 4)) for i in range(120)]
    df = spark.createDataFrame(rows, "i bigint, v array<double>, y int")
    outputs, summary = J.classification_experiment(df, "i", "y", "v", L.MODEL_NAMES, 42)
    assert outputs.count() == 24
    quality = {r.model: r.accuracy for r in summary.collect()}
    assert set(quality) == set(L.MODEL_NAMES) and min(quality.values()) > 0.8
    with pytest.raises(ValueError):
        L.make_model("oracle")
    ready = L.with_vector(df.withColumnRenamed("y", "label"), "v")
    folder = scratch_path(spark, "models")
    fitted = L.train_models(ready, ["logistic"], save_to=folder)
    loaded = L.load_models(folder, ["logistic"])
    unlabelled = ready.drop("label")
    assert L.predict(unlabelled, fitted).drop("features").collect() == L.predict(unlabelled, loaded).drop("features").collect()


def test_label_missing(spark, tmp_path):
    table = spark.createDataFrame([(1, "a"), (2, None), (3, None)], "i int, label string")
    new = spark.createDataFrame([(2, "b"), (1, "never")], "i int, label string")
    got = {r.i: r.label for r in J.label_missing(table, new, "i", "label").collect()}
    assert got == {1: "a", 2: "b", 3: None}
    path = J.label_missing_and_save(table, new, "i", "label", str(tmp_path / "o"), "labels")
    assert path.endswith("labels-v1") and spark.read.parquet(path).count() == 3


def test_writers_at_once_get_versions_of_their_own(spark, tmp_path):
    from multiprocessing.pool import ThreadPool

    folder = str(tmp_path / "out")
    save = lambda i: W.save_versioned(spark.range(200).withColumn("who", F.lit(i)), folder, "t", "parquet")
    with ThreadPool(4) as pool:
        paths = pool.map(save, range(4))
    assert sorted(p.rsplit("/", 1)[1] for p in paths) == ["t-v1", "t-v2", "t-v3", "t-v4"]
    for i, path in enumerate(paths):
        rows = spark.read.parquet(path)
        assert rows.count() == 200 and rows.filter(F.col("who") != i).isEmpty()
    assert {r.path.split("/out/")[1].split("/")[0] for r in S.list_files(spark, folder).collect()} == {"t-v1", "t-v2", "t-v3", "t-v4"}


def test_files_of_a_missing_folder_are_none(spark, tmp_path):
    assert S.list_files(spark, str(tmp_path / "nothing")).count() == 0


def test_counts_of_a_lost_checkpoint_start_over(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def more(n, checkpoint):
        spark.range(n).selectExpr("id % 2 as b").repartition(2).write.mode("append").parquet(source)
        stream = B.watch_files(spark, source, "b bigint", files_per_batch=1, glob="*.parquet")
        B.running_counts(stream, ["b"], out, str(tmp_path / checkpoint))
        return {r.value: r.n for r in B.current_counts(spark, out).collect()}

    assert more(10, "p") == {"0": 5, "1": 5}
    assert more(20, "p") == {"0": 15, "1": 15}
    assert more(20, "q") == {"0": 25, "1": 25}
    assert more(2, "q") == {"0": 26, "1": 26}
