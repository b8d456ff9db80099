import json
import random

import pytest

from foreglass.sources import ranges as R, scans as S, sinks as W

CSV = "a string, b string, c string"


def set_range(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")


@pytest.fixture
def small_ranges(spark):
    yield lambda size: set_range(spark, size)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def cell(rng):
    kinds = ["x", "", "two words", 'say ""hi""', "line\nbreak", "a,b", "\n\n", "é" * rng.randint(1, 30), '""', 'end""\n""']
    text = rng.choice(kinds)
    return f'"{text}"' if any(c in text for c in ',"\n') or rng.random() < 0.2 else text


def csv_text(seed, end="\n"):
    rng = random.Random(seed)
    lines = ["a,b,c", *(",".join([f"id{i}", cell(rng), cell(rng)]) for i in range(18)), "", 'u5" pipe,plain "quotes",z', 'v"w"x,"p"q,r']
    return end.join(lines) + (end if seed % 2 else "")


@pytest.mark.parametrize("size", [53, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_rows_are_those_of_the_one_task_reader(spark, tmp_path, small_ranges, size, end):
    for i in range(2):
        (tmp_path / f"f{i}.csv").write_bytes(csv_text(i, end).encode())
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "header.csv").write_bytes(b"a,b,c\n")
    expected = sorted_rows(S.read_table_file(spark, str(tmp_path), CSV, sep=",", line_breaks_in_cells=True))
    small_ranges(size)
    found = R.read_csv_in_ranges(spark, str(tmp_path), CSV)
    if size < 100:
        assert R._units(spark, str(tmp_path), b"\n").rdd.getNumPartitions() > 8
    assert sorted_rows(found) == expected and len(expected) >= 36


def test_a_record_over_many_ranges_and_a_header_over_two(spark, tmp_path, small_ranges):
    long = "\n".join(f"line {i}, with a comma" for i in range(20))
    text = f'"a\nb",b,c\n1,"{long}",x\n2,y,"{long}"\n\n3,z,"open\nto the end'
    (tmp_path / "f.csv").write_text(text)
    for size in (61, 333):
        small_ranges(size)
        rows = {r.a: r for r in R.read_csv_in_ranges(spark, str(tmp_path), CSV).collect()}
        assert set(rows) == {"1", "2", "3"} and rows["1"].b == long and rows["2"].c == long
        assert "open\nto the end" in rows["3"].c


def test_ranges_that_change_before_reading_are_refused(spark, tmp_path, small_ranges):
    (tmp_path / "f.csv").write_text(csv_text(4))
    small_ranges(50)
    found = R.read_csv_in_ranges(spark, str(tmp_path), CSV)
    small_ranges(77)
    with pytest.raises(Exception, match="have changed since"):
        found.collect()


def objects(seed, n=14):
    rng = random.Random(seed)
    words = ['a "quoted" }{ word', "back\\slash", "br]ack[ets", "", "é ", '\\"', "}", "{", "line\nbreak"]
    return [
        {"id": i, "text": rng.choice(words) * rng.randint(0, 3), "tags": [rng.choice(words) for _ in range(rng.randint(0, 3))], "in": {"x": {"y": i}, "s": rng.choice(words)}}
        for i in range(n)
    ]


@pytest.mark.parametrize("size", [151, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_json_array_rows_are_those_of_the_one_task_reader(spark, tmp_path, small_ranges, size, indent):
    schema = "id long, text string, tags array<string>, in struct<x: struct<y: long>, s: string>"
    for i in range(2):
        (tmp_path / f"f{i}.json").write_text(json.dumps(objects(i), indent=indent, ensure_ascii=bool(i)))
    for name, text in (("none.json", "[]"), ("blank.json", " [ \n ]\n"), ("one.json", '[{"id": 500}]\n'), ("nothing.json", "")):
        (tmp_path / name).write_text(text)
    expected = sorted_rows(S.read_json_array(spark, str(tmp_path), schema))
    small_ranges(size)
    assert sorted_rows(R.read_json_array_in_ranges(spark, str(tmp_path), schema)) == expected
    assert len(expected) == 29


def test_arrays_written_by_many_tasks_are_json(spark, tmp_path):
    rows = spark.range(50).selectExpr("id", "concat('t}\"', id) as text").repartition(3)
    W.write_json_arrays(rows.unionByName(rows.limit(0)), str(tmp_path / "out"))
    parts = [json.loads(p.read_text()) for p in sorted((tmp_path / "out").glob("part-*"))]
    assert sorted(r["id"] for p in parts for r in p) == list(range(50))
    again = R.read_json_array_in_ranges(spark, str(tmp_path / "out"), "id long, text string")
    assert sorted_rows(again) == sorted_rows(rows)
