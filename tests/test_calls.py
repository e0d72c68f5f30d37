import os
import pathlib
import pickle
import time

import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from leafmill.operators import calls
from leafmill.plans import basics
from leafmill.sources import named


def counted(folder, fail=""):
    """A model that leaves a file for each call, with its answer."""

    def call(text):
        n = len(os.listdir(folder))
        pathlib.Path(folder, f"{abs(hash(text))}-{time.time_ns()}-{n}").write_text(text)
        if fail and fail in text:
            raise ValueError("no answer")
        return text.upper()

    return call


def test_each_request_is_called_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    rows = spark.createDataFrame([(k, None if k % 10 == 9 else f"text {k % 7}") for k in range(200)], "id int, t string").repartition(5)
    cache = f"file://{tmp_path}/cache"
    out, errors = calls.cached_calls(rows, "t", counted(str(log)), cache)
    want = {k: None if k % 10 == 9 else f"TEXT {k % 7}" for k in range(200)}
    assert {r.id: r.result for r in out.collect()} == want and errors.count() == 0
    assert sorted(p.read_text() for p in log.iterdir()) == [f"text {k}" for k in range(7)]
    again, _ = calls.cached_calls(rows, "t", counted(str(log)), cache)
    assert {r.id: r.result for r in again.collect()} == want and len(list(log.iterdir())) == 7
    calls.cached_calls(rows, "t", counted(str(log)), cache, version="2")
    assert len(list(log.iterdir())) == 14


def test_failures_are_rows_and_are_tried_again(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    rows = spark.createDataFrame([("good 1",), ("bad 2",), ("good 3",), ("bad 2",)], "t string")
    out, errors = calls.cached_calls(rows, "t", counted(str(log), "bad"), f"file://{tmp_path}/c")
    assert sorted((r.t, r.result) for r in out.collect()) == [("bad 2", None), ("bad 2", None), ("good 1", "GOOD 1"), ("good 3", "GOOD 3")]
    assert [tuple(r) for r in errors.collect()] == [("bad 2", "ValueError: no answer")] and len(list(log.iterdir())) == 4
    out, errors = calls.cached_calls(rows, "t", counted(str(log)), f"file://{tmp_path}/c")
    assert errors.count() == 0 and {r.result for r in out.collect()} == {"GOOD 1", "BAD 2", "GOOD 3"} and len(list(log.iterdir())) == 5


def test_calls_overlap_within_the_window(spark, tmp_path):
    rows = spark.range(24).select(F.col("id").cast("string").alias("t"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        began = time.perf_counter()
        out, _ = calls.cached_calls(rows, "t", lambda t: time.sleep(0.5) or t, f"file://{tmp_path}/c", window=8)
        took = time.perf_counter() - began
        assert out.where("result = t").count() == 24 and took < 11.5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_an_empty_table(spark, tmp_path):
    out, errors = calls.cached_calls(spark.createDataFrame([], "t string"), "t", str, f"file://{tmp_path}/c")
    assert out.count() == 0 and errors.count() == 0


def test_named_files_hold_their_rows_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(f"{k % 5:02d} - T/{k % 5}.srt", k, f"line {k}\n" if k % 11 else None) for k in range(3000)] + [(None, 1, "x")], "file string, n int, text string").repartition(7)
    named.write_named(rows, str(tmp_path / "out"), "file", ["n"], "text")
    found = {p.name: p.read_text() for p in (tmp_path / "out").iterdir()}
    assert found == {f"{k:02d} - T-{k}.srt": "".join(f"line {n}\n" for n in range(k, 3000, 5) if n % 11) for k in range(5)}
    named.write_named(rows.where("n < 0"), str(tmp_path / "none"), "file", ["n"], "text")
    assert list((tmp_path / "none").iterdir()) == []


def test_a_job_that_fails_leaves_no_file(spark, tmp_path):
    rows = spark.range(100).select(F.concat(F.lit("f"), F.col("id") % 4).alias("file"), F.col("id").alias("n"), F.when(F.col("id") == 97, F.raise_error(F.lit("stop")).cast("string")).otherwise("x").alias("text"))
    with pytest.raises(Exception, match="stop"):
        named.write_named(rows, str(tmp_path / "out"), "file", ["n"], "text")
    assert not (tmp_path / "out").exists() or list((tmp_path / "out").iterdir()) == []


def test_the_driver_holds_no_entry_a_file(spark, tmp_path):
    """What a task sends and what the query reads in the driver does not follow the number of files."""
    (tmp_path / "sent").mkdir()
    batch = pa.RecordBatch.from_pylist([{"name": f"a name of some length {k}.srt", "content": b"x"} for k in range(2000)])
    assert len(pickle.dumps(named._Writer(f"file://{tmp_path}/sent", "job").write(iter([batch])))) < 2000
    out = basics.srt_files(spark, "/root/testdata/sf0.001")
    assert out.count() == 200 and len(out.inputFiles()) < 20


def test_files_are_moved_once_and_taken_back(spark, tmp_path):
    """A task that is run again finds files at their names; if files can't be moved, none stays."""
    system = fs.LocalFileSystem()
    (tmp_path / "a").write_text("x")
    named._move(system, f"{tmp_path}/a", f"{tmp_path}/b")
    named._move(system, f"{tmp_path}/a", f"{tmp_path}/b")
    assert (tmp_path / "b").read_text() == "x" and not (tmp_path / "a").exists()
    with pytest.raises(OSError):
        named._move(system, f"{tmp_path}/none", f"{tmp_path}/nowhere")
    rows = spark.range(40).select(F.concat(F.lit("f"), F.col("id")).alias("file"), F.col("id").alias("n"), F.lit("x").alias("text"))
    (tmp_path / "out" / "f7").mkdir(parents=True)
    (tmp_path / "out" / "f7" / "kept").write_text("there before")
    with pytest.raises(Exception, match="f7"):
        named.write_named(rows, str(tmp_path / "out"), "file", ["n"], "text")
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["f7"] and (tmp_path / "out" / "f7" / "kept").exists()
