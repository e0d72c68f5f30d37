"""Calls of slow outside models: each distinct request once, kept in a table, a few in flight at a time."""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEPT = "key string, result string"


def request_key(request: Column, version: str) -> Column:
    """What a result is kept under: a digest of the request and of the model that answers it."""
    return F.sha2(F.concat(F.lit(f"{version}\n"), request).cast("binary"), 256)


def _kept(spark: SparkSession, path: str) -> DataFrame:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(KEPT).parquet(f"{path}/run-*").where("result is not null") if there else spark.createDataFrame([], KEPT)


def cached_calls(rows: DataFrame, request: str, call: Callable[[str], str], path: str, version: str = "1", window: int = 4, attempts: int = 2) -> tuple[DataFrame, DataFrame]:
    """[B3, B4, B5] ``rows`` with ``result`` (text) of a call for their ``request``, and (request, error) of the calls that failed.

    Results stand in a table of Parquet files below ``path``, under a digest of ``version`` and request. Of the distinct requests that are
    not there yet, each is called once; a task has at most ``window`` calls in flight and gives results in the order of its requests, so it holds
    no more than that many. A task's results are kept when its job has succeeded with them, in a folder of the run that no reader sees
    before; a task that is lost makes its own calls again, no other. A call that fails ``attempts`` times is a row of the second table,
    keeps nothing and is tried again next time; its rows have a null result, as rows of null requests have. The same
    request in many rows is one call, and no group of rows meets in a task: results come back by a join that Spark splits where one request is in most rows.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("__key", request_key(F.col(request), version))
    asked = keyed.where(F.col(request).isNotNull()).groupBy("__key").agg(F.first(request).alias("__request"))
    new = asked.join(_kept(spark, path), F.col("__key") == F.col("key"), "left_anti").select("__key", "__request")

    def one(text: str) -> tuple[str | None, str | None]:
        error = None
        for _ in range(attempts):
            try:
                return str(call(text)), None
            except Exception as e:  # whatever a foreign model raises
                error = f"{type(e).__name__}: {e}"[:300]
        return None, error

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(window) as pool:
            flying: deque[tuple[str, str, Future]] = deque()
            done: list[tuple] = []

            def landed() -> None:
                key, text, future = flying.popleft()
                result, error = future.result()
                done.append((key, result, text if error else None, error))

            for batch in it:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    flying.append((key, text, pool.submit(one, text)))
                    if len(flying) >= window:
                        landed()
                    if len(done) >= 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done, strict=True)], ["key", "result", "request", "error"])
                        done = []
            while flying:
                landed()
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done, strict=True)], ["key", "result", "request", "error"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    called = new.repartition(tasks, "__key").mapInArrow(batches, f"{KEPT}, request string, error string")
    run = uuid.uuid4().hex
    called.write.parquet(f"{path}/_run-{run}")  # folders that begin so are not read
    jvm = spark.sparkContext._jvm
    source, target = (jvm.org.apache.hadoop.fs.Path(f"{path}/{name}") for name in (f"_run-{run}", f"run-{run}"))
    source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(source, target)
    errors = spark.read.schema(f"{KEPT}, request string, error string").parquet(f"{path}/run-{run}").where("error is not null").select("request", "error")
    kept = _kept(spark, path).groupBy("key").agg(F.first("result").alias("result"))
    out = keyed.drop("result").join(kept, F.col("__key") == F.col("key"), "left").drop("__key", "key")
    return out, errors
