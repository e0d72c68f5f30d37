import time

from pyspark.sql import functions as F

from leafmill.streaming.progress import JobProgress, counted_write

SF = "/root/testdata/sf0.001"


def test_shares_of_a_streamed_run_rise_to_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    source = str(tmp_path / "in")
    docs.repartition(6).write.parquet(source)
    chars = docs.agg(F.sum(F.length("text"))).first()[0]
    told = []
    job = JobProgress("speech", chars, told.append)
    spark.streams.addListener(job)
    try:
        stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = job.counted(stream, F.length("text")).select("doc_id").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        for _ in range(100):
            if told and told[-1] == 1.0:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(job)
    assert len(told) >= 6 and told == sorted(told) and told[-1] == 1.0 and 0 < told[0] < 1
    assert job.done == chars and spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


def test_work_of_a_batch_job(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    done = counted_write(docs, lambda d: d.select("doc_id").write.parquet(str(tmp_path / "o")), F.length("text"))
    assert done == docs.agg(F.sum(F.length("text"))).first()[0]


def test_nothing_to_do():
    job = JobProgress("none", 0)
    assert job.done == 0 and job.shares == []
