"""Documents as a stream. The batch operators are row-local, so a stream runs the same expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import language, text, timing
from leafmill.operators import segmentation

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def read_documents(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files of documents as they arrive in a folder."""
    return spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def info(docs: DataFrame) -> DataFrame:
    """Words, narration time and language of each arriving document; stateless."""
    words = text.word_count(F.col("text")).cast("long")
    rows = docs.select("doc_id", "source", words.alias("words"), language.detect_language(F.col("text")).alias("language"))
    return rows.withColumn("seconds", timing.estimate_seconds(F.col("words")))


def chunks(docs: DataFrame, most: int = 900) -> DataFrame:
    """Chunks of each arriving document, numbered; stateless."""
    found = segmentation.chunks(segmentation.document_paragraphs(F.col("text")), most)
    return docs.select("doc_id", F.posexplode(found).alias("chunk_no", "c")).select("doc_id", "chunk_no", "c.text", "c.ends_paragraph")


def language_totals(docs: DataFrame) -> DataFrame:
    """Documents and words by language so far; the state is one row a language."""
    return info(docs).groupBy("language").agg(F.count("*").alias("documents"), F.sum("words").alias("words"))


def write(stream: DataFrame, path: str, checkpoint: str):
    """Append a stateless stream to Parquet, each file taken once; ends when what is there has been read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
