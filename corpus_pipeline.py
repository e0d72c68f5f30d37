"""A corpus pipeline of five stages: toxicity, near duplicates, benchmark passages, mix, shards.

All stages but the last return the columns of the documents they get, whatever other columns these have and
whatever their names. Nulls may stand in any column, texts may be empty or of any length, rows may repeat, and tables may be
empty: each stage says what it does with them. No result depends on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import common, decontaminate, mixing, sharding, shingles, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled ones among them, does not reject.

    Null and empty texts score 0 and stay; repeated rows score alike; a null id only means that no label is
    learned from the row. Where the labels lack a class nothing can be learned, and all documents stay.
    """
    net = toxicity.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not isinstance(net, toxicity.Network):
        return docs
    return toxicity.scored(docs, net, score_col="__toxicity").where(F.col("__toxicity") < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by SimHash fingerprints, as in op1, or by a similarity of 0.8 or more in five-word shingles.

    Fingerprints link at three differing bits or fewer; near copies that lie further apart are found exactly by prefix filtering.
    Null and empty texts have no words; they are one group, of which one stays. A row is a
    document whatever other rows have its id; equal rows collapse to one. A row of null id goes if its group has a named member, and stays if it has none.
    """
    return shingles.deduplicated(docs, by_print=True)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Null and empty texts and an empty benchmark have no windows, so such documents stay; repeated rows go or stay together.
    """
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    Documents without words count for no target and stay once. A null source is a source, the last in order. Repeated
    rows are decided singly.
    """
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard, its depth and the bytes of their text (0 for null).

    Rows that agree in id and text share a shard as far as its limit lets them. Columns of these names are kept as ``given_`` and their name.
    """
    return sharding.assigned(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix),
    ("sharding", shard),
]

#: The first stage is a trained model, which SQL cannot express; tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each on what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = common.written(stage(spark, docs, sf_dir), name)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
