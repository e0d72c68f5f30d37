"""Shards under a byte limit by extendible hashing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import common

#: Bytes of text a shard may hold.
LIMIT = 16 << 20
#: Bits by which the finest cells counted are smaller than an average shard, and bits added where they are still too large.
FINER, STEP = 4, 12


def _prefix(depth: int) -> str:
    """SQL of the first ``depth`` bits of the hash ``__h``."""
    return f"shiftrightunsigned(__h, {64 - depth})" if depth else "0L"


def assigned(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with shard (its hash prefix in binary), shard_depth and shard_row_bytes.

    Extendible hashing: a directory is indexed by the first bits of a 64-bit hash of id and text. A
    bucket takes in all rows under a prefix; only one over ``limit`` bytes splits on another bit. A
    row's shard is thus the shortest prefix under which the rows fit.

    The bytes are summed by fine cells first (one small row each), the sums of all shorter prefixes
    follow from those, and each cell learns its depth. Cells that are too large themselves are
    counted again with more bits, they alone. The directory is joined to the rows, so Spark sends it
    to all tasks only if its measured size permits.

    Texts of null count no bytes. A text over the limit is a shard of its own (``+`` and its hash).
    Rows that agree in id and text have one hash, so no bit divides them: where they exceed the limit
    together they are dealt by row number, each number of rows that fits being a shard. Columns of ``docs``
    with the names of the new ones are kept as ``given_`` and their name. An empty table gives no rows.
    """
    docs = docs.withColumnsRenamed({c: f"given_{c}" for c in ("shard", "shard_depth", "shard_row_bytes") if c in docs.columns})
    columns = docs.columns
    rows = docs.withColumn("shard_row_bytes", F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")).withColumn("__h", common.hash_of(id_col, text_col))
    narrow, _ = common.written(rows.where(F.col("shard_row_bytes") <= limit).groupBy("__h").agg(F.sum("shard_row_bytes").alias("b")), "bytes")
    total = narrow.agg(F.sum("b")).first()[0] or 0
    depth = min(64, max(0, math.ceil(math.log2(max(1, total) / limit)) + FINER)) if total > limit else 0
    small = F.col("shard_row_bytes") <= limit
    rows = rows.withColumn("__depth", F.lit(None).cast("int"))
    while True:
        cells, _ = common.written(_directory(narrow, depth, limit), "directory")
        of = cells.select(F.col("cell").alias("__cell"), F.col("depth").alias("__found"))
        rows = rows.join(of, small & F.col("__depth").isNull() & (F.expr(_prefix(depth)) == F.col("__cell")), "left").withColumn("__depth", F.coalesce("__depth", "__found")).drop("__cell", "__found")
        large = cells.where("depth is null").select(F.col("cell").alias("__cell"))
        if depth == 64 or not large.limit(1).count():
            break
        narrow = narrow.join(large, F.expr(_prefix(depth)) == F.col("__cell"), "left_semi")
        depth = min(64, depth + STEP)
    bits = F.expr("substring(lpad(bin(__h), 64, '0'), 1, __depth)")
    fitting = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.lit(1), "shard_row_bytes")))
    alone = F.concat(F.lit("+"), F.lower(F.hex("__h")), F.lit("+"), F.floor(F.monotonically_increasing_id() / fitting))
    shard = F.when(F.col("__depth").isNull(), alone).when(F.col("__depth") == 0, F.lit("all")).otherwise(bits)
    return rows.select(*columns, shard.alias("shard"), F.col("__depth").alias("shard_depth"), "shard_row_bytes")


def _directory(narrow: DataFrame, depth: int, limit: int) -> DataFrame:
    """(cell, depth): for each prefix of ``depth`` bits, the least depth at which its rows fit, or null."""
    cells = narrow.select(F.expr(_prefix(depth)).alias("cell"), "b").groupBy("cell").agg(F.sum("b").alias("b"))
    steps = cells.select("cell", "b", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d"))
    steps = steps.withColumn("prefix", F.expr(f"if(d = 0, 0L, shiftrightunsigned(cell, {depth} - d))"))
    fits = steps.groupBy("d", "prefix").agg(F.sum("b").alias("b")).where(F.col("b") <= limit)
    least = steps.select("cell", "d", "prefix").join(fits.select("d", "prefix"), ["d", "prefix"]).groupBy("cell").agg(F.min("d").alias("depth"))
    return cells.select("cell").join(least, "cell", "left")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` as Parquet below ``path``, a folder for each shard."""
    assigned(docs, limit, id_col, text_col).repartition("shard").write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, shard and its depth for every document."""
    found = assigned(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), limit)
    return found.select("doc_id", F.col("shard_row_bytes").alias("n_bytes"), "shard", "shard_depth")


def sql(limit: int = LIMIT) -> str:
    """The same in DuckDB's SQL, but for texts over the limit and equal rows over it together."""
    return f"""
WITH d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n,
  lpad(bin(CAST('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, ''))), 1, 16) AS UBIGINT)), 64, '0') AS bits FROM documents),
p AS (SELECT doc_id, n, bits, depth, substr(bits, 1, depth) AS prefix FROM d, (SELECT unnest(range(0, 65)) AS depth) WHERE n <= {limit}),
f AS (SELECT depth, prefix FROM p GROUP BY depth, prefix HAVING sum(n) <= {limit}),
x AS (SELECT doc_id, n, bits, min(depth) AS depth FROM p JOIN f USING (depth, prefix) GROUP BY doc_id, n, bits)
SELECT doc_id, n AS n_bytes, CASE WHEN depth = 0 THEN 'all' ELSE substr(bits, 1, depth) END AS shard, CAST(depth AS INT) AS shard_depth FROM x
"""


SQL = sql()
