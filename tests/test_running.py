import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators.running import running_totals


def plain(rows):
    out, sums = [], {}
    for g, o, v in sorted(rows, key=lambda r: ((r[0] is not None, r[0] or ""), r[1])):
        sums[g] = sums.get(g, 0) + (v or 0)
        out.append((g, o, v, sums[g]))
    return sorted(out, key=str)


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_equals_a_plain_loop_whatever_the_partitions(spark, partitions):
    """One group has most rows and spans many partitions; values may be negative or null, groups null."""
    rng = random.Random(partitions)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", "", None]), k, rng.choice([None, -5, 3, 1000])) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = running_totals(df, ["g"], [F.col("o").asc()], {"total": F.col("v"), "n": F.lit(1)})
        assert sorted([tuple(r)[:4] for r in got.collect()], key=str) == plain(rows)
        assert [r.n for r in got.where("g = 'hot'").orderBy("o").collect()] == list(range(1, sum(r[0] == "hot" for r in rows) + 1))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_window_over_a_group(spark):
    """The only window runs over the table of offsets, which has two rows a partition at most."""
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    plan = running_totals(df, ["g"], [F.col("id").asc()], {"n": F.lit(1)})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window ") == 1 and "max_by" in plan


def test_without_group_and_empty(spark):
    df = spark.range(100).select(F.col("id").alias("o"))
    assert sorted(r.n for r in running_totals(df, [], [F.col("o").asc()], {"n": F.lit(1)}).collect()) == list(range(1, 101))
    assert running_totals(df.where("o < 0"), [], [F.col("o").asc()], {"n": F.lit(1)}).count() == 0
