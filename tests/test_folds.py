import random
import time

import pytest
from pyspark.sql import functions as F

from leafmill.operators import folds
from leafmill.operators import segmentation as seg

WORDS = "the of and to in that was with for e.g. Dr. Mr. house water under between something extraordinary".split()


def made(rng, n):
    """Lines that end paragraphs in all ways: blank, short with a full stop, hyphens, page numbers."""
    out = []
    for _ in range(n):
        kind = rng.random()
        line = " ".join(rng.choices(WORDS, k=rng.randint(3, 14))) + rng.choice(["", ".", "-", "!", " "])
        out.append("" if kind < 0.1 else str(rng.randint(1, 99)) if kind < 0.15 else line.capitalize() if kind < 0.6 else line)
    return out


@pytest.fixture
def many_partitions(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_rows_equal_arrays(spark, many_partitions):
    """One document has most lines and spans all partitions; others are short, blank or null."""
    rng = random.Random(3)
    docs = {1: made(rng, 400), 2: made(rng, 40), 3: [""], 4: ["one"], 5: ["-", "lower", "x-", "Upper", "12"], 6: ["  "] * 5}
    rows = spark.createDataFrame([(d, k, line) for d, ls in docs.items() for k, line in enumerate(ls)] + [(7, 0, None)], "doc_id int, line_no int, text string")
    arrays = spark.createDataFrame([(d, ls) for d, ls in docs.items()], "doc_id int, lines array<string>")
    paras = folds.line_paragraphs(rows)
    want = arrays.select("doc_id", F.posexplode(seg.paragraphs(F.col("lines"))).alias("para_no", "text"))
    assert sorted(map(tuple, paras.collect())) == sorted(map(tuple, want.collect()))
    paras = want.cache()
    for most in (60, 300, 5000):
        got = folds.row_chunks(paras, most).cache()
        array = arrays.select("doc_id", F.posexplode(seg.chunks(seg.paragraphs(F.col("lines")), most)).alias("chunk_no", "c")).select("doc_id", "chunk_no", "c.text", "c.ends_paragraph")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, array.collect()))
    items = paras.select("doc_id", "para_no", (F.length("text") / 4.0).alias("seconds"), (F.col("para_no") % 3 == 0).alias("ends"))
    lists = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("para_no", "seconds", "ends"))).alias("s"))
    plan = lists.select("doc_id", F.posexplode(seg.plan_parts(F.transform("s", lambda s: s["seconds"]), F.transform("s", lambda s: s["ends"]), 100.0)).alias("para_no", "part_no"))
    got = folds.row_parts(items, "para_no", 100.0).select("doc_id", "para_no", "part_no")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plan.collect()))


def test_parts_add_up_in_order(spark, many_partitions):
    """0.1 + 0.2 + 0.3 is over 0.6, 0.3 + 0.2 + 0.1 is not."""
    rows = [(d, k, x, False) for d in (1, 2, 3) for k, x in reversed(list(enumerate([0.1, 0.2, 0.3])))]
    items = spark.createDataFrame(rows, "doc_id int, k int, seconds double, ends boolean").coalesce(1)
    got = folds.row_parts(items, "k", 0.6).select("doc_id", "k", "part_no").collect()
    assert sorted(map(tuple, got)) == [(d, k, k // 2) for d in (1, 2, 3) for k in range(3)]


def test_carried_state_crosses_partitions(spark, many_partitions):
    """A fold that never forgets takes a round for each partition, and is right all the same."""
    rows = spark.range(2000).select((F.col("id") % 2).alias("g"), "id")
    got = folds.carried(rows, ["g"], [F.col("id").asc()], ["id"], (0,), lambda s, r: ((s[0] * 3 + r[0]) % 1009,) and (((s[0] * 3 + r[0]) % 1009,), int((s[0] * 3 + r[0]) % 1009)), "x").collect()
    want, state = {}, {0: 0, 1: 0}
    for k in range(2000):
        state[k % 2] = (state[k % 2] * 3 + k) % 1009
        want[k] = state[k % 2]
    assert {r.id: r.x for r in got} == want
    assert folds.carried(rows.where("id < 0"), ["g"], [F.col("id").asc()], ["id"], (0,), lambda s, r: (s, 0), "x").count() == 0


def test_a_text_of_fifty_megabytes(spark):
    """Linear: one document of a million lines becomes chunks in minutes, where an array would be copied at each step."""
    line = "This line of a very long text has fifty characters. "
    lines = spark.range(1_000_000).select(F.lit(1).alias("doc_id"), F.col("id").alias("line_no"), F.when(F.col("id") % 10 == 9, "").otherwise(line).alias("text"))
    began = time.perf_counter()
    found = folds.row_chunks(folds.line_paragraphs(lines), 900).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max("chunk_no").alias("last")).first()
    assert found.last == found.n - 1 and found.chars > 40_000_000
    assert time.perf_counter() - began < 300
