import hashlib
import random
from collections import defaultdict

import duckdb
import pytest

from leafmill.llm import common
from leafmill.llm import sharding as S


def brute(hashed, limit):
    """{hash: shard} by splitting oversized buckets bit by bit."""
    out, todo = {}, [("", list(hashed))]
    while todo:
        prefix, rows = todo.pop()
        if sum(b for _, b in rows) <= limit:
            out |= {h: prefix or "all" for h, _ in rows}
        else:
            for bit in "01":
                todo.append((prefix + bit, [(h, b) for h, b in rows if format(h & (2**64 - 1), "064b")[len(prefix)] == bit]))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "wort " * rng.choice([1, 3, 50, 700])) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (5000, 20_000, 10**9):
        got = S.assigned(docs, limit).withColumn("h", common.hash_of("doc_id", "text")).collect()
        assert len(got) == len(rows)
        assert {r.h: r.shard for r in got} == brute([(r.h, r.shard_row_bytes) for r in got], limit)
        assert all(r.shard_row_bytes == len(r.text) for r in got)


def test_ties_nulls_and_oversized(spark):
    rows = [(1, "same text", 0)] * 400 + [(2, "y" * 5000, 1), (3, None, 2), (None, None, 3), (4, "", 4), (None, "é" * 50, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = S.assigned(docs, 900).collect()
    total, count = defaultdict(int), defaultdict(int)
    for r in got:
        total[r.shard] += r.shard_row_bytes
        count[r.shard] += 1
    assert len(got) == len(rows) and sorted({r.given_shard for r in got}) == [0, 1, 2, 3, 4, 5]
    assert all(t <= 900 or (count[s] == 1 and t == 5000) for s, t in total.items())
    assert [r.shard_row_bytes for r in got if r.doc_id is None and r.text] == [100]


def test_empty(spark):
    assert S.assigned(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_written_shards_hold_every_row(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " * 20) for i in range(200)], "doc_id long, text string")
    S.write_shards(docs, f"file://{tmp_path}/out", 4000)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == 200 and back.select("shard").distinct().count() > 4


@pytest.mark.parametrize("limit", [9_000, 60_000, S.LIMIT])
def test_query_equals_sql_and_brute_force(spark, limit):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    texts = {i: t or "" for i, t in con.sql("select doc_id, text from documents").fetchall()}
    got = {(r.doc_id, r.n_bytes, r.shard, r.shard_depth) for r in S.query(spark, sf, limit).collect()}
    whole = {r for r in got if not r[2].startswith("+")}
    assert whole == set(con.sql(f"select doc_id, n_bytes, shard, shard_depth from ({S.sql(limit)})").fetchall())
    h = {i: int(hashlib.md5(f"{i}:{t}".encode()).hexdigest()[:16], 16) for i, t in texts.items()}
    want = brute([(h[i], len(t.encode())) for i, t in texts.items() if len(t.encode()) <= limit], limit)
    assert {i: s for i, _, s, _ in whole} == {i: want[h[i]] for i, t in texts.items() if len(t.encode()) <= limit}
    assert len(got) == len(texts) and (limit == S.LIMIT or len({s for _, _, s, _ in got}) > 3)
