import hashlib
import re

import duckdb
import pytest

from leafmill.llm import decontaminate as D

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans(D.UPPER, D.LOWER)


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute(docs, items, n=10):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for k in {len(g) for g in windows}:
            for i in range(len(w) - k + 1):
                if (g := tuple(w[i : i + k])) in windows:
                    hit |= set(range(i, i + k))
                    found |= windows[g]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


ITEMS = [(1, "One two three four five six seven eight nine ten eleven"), (2, "kurz und gut"), (3, None), (4, ""), (12, "two three four five six seven eight nine ten eleven"), (5, "... --"), (6, "Ñandú É")]
DOCS = [
    (1, "xx one TWO three four, five six seven eight nine ten eleven yy kurz, und GUT!"), (2, None), (3, ""), (4, "kurz und gut kurz und gut"), (None, "kurz und"),
    (5, "w " * 60000 + "kurz und gut"), (4, "kurz und gut kurz und gut"), (7, "ñandú é"), (8, "Ñandú É"), (9, "1-2-3 \U0001f600"),
]


def rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in df.collect()), key=str)


def test_edges_equal_brute_force(spark):
    docs = spark.createDataFrame([(*d, 1) for d in DOCS], "doc_id long, text string, w int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rows(D.report(docs, items)) == brute(DOCS, ITEMS)


def test_query_equals_sql_and_brute_force(spark):
    got = rows(D.query(spark, SF))
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert got == brute(docs, items) and any(r[5] for r in got)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert sorted((tuple(r) for r in con.sql(f"select doc_id, n_words, n_hit, n_items, items_sha256, contaminated from ({D.SQL})").fetchall()), key=str) == got


def test_removal(spark):
    docs = spark.createDataFrame([(d, t, "s") for d, t in DOCS if d != 5], "doc_id long, text string, hw string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    whole = D.decontaminated(docs, items)
    assert whole.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in whole.collect()) == [0, 2, 3, 7, 9]
    cut = {r.doc_id: r.text for r in D.decontaminated(docs, items, remove="spans").collect()}
    assert cut[1].split() == ["xx", "yy", "!"] or cut[1].split() == ["xx", "yy!"]
    assert cut[7] == "ñandú é" and plain_words(cut[8]) == [] and plain_words(cut[4]) == [] and cut[2] is None
    with pytest.raises(ValueError):
        D.decontaminated(docs, items, remove="lines")


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame(DOCS[:4], "doc_id long, text string")
    assert D.report(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
    assert [r.n_hit for r in D.report(some, items).collect()] == [0] * 4
    assert D.decontaminated(some, items).count() == 4


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "kurz und gut", *"abcdefgh")], "doc_id long, text string, spans string, h string, gram string, set string, size string, found string, grams string, first string")
    items = spark.createDataFrame([(2, "kurz und gut", "x", "y")], "item_id long, text string, h string, size string")
    assert rows(D.report(docs, items)) == brute([(1, "kurz und gut")], [(2, "kurz und gut")])
    assert D.decontaminated(docs, items).count() == 0
    assert D.decontaminated(docs, items, remove="spans").first().spans == "a"


def test_windows_in_any_number(spark):
    """One plan however large the set: the windows stand in tables, not in the plan."""
    from pyspark.sql import functions as F

    items = spark.range(40).select(F.col("id").alias("item_id"), F.expr("array_join(transform(sequence(1, 5000), i -> concat('w', id, 'x', i)), ' ')").alias("text"))
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(id * 80, id * 80 + 30), i -> concat('w', id, 'x', i)), ' ')").alias("text"))
    plan = D.report(docs, items)
    assert len(plan._jdf.queryExecution().analyzed().toString()) < 100_000
    got = {r.doc_id: (r.n_hit, r.n_items) for r in plan.collect()}
    assert all(got[k] == ((31 if k else 30, 1) if k < 40 else (0, 0)) for k in range(60))


def test_native_plan(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    windows = D.item_windows(items)
    scan = D.candidates(docs, windows)
    texts = scan.select(D._key("text").alias("__key"), "__found")
    for df in (windows, scan, D.verified(texts, windows), D.report(docs, items), D.decontaminated(docs, items), D.decontaminated(docs, items, remove="spans")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoopJoin", plan)
    # the bitmap is bound in one projection, never a column of rows
    assert "__bits" not in scan.select("doc_id", "__found")._jdf.queryExecution().executedPlan().toString()
