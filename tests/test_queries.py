"""Every registered query of the engine against its DuckDB counterpart."""

import duckdb
import pytest

from leafmill.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "conversations", "labels", "benchmark", "embeddings", "part", "orders")
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: None if v is None else round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted(([norm(r[i]) for i in order] for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_duckdb(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_give_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["segments_20k", "segments_of_rows", "chunks_900"])
def test_documents_without_paragraphs_have_no_rows(spark, tmp_path, name):
    """Texts that are null, empty, blank or page numbers only; beside them texts around the limit and words beyond it."""
    long = ["x" * 19_999, "x" * 20_000, "x" * 20_001, "y" * 45_000 + " z", "A word and some more. " * 3000, "x" * 9_999 + "\n\n" + "y" * 10_000, "x" * 9_999 + "\n\n" + "y" * 10_001]
    texts = [None, "", " ", "\n\n \n", "12", "Page 3 of 4\n\n5", "12\nA line.", *long]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, want = QUERIES[name](spark, str(tmp_path)), con.sql(SQL[name])
    found = rows(got.columns, [tuple(r) for r in got.collect()])
    assert found == rows(want.columns, want.fetchall()) and len({r[sorted(got.columns).index("doc_id")] for r in found}) == len(texts) - 6
