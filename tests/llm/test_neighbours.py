import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<double>, query_id string, rank int"


def brute(rows, asked, count=10):
    """{query: [(score, id)]} by all distances."""
    good = [(i, np.array(v)) for i, v, *_ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, v in good:
        if asked(q):
            out[q] = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in good if i != q and len(v) == len(w))[:count]
    return out


def got_of(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.id))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    """Share of each query's true neighbours that were found, by distance."""
    hits = sum(sum(d <= w[-1][0] + 1e-9 for d, _ in got.get(q, [])) for q, w in want.items() if w)
    return hits / sum(map(len, want.values()))


def test_chi_square_quantile():
    rng = np.random.default_rng(3)
    drawn = (rng.standard_normal((200_000, 8)) ** 2).sum(1)
    for p in (0.5, 0.9, 0.99):
        assert abs((drawn < N.quantile(p, 8)).mean() - p) < 0.005


@pytest.mark.parametrize(("kind", "dim"), [("random", 16), ("groups", 64), ("line", 3)])
def test_recall_against_all_distances(spark, kind, dim):
    rng = np.random.default_rng(dim)
    n = 3000
    x = rng.standard_normal((n, dim))
    if kind == "groups":
        x = rng.standard_normal((60, dim))[rng.integers(60, size=n)] + 0.2 * x
    if kind == "line":
        x = np.outer(np.arange(1, n + 1), np.ones(dim))
    rows = [(k, v.tolist(), "", 0) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, lambda q: q % 50 == 0)
    got = got_of(N.nearest(df, F.col("vec_id") % 50 == 0, block=400, queries=7))
    assert recall(got, want) >= 0.97 and all(len(got[q]) == 10 for q in want)
    exact = {k: v for k, v in enumerate(x)}
    assert all(abs(s - np.linalg.norm(exact[q] - exact[i])) < 1e-9 and i != q for q, found in got.items() for s, i in found)


def test_far_blocks_are_not_visited(spark):
    """The test stops the search: where projections are the points themselves it is exact, and meets a part of the points only."""
    rng = np.random.default_rng(5)
    points = rng.standard_normal((20000, 8))
    tree = N.Tree(points)
    seen = []
    outwards = tree.outwards
    tree.outwards = lambda spot: (seen.append(len(at)) or (away, at) for away, at in outwards(spot))
    ids, _ = N.search(tree, points, np.arange(20000), points[7], points[7], 7, 10, math.inf, 1.0)
    assert sum(seen) < 10000 and ids.tolist() == np.argsort(((points - points[7]) ** 2).sum(1))[1:11].tolist()
    far = list(outwards(points[7]))
    assert sorted(np.concatenate([at for _, at in far]).tolist()) == list(range(20000)) and [d for d, _ in far] == sorted(d for d, _ in far)


def test_copies_of_one_vector_ties_and_few_candidates(spark):
    """A third of all rows is one vector: its cell is cut into blocks, and ties go to the smaller id."""
    rng = np.random.default_rng(1)
    rows = [(k, [1.0, 2.0, 3.0], "", 0) if k % 3 == 0 else (k, rng.standard_normal(3).tolist(), "", 0) for k in range(2400)]
    got = got_of(N.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0, block=100, queries=3))
    want = brute(rows, lambda q: q % 100 == 0)
    assert recall(got, want) >= 0.97
    copies = [q for q in want if q % 3 == 0]
    assert all([i for _, i in got[q]] == [3 * k for k in range(11) if 3 * k != q][:10] for q in copies)


def test_unusable_vectors_and_empty_tables(spark):
    rows = [(0, None, "", 1), (100, [0.0, 0.0], "", 1), (200, [1.0, None], "", 1), (300, [1.0, float("nan")], "", 1), (400, [], "", 1), (None, [1.0, 1.0], "", 1), (500, [1.0, 1.0], None, None), (501, [1.0, 2.0], "", 1), (501, [1.0, 2.0], "", 1), (600, [1.0, 1.0, 1.0], "", 1), (700, [2.0, 2.0], "", 1), (701, [1e200, 1.0], "", 1)]
    got = got_of(N.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0))
    assert [i for _, i in got[500]] == [501, 501, 700, 701] and [i for _, i in got[700]] == [501, 501, 500, 701] and set(got) == {500, 700}
    assert N.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0).count() == 0


def test_recall_on_the_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute(rows, lambda q: q % 10 == 0)
    assert recall(got_of(N.nearest(df, F.col("vec_id") % 10 == 0)), want) >= 0.97
