import numpy as np
import pytest

from leafmill.llm import embeddings as E

SF = "/root/testdata/sf0.01"


def brute(rows, cosine=0.98):
    """{id: (n_links, component)} from distinct (id, vector or None, label)."""
    good = [(i, np.array(v, float), g) for i, v, g in rows if i is not None and g is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    links = {i: set() for i, _, _ in rows}
    for n, (i, v, g) in enumerate(good):
        for j, w, h in good[:n]:
            if g == h and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= cosine:
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            todo += (new := links[todo.pop()] - seen)
            seen |= new
        out[i] = (len(links[i]), min(seen) if i is not None else None)
    return out


def made(n, dim, spread, seed):
    """Groups of near copies among random vectors."""
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        v = rng.standard_normal(dim)
        for _ in range(rng.choice([1, 1, 2, 5, 40])):
            w = v / np.linalg.norm(v) + spread * rng.standard_normal(dim) / np.sqrt(dim)
            out.append((len(out), w.astype(np.float32).tolist(), int(rng.integers(2))))
    return out[:n]


@pytest.mark.parametrize("block", [E.BLOCK, 16])
def test_recall_and_precision(spark, block):
    rows = made(1500, 64, 0.12, 1) + [(5000 + k, v, 0) for k, v in enumerate([[0.0] * 64, [1.0, 2.0], [2.0, 4.0], [float("nan")] * 64, [1.0] * 63 + [float("inf")]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.id: (r.n_links, r.component_id) for r in E.near_duplicates(df, block=block).collect()}
    want = brute(rows)
    found, there = sum(x[0] for x in got.values()), sum(x[0] for x in want.values())
    assert all(got[i][0] <= want[i][0] for i in want) and there > 1000
    assert found >= 0.995 * there
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.995 * len(want)


@pytest.mark.parametrize("codes", [1024, 4096])
def test_recall_at_the_edge_with_many_codes(spark, codes):
    """As many code words as far larger tables get; pairs of a cosine just above the least."""
    rng = np.random.default_rng(9)
    u = rng.standard_normal((800, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    r = rng.standard_normal((800, 64))
    r -= (r * u).sum(1, keepdims=True) * u
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    v = 0.9805 * u + np.sqrt(1 - 0.9805**2) * r
    rows = [(k, x.tolist(), 1) for k, x in enumerate(np.concatenate([u, v]))]
    got = E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), codes=codes).where("n_links > 0").count()
    assert got >= 0.98 * 1600


def test_dense_groups_meet_once(spark):
    """A dense group in caps it shares is compared in the first of them only, and nothing is lost."""
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(64)
    rows = [(k, (centre + 0.02 * rng.standard_normal(64)).astype(np.float32).tolist(), 1) for k in range(300)] + [(1000 + k, v, g) for k, v, g in made(300, 64, 0.12, 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.id: (r.n_links, r.component_id) for r in E.near_duplicates(df, block=32).collect()}
    want = brute(rows)
    assert sum(got[i] == want[i] for i in want) >= 0.995 * len(want) and all(got[k] == want[k] for k in range(300))


def test_query_on_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.query(spark, SF).collect()}
    assert got == brute(rows)


def test_edges(spark):
    v = [float(x) for x in range(1, 9)]
    rows = [(3, v, 1), (1, v, 1), (2, v, 2), (4, v, None), (5, None, 1), (6, [], 1), (None, v, 1), (7, [0.0] * 8, 1), (8, [1.0, None] * 4, 1), (9, [1e300 * x for x in v], 1), (10, [1e-300 * x for x in v], 1), (11, [-x for x in v], 1)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<double>, label int, key string")
    got = E.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert {r.id: (r.n_links, r.component_id) for r in got} == {1: (3, 1), 3: (3, 1), 9: (3, 1), 10: (3, 1), 2: (0, 2), 4: (0, 4), 5: (0, 5), 6: (0, 6), 7: (0, 7), 8: (0, 8), 11: (0, 11), None: (0, None)}
    repeated = spark.createDataFrame([(1, v, 1)] * 3 + [(2, [0.0] * 8, 1)] * 2, "vec_id long, embedding array<double>, label int")
    assert sorted((r.id, r.n_links) for r in E.near_duplicates(repeated).collect()) == [(1, 2)] * 3 + [(2, 0)] * 2
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_decoding_lists_exactly_the_caps():
    rng = np.random.default_rng(5)
    caps = E.Caps(24, 32, 8)
    unit = rng.standard_normal((40, 24))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    a, b = (unit @ caps.turn)[:, :12] @ caps.words[0].T, (unit @ caps.turn)[:, 12:] @ caps.words[1].T
    scores = (a[:, :, None] + b[:, None, :]).reshape(40, -1)
    fourth = np.sort(scores, axis=1)[:, -4]
    want = {tuple(x) for x in np.argwhere(scores >= np.minimum(caps.edge, fourth)[:, None] - 1e-12)}
    assert set(zip(*map(np.ndarray.tolist, caps.decode(unit, 4)), strict=True)) == want


def test_every_vector_lies_in_the_least_caps():
    """Its least best caps are all listed: the last of them lies on the edge itself, and no rounding takes it away."""
    unit = E._unit(np.random.default_rng(11).standard_normal((2000, 64)))
    assert np.bincount(E.Caps(64, 64).decode(unit, 10)[0], minlength=2000).min() == 10
