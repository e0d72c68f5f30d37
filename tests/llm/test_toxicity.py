import zlib

import numpy as np
import pytest

from leafmill.llm import toxicity as T

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in T.query(spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    test = [(labels[i], r.predicted) for i, r in got.items() if i in labels and r.held_out]
    assert np.mean([a == b for a, b in test]) > 0.93


def toy(n, seed=0):
    rng = np.random.default_rng(seed)
    known = ["".join(np.random.default_rng(k).choice(list("abcdefghij"), 2 + k % 5)) for k in range(80)]
    word = lambda: known[rng.integers(80)]
    rows = []
    for k in range(n):
        words = [word() for _ in range(rng.integers(5, 90))]
        if k % 3 == 0:
            words[rng.integers(len(words))] = "zorg" + word()
        rows.append((" ".join(words), int(k % 3 == 0)))
    return rows


def test_learns_a_prefix_and_reruns_agree():
    net = T.train(toy(900), 1.0)
    test = toy(150, 9)
    scores = np.array(T.Scorer(net).scores([t for t, _ in test]))
    assert np.mean((scores >= 0.3) == np.array([y for _, y in test])) > 0.9
    again = T.train(toy(900), 1.0)
    assert all(np.array_equal(net.p[k], again.p[k]) for k in net.p)


def test_held_out_recall_and_precision(spark):
    """On sf0.1, of labelled documents of which no label was learned."""
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in T.query(spark, sf).collect() if r.held_out and labels.get(r.doc_id) is not None]
    toxic = [r for r in rows if labels[r.doc_id] == 1]
    caught, alarms = sum(r.predicted for r in toxic), sum(r.predicted for r in rows if labels[r.doc_id] == 0)
    assert len(toxic) >= 100 and caught >= 0.9 * len(toxic) and alarms <= 0.02 * (len(rows) - len(toxic)) and caught >= 0.85 * (caught + alarms)


def plain_score(net, text):
    """The largest probability of the windows of one text, word by word and gate by gate."""
    words = T.words_of(text)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    best = 0.0
    for a, b in T.windows(len(words)) if words else []:
        table = net.projected(net.inputs(words[a:b])[3])
        hidden = []
        for k in (0, 1):
            h, states = np.zeros(T.STATE), []
            for i in range(b - a) if k == 0 else range(b - a - 1, -1, -1):
                x, g = table[k, i], h @ net.p["U"][k]
                r, u = (sigmoid(x[j * T.STATE : (j + 1) * T.STATE] + g[j * T.STATE : (j + 1) * T.STATE]) for j in (0, 1))
                c = np.tanh(x[2 * T.STATE :] + r * g[2 * T.STATE :])
                h = u * h + (1 - u) * c
                states.append(h)
            hidden.append(states if k == 0 else states[::-1])
        both = np.concatenate((np.array(hidden[0]), np.array(hidden[1])), axis=1)
        e = both @ net.p["att"]
        weight = np.exp(e - e.max())
        best = max(best, sigmoid((weight / weight.sum()) @ both @ net.p["out"] + net.p["bias"][0]))
    return float(best)


def test_scores_equal_a_plain_network(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    net = T.trained(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.score for r in T.query(spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == texts.keys()
    for i in sorted(texts)[::5]:
        assert got[i] == pytest.approx(plain_score(net, texts[i]), abs=1e-4)


def test_gradient_equals_differences():
    net = T.Network({"aa": 1, "bcd": 2}, 3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x_words = ["aa", "bcd", "é"]
    at = np.array([[0, 1, 2, 1] + [-1] * (T.WINDOW - 4), [2, 2, 0, 1] * (T.WINDOW // 4)])
    dz = np.array([0.7, -1.3])

    def value():
        return float(dz @ net.forward(net.projected(net.inputs(x_words)[3]), at))

    keep = []
    x = net.inputs(x_words)
    net.forward(net.projected(x[3]), at, keep)
    found = net.gradient(x, at, keep, dz)
    rng = np.random.default_rng(0)
    for name, p in net.p.items():
        where = np.argwhere(found[name] != 0)
        for spot in map(tuple, where[rng.permutation(len(where))[:5]]):
            old, step = p[spot], 1e-2
            p[spot] = old + step
            up = value()
            p[spot] = old - step
            down = value()
            p[spot] = old
            assert found[name][spot] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-3), name


def test_windows_cover_and_overlap():
    for n in (1, 5, 31, 32, 33, 56, 57, 1000):
        w = T.windows(n)
        assert w[0][0] == 0 and w[-1][1] == n and all(b - a <= T.WINDOW for a, b in w)
        assert all(later[0] < first[1] for first, later in zip(w, w[1:]))


def test_edges(spark):
    net = T.train(toy(120), 1.0)
    rows = [(1, None, 1), (2, "", 2), (3, "... !", 3), (None, "zorgab", 4), (None, "zorgab", 4), (5, "abc " * 60000 + "zorgab", 5), (6, "x" * 90000, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = T.scored(docs, net).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.toxicity for r in got}
    assert by[1] == by[2] == by[3] == 0 and by[5] > 0.3
    assert T.scored(spark.createDataFrame([], "doc_id long, text string"), net).count() == 0
    assert T.train([("a", 0), ("b", 0)]) == 0.0 and T.train([]) == 0.0 and T.Scorer(0.25).scores([None, "a"]) == [0.25, 0.25]
    labels = spark.createDataFrame([(1, 1), (5, None), (None, 1), (6, 0), (6, 0)], "doc_id long, toxic int")
    assert T.sample(docs, labels)[1] >= 1.0
