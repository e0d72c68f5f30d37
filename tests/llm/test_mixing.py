import math
import random

import duckdb
import numpy as np
import pytest

from leafmill.llm import mixing as M

SF = "/root/testdata/sf0.01"


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    rest, free, out = share * sum(sizes.values()), list(names), {}
    while free:
        total = sum(weight[s] for s in free)
        above = [s for s in free if rest * weight[s] / total > most * sizes[s]]
        if not above:
            return out | {s: rest * weight[s] / total for s in free}
        out |= {s: float(most * sizes[s]) for s in above}
        rest -= sum(out[s] for s in above)
        free = [s for s in free if s not in out]
    return out


def targets(spark, sizes):
    found = M.with_targets(spark.createDataFrame(list(sizes.items()), "source string, total long")).collect()
    return {r.source: r.target for r in found}


def test_targets_stop_and_reshare(spark):
    assert targets(spark, {"a": 100, "b": 100, "c": 100}) == {"a": 200.0, "b": pytest.approx(250 * 2 / 3), "c": pytest.approx(250 / 3)}
    for sizes in ({"b": 10, None: 1000, "a": 40, "Z": 7, "é": 0}, {None: 0}, {}, {f"s{k}": k * k % 97 for k in range(3000)}):
        got, want = targets(spark, sizes), plain_targets(sizes)
        assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], rel=1e-9) for s in want)


def test_multipliers_solve_the_dual_in_rounds_over_tables(spark):
    """Constraints of their own cells: any number of them, null names too, far from 1 or near it."""
    ratios = {None: 0.3, "tiny": 1e-9, "one": 1.0, "two": 2.0, "large": 50.0} | {f"s{k}": 0.05 + k % 37 / 20 for k in range(2000)}
    cells = spark.createDataFrame([([n], 900.0) for n in ratios] + [([n], 100.0) for n in ratios], "names array<string>, tokens double")
    goals = spark.createDataFrame([(n, 1000.0 * r) for n, r in ratios.items()], "name string, goal double")
    got = {r.name: r.multiplier for r in M.multipliers(cells, goals).collect()}
    assert got.keys() == ratios.keys() and all(math.exp(got[n]) == pytest.approx(r, rel=1e-9) for n, r in ratios.items())


def test_query_takes_its_rates_from_the_newton_rounds(spark, monkeypatch):
    calls = []
    solve = M.multipliers
    monkeypatch.setattr(M, "multipliers", lambda *a, **b: calls.append(1) or solve(*a, **b))
    M.query(spark, "/root/testdata/sf0.001").count()
    assert calls == [1]


def test_shares_of_another_column(spark):
    """Sources and languages at once: each total is met but for half a document in each cell."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    parts = {"en": 0.5, "de": 0.2}
    rows = M.decisions(docs, shares={"lang": parts}).collect()
    again = {r.id: r.copies for r in M.decisions(docs, shares={"lang": parts}).collect()}
    facts = {d.doc_id: d for d in docs.collect()}
    assert len(rows) == len(facts) and all(again[r.id] == r.copies for r in rows)
    source, lang, goal, longest = {}, {}, {}, max(r.size for r in rows)
    for r in rows:
        d = facts[r.id]
        source[d.source] = source.get(d.source, 0) + r.size * r.copies
        lang[d.lang] = lang.get(d.lang, 0) + r.size * r.copies
        goal[d.source] = r.target
    slack = longest / 2 * len({(d.source, d.lang) for d in facts.values()})
    assert all(abs(source[s] - goal[s]) <= slack for s in goal)
    assert all(abs(lang[v] - p * sum(goal.values())) <= slack for v, p in parts.items())
    assert abs(lang["en"] / sum(lang.values()) - 0.5) < 0.02


def test_query_meets_targets_and_reruns_agree(spark):
    rows = M.query(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    sizes = {}
    for d in docs.values():
        sizes[d.source] = sizes.get(d.source, 0) + len((d.text or "").encode().split())
    goal, taken = plain_targets(sizes), dict.fromkeys(sizes, 0)
    for r in rows:
        source = docs[r.doc_id].source
        assert r.size == len(docs[r.doc_id].text.encode().split()) and r.taken in (0, r.size, 2 * r.size)
        assert r.source_size == sizes[source] and r.target == pytest.approx(goal[source])
        taken[source] += r.taken
    for s in sizes:
        largest = max(len((d.text or "").split()) for d in docs.values() if d.source == s)
        assert abs(taken[s] - goal[s]) <= largest / 2 + 1, s
    dealt = spark.read.parquet(f"{SF}/documents.parquet").repartition(7)
    assert {(r.id, r.size * r.copies) for r in M.decisions(dealt).collect()} == {(r.doc_id, r.taken) for r in rows}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.sql(f"select doc_id, size, source_size, target, taken, copies from ({M.SQL})").fetchall()}
    got = M.query(spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.size, r.source_size, r.target, r.taken) == want[r.doc_id][:4], r
        assert r.copies == want[r.doc_id][4] or not r.size


@pytest.mark.parametrize("parts", [1, 5])
def test_repeated_rows_are_dealt_singly(spark, parts):
    """A group of rows that nothing tells apart does not take its source off the target."""
    rows = [(None, "a b c d e f", "s")] * 1000 + [(i, f"w{i} " * (i % 7 + 1), "s") for i in range(500)] + [(i, "v " * 30, "t") for i in range(900, 1100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
    found = M.decisions(docs).collect()
    assert len(found) == len(rows)
    for source in "st":
        taken, goal = sum(r.size * r.copies for r in found if r.source == source), next(r.target for r in found if r.source == source)
        assert taken == pytest.approx(goal, rel=0.005, abs=31)


def test_many_sources(spark):
    """More sources than a driver should hold one by one: every fourth of them has a single document."""
    docs = spark.range(120_000).selectExpr("id doc_id", "concat('s', lpad(cast(id div (1 + id % 4) as string), 7, '0')) source", "repeat('w ', cast(1 + id % 9 as int)) text")
    found = M.decisions(docs)
    row = found.selectExpr("sum(size * copies) taken", "sum(size) size", "count(distinct source) sources", "count(*) n", "max(copies) most").first()
    assert row.sources > 60_000 and row.n == 120_000 and row.most <= 2 and row.taken == pytest.approx(1.5 * row["size"], rel=0.05)


def test_balance_with_constraints_that_meet(spark):
    """Two groupings at once: the multipliers meet all goals, and no other rates are nearer in entropy."""
    rng = random.Random(1)
    tokens = {(i, j): rng.uniform(50, 500) for i in range(3) for j in range(3, 5)}
    goals = [0.0] * 5
    for (i, j), t in tokens.items():
        rate = rng.uniform(0.3, 1.9)
        goals[i] += t * rate
        goals[j] += t * rate
    cells = spark.createDataFrame([([i, j], t) for (i, j), t in tokens.items()], "idx array<int>, tokens double")
    m = M.balance(cells, goals)
    got = np.zeros(5)
    for (i, j), t in tokens.items():
        got[[i, j]] += t * math.exp(m[i] + m[j])
    assert got == pytest.approx(goals, rel=1e-6)


def test_clashing_names(spark):
    docs = spark.createDataFrame([(i, "a b", "s", *range(9)) for i in range(9)], "doc_id long, text string, source string, size long, base int, target int, pivot int, copies int, id int, draw int, tied int, words int")
    assert M.mixed(docs).columns == docs.columns and M.mixed(docs).count() in (13, 14) and M.decisions(docs).count() == 9


def test_edges(spark):
    rows = [(1, "a b c", None, 5), (None, None, None, 1), (2, "", "s", 2), (3, "x " * 90000, "s", 3), (3, "x " * 90000, "s", 3), (4, " ", "t", 4), (None, "p q", "t", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    found = M.decisions(docs).collect()
    assert len(found) == len(rows) and all(0 <= r.copies <= 2 for r in found)
    mix = M.mixed(docs)
    assert mix.columns == docs.columns and {r.doc_id for r in mix.where("text = '' or text is null").collect()} == {None, 2}
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.decisions(empty).count() == 0 and M.mixed(empty).count() == 0
    blank = spark.createDataFrame([(1, "", "s"), (2, None, None)], "doc_id long, text string, source string")
    assert M.mixed(blank).count() == 2
