import random

import corpus_pipeline as P
import numpy as np
from test_simhash import executed

from leafmill.llm import shingles

SF = "/root/testdata/sf0.001"


def plain(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs):
    """{id: smallest id that pairs of a similarity of 0.8 or more lead to}, by all pairs."""
    sets, parent = {i: plain(t) for i, t in docs.items()}, {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(docs)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_stage_drops_near_copies_of_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = set(brute({r.doc_id: r.text for r in docs.collect()}).values())
    got = [r.doc_id for r in P.drop_near_duplicates(spark, docs, SF).collect()]
    assert sorted(got) == sorted(want) and not {145, 177} & want  # 7 and 11 bits from 6 and 1


def test_groups_equal_brute_force_around_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(shingles, "SAMPLE", 1)
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    line = [word() for _ in range(30)]
    docs, i = {}, 0
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 12, 60, 150]))]
        for edits in (0, 0, 1, 2, 3, 4, 6):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = word()
            docs[i] = " ".join(copy + (line if rng.random() < 0.5 else []))
            i += 1
    base = [word() for _ in range(80)]
    for k in range(60):  # one large group, linked in chains
        base[rng.randrange(80)] = word()
        docs[i + k] = " ".join(base)
    docs |= {900: None, 901: "", 902: "One  two", 903: "one two"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    got = {r.id: r.component_id for r in shingles.groups(df).collect()}
    assert got == brute(docs)
    assert sorted(r.doc_id for r in shingles.deduplicated(df).collect()) == sorted(set(got.values()))


def test_parity_never_exceeds_the_difference():
    rng = random.Random(3)
    for _ in range(300):
        a = {rng.getrandbits(63) for _ in range(rng.randint(0, 400))}
        b = set(rng.sample(sorted(a), len(a) // 2)) | {rng.getrandbits(63) for _ in range(rng.randint(0, 60))}
        x, y = (shingles.parity(np.array(sorted(s), np.int64)).view(np.uint64).tolist() for s in (a, b))
        assert sum((p ^ q).bit_count() for p, q in zip(x, y, strict=True)) <= len(a ^ b)
        wide, narrow = (shingles.parity(np.array(sorted(a), np.int64), n) for n in (16, 8))
        assert (wide[:8] ^ wide[8:] == narrow).all()  # folding


def test_large_group_of_borderline_copies(spark):
    """Copies with a few edits each, many just below the similarity: few pairs leave the join, and no link is lost."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=6))
    base = [word() for _ in range(150)]
    docs = {}
    for i in range(250):
        copy = list(base)
        for _ in range(rng.randint(1, 5)):
            copy[rng.randrange(150)] = word()
        docs[i] = " ".join(copy)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.id: r.component_id for r in shingles.groups(df).collect()} == brute(docs)


def test_rows_of_one_id_are_documents_of_their_own(spark):
    """As for fingerprints: rows (1, T), (2, T), (2, X) lose the copy of T only."""
    t, x = " ".join(f"w{k}" for k in range(30)), "Žluťoučký kůň úpěl ďábelské ódy zcela jinak než ostatní texty"
    rows = [(1, t), (2, t), (2, x), (3, "a b c d e f"), (3, "g h i j k l"), (5, t + " more")]
    for order in (rows, rows[::-1]):
        kept = shingles.deduplicated(spark.createDataFrame(order, "doc_id long, text string"))
        assert sorted(tuple(r) for r in kept.collect()) == [(1, t), (2, x), (3, "a b c d e f"), (3, "g h i j k l")]


def test_fingerprints_link_too(spark):
    """A word said so often that it decides all bits, before tails that share no shingle: only SimHash links these texts."""
    rows = [(7, "a " * 100 + "b c d e f g h i"), (3, "a " * 100 + "j k l m n o p q"), (4, "one two three four five six"), (5, "seven eight nine ten eleven"), (6, None), (8, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.id: r.component_id for r in shingles.groups(docs).collect()} == {7: 7, 3: 3, 4: 4, 5: 5, 6: 6, 8: 6}
    assert {r.id: r.component_id for r in shingles.groups(docs, by_print=True).collect()} == {7: 3, 3: 3, 4: 4, 5: 5, 6: 6, 8: 6}
    assert {r.doc_id for r in P.drop_near_duplicates(spark, docs, SF).collect()} == {3, 4, 5, 6}


def test_no_documents_are_broadcast(spark):
    """The pipeline's near-duplicate and benchmark stages on tables so small that Spark would broadcast each side of their joins."""
    rng = random.Random(3)
    base = [" ".join(rng.choices([f"w{k}" for k in range(400)], k=60)) for _ in range(30)]
    texts = [*base, *[t + " and one more" for t in base], *[t.replace(" ", " x ", 1) for t in base], *[f"{a[:200]} {b[:200]}" for a, b in zip(base, base[1:])]]
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, passage])] + [(3, "another text of that id"), (None, base[0]), (None, "no id")], "doc_id long, text string")
    want = brute({k: r.text for k, r in enumerate(docs.where("doc_id is not null").dropDuplicates(["doc_id"]).orderBy("doc_id").collect())})
    before = executed(spark).keys()
    kept = P.drop_near_duplicates(spark, docs, SF)
    assert len({r.doc_id for r in kept.collect()} - {None}) >= len(set(want.values())) - 1
    near = [p for k, p in executed(spark).items() if k not in before]
    assert any("SortMergeJoin" in p for p in near) and not any("BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p for p in near)
    clean = P.drop_benchmark(spark, docs, SF)
    assert clean.count() == docs.count() - 1
    assert "LeftAnti" in clean._jdf.queryExecution().executedPlan().toString() and "BroadcastHashJoin" not in clean._jdf.queryExecution().executedPlan().toString()
