import random

import pytest
import xxhash
from pyspark.sql import functions as F

from leafmill.llm import common, simhash

SF = "/root/testdata/sf0.001"


def plain(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] * bool(word)
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(prints):
    """{id: component} from {id: fingerprint}."""
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {i: plain(t) for i, t in docs.items()}
    want = brute(prints)
    got = simhash.query(spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in docs}
    assert len(got) == len(docs)


def test_links_find_every_close_pair(spark):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(60)]
    made = set(seeds)
    for s in seeds:
        for bits in range(6):
            x = s
            for b in rng.sample(range(64), bits):
                x ^= 1 << b
            made.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in made]
    got = {frozenset((r.u, r.v)) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    want = {frozenset((a, b)) for n, a in enumerate(signed) for b in signed[:n] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == want and want


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (5, 5), (8, 7), (7, 7), (None, 3), (20, 4)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 20: 1, 9: 7, 8: 7, 7: 7} | {100 + i: 100 for i in range(41)}


ROWS = [
    (1, "a b c d e", "x"), (2, "A  B c\td e", "y"), (2, "A  B c\td e", "y"), (3, None, None), (4, "", "z"), (5, " \n ", "z"),
    (None, "a b c d e", None), (None, "quite other words stand here", None), (6, "wort " * 70000, "long"), (7, "one two", None),
]


def test_nulls_empty_long_ties_and_clashing_columns(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, component_id string")
    rows = simhash.groups(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r.id: r for r in rows if r.id is not None}
    assert by[2].component_id == 1 and by[3].component_id == by[4].component_id == by[5].component_id == 3
    assert by[3].fp == 0 and by[6].component_id == 6 and by[7].component_id == 7
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:9]) for r in kept.collect()) == [(0, "quite oth"), (1, "a b c d e"), (3, ""), (6, "wort wort"), (7, "one two")]


@pytest.mark.parametrize("schema", ["doc_id long, text string"])
def test_empty_table(spark, schema):
    docs = spark.createDataFrame([], schema)
    assert simhash.groups(docs).count() == 0 and simhash.deduplicated(docs).count() == 0


def test_repeated_id_collapses(spark):
    docs = spark.createDataFrame([(8, "p q r s"), (8, "p q r s"), (9, "t u v w")], "doc_id long, text string")
    assert simhash.deduplicated(docs).where(F.col("doc_id") == 8).count() == 1


def test_rows_of_one_id_are_documents_of_their_own(spark):
    """An id says nothing of a text: what is like nothing else stays, in whatever order the rows come."""
    t, x = "p q r s t u", "quite other words that are like nothing else"
    rows = [(1, t, 0), (2, t, 1), (2, x, 2), (3, "a b c d", 3), (3, "e f g h", 4), (None, x, 5), (None, "zz yy xx", 6), (4, "a b c d", 7), (2, x, 2)]
    want = [(None, "zz yy xx", 6), (1, t, 0), (2, x, 2), (3, "a b c d", 3), (3, "e f g h", 4)]
    for order in (rows, rows[::-1]):
        kept = simhash.deduplicated(spark.createDataFrame(order, "doc_id long, text string, n int"))
        assert sorted([tuple(r) for r in kept.collect()], key=lambda r: (r[0] or 0, r[2])) == want


def executed(spark):
    """The plans that the session has run so far, by number."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return {found.apply(k).executionId(): found.apply(k).physicalPlanDescription() for k in range(found.size())}


def test_nothing_that_grows_is_broadcast(spark):
    """Tables so small that Spark would broadcast each: an index exploded from them, and what it leads to, may be many times as large."""
    rows = [(k, f"some words of text number {k % 70} or so " * 9, "en") for k in range(200)] + [(3, "other words of a repeated id", "en"), (None, "words without an id", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    before = executed(spark).keys()
    assert simhash.groups(docs).count() == len(rows)
    assert simhash.deduplicated(docs).count() == 72
    plans = [p for k, p in executed(spark).items() if k not in before]
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p for p in plans)
