import random
import zlib

import pytest

from leafmill.llm import names as N

CLIENT, VENDOR = "client_id long, name string, extra string", "vendor_id long, name string, n int, key string"


def edited(word, alphabet):
    """All texts one edit away."""
    out = set()
    for k in range(len(word) + 1):
        out |= {word[:k] + c + word[k:] for c in alphabet}
        if k < len(word):
            out |= {word[:k] + word[k + 1 :]} | {word[:k] + c + word[k + 1 :] for c in alphabet}
        if k + 1 < len(word):
            out.add(word[:k] + word[k + 1] + word[k] + word[k + 2 :])
    return out


def within(word, alphabet, most):
    """{text: fewest edits}, by breadth-first search."""
    seen = {word: 0}
    ring = {word}
    for d in range(1, most + 1):
        ring = {x for w in ring for x in edited(w, alphabet)} - set(seen)
        seen |= dict.fromkeys(ring, d)
    return seen


def test_distance_is_the_fewest_edits():
    for word in ("", "a", "ab", "abca", "baab"):
        for other, d in within(word, "abc", 3).items():
            assert N.distance(word, other) == d == N.distance(other, word)
            assert [N.distance(word, other, most) for most in (1, 2, 3)] == [min(d, most + 1) for most in (1, 2, 3)]
    assert N.distance("ca", "abc") == 2 and N.distance("caab", "acab") == 1


@pytest.mark.parametrize(("most", "alphabet", "longest"), [(1, "ab", 11), (1, "aé😀", 7), (2, "ab", 13), (0, "ab", 6)])
def test_all_pairs_of_small_alphabets(spark, most, alphabet, longest):
    rng = random.Random(most * 100 + longest)
    word = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randint(1, longest)))
    left = {word() for _ in range(150)}
    right = {word() for _ in range(150)} | {w for x in list(left)[:60] for w in rng.sample(sorted(edited(x, alphabet) - {""}), 2)}
    want = {(a, b, d) for a in left for b in right if (d := N.distance(a, b)) <= most}
    got = N.pairs(spark.createDataFrame([(w,) for w in left], "name string"), spark.createDataFrame([(w,) for w in right], "name string"), most).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want
    assert most == 0 or len(want) > 100


def test_nulls_repeats_and_clashing_columns(spark):
    clients = [(1, "anna berg", "x"), (1, "anna berg", "x"), (5, "anan berg", None), (3, "anna breg", "y"), (None, "anna berg", "z"), (9, "", ""), (8, None, ""), (7, "a", ""), (6, "b" * 5000, ""), (11, "ann berg ", "")]
    vendors = [(1, "anna berg", 1, "k"), (1, "anna berg", 1, "k"), (2, None, 1, ""), (3, "", 1, ""), (4, "ab", 1, ""), (5, "b" * 5001, 2, ""), (None, "anna berg", 2, "")]
    got = sorted([tuple(r) for r in N.joined(spark.createDataFrame(clients, CLIENT), spark.createDataFrame(vendors, VENDOR)).collect()], key=str)
    crc = lambda i: zlib.crc32(str(i).encode())
    near = [(0, 3, 1, 2 * crc(1)), (1, 2, 3, crc(3) + crc(5))]
    want = [(v, *x) for v in (1, 1, None) for x in near] + [(4, 1, 1, 7, crc(7)), (5, 1, 1, 6, crc(6))]
    assert got == sorted(want, key=str)
    empty = spark.createDataFrame([], CLIENT)
    assert N.joined(empty, spark.createDataFrame(vendors, VENDOR)).count() == 0
    assert N.joined(spark.createDataFrame(clients, CLIENT), spark.createDataFrame([], VENDOR)).count() == 0


def test_misspelt(spark):
    rows = [(k, name) for k in range(40) for name in ("", "x", "ab", "Méni 😀 Ley", None)]
    got = {(r.vendor_id, r.name): r.m for r in spark.createDataFrame(rows, "vendor_id long, name string").withColumn("m", N.misspelt(*map(N.F.col, ("vendor_id", "name")))).collect()}
    for k, name in rows:
        h = zlib.crc32(str(k).encode())
        want = name
        if name and h % 2 == 0 and len(name) >= 2:
            p = h % (len(name) - 1)
            want = name[:p] + name[p + 1] + name[p] + name[p + 2 :]
        assert got[k, name] == want


def test_a_name_that_most_rows_have_is_one_node(spark):
    """Equal names meet once: rows that leave the join do not grow with the rows that have a name."""
    clients = spark.range(20000).selectExpr("id as client_id", "if(id % 3 = 0, 'Joelma Dalmaberber', concat('Name ', id)) as name")
    vendors = spark.createDataFrame([(k, "Joelma Dalmabreber") for k in range(50)], "vendor_id long, name string")
    got = N.joined(clients, vendors).collect()
    assert len(got) == 50 and {(r.distance, r.n_clients, r.first_client_id) for r in got} == {(1, 6667, 0)}
