import hashlib
import random
import zlib

import pytest

from leafmill.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, depth int, key string"


def rebuilt(rows):
    """{conv: [(role, text)]}; turns that tie are in order of the digest of role and text."""
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            r, x = (role or "").encode(), (text or "").encode()
            own.setdefault(c, []).append(((turn is not None, turn or 0), hashlib.sha256(str(len(r)).encode() + b":" + r + x).digest(), (role or "", text or "")))
    own = {c: [t[2] for t in sorted(x)] for c, x in own.items()}
    out = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def plain(convs):
    """Rows of the trie, by looking at all prefixes of all conversations."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    rows = set()
    for p, m in members.items():
        under = [q for q in members if q[: len(p)] == p]
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in members) for q in under)
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        children = sum(len(q) == len(p) + 1 for q in under)
        rows.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return rows


def trie_of(spark, rows, **options):
    found = C.trie(C.rebuilt(C.written(C.turn_rows(spark.createDataFrame(rows, SCHEMA)), "turns")[0]), **options).collect()
    assert len({(r.conv_id, r.depth) for r in found}) == len(found)
    return {tuple(r) for r in found}


def made(seed, convs=60, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 200), convs):
        n = rng.randint(1, longest)
        rows += [(c, rng.choice([None, k, k]), rng.choice(["user", None, ""]), rng.choice(["a", "bé", None, "", "long " * 20]) if k > 1 else "hello", 1, "x") for k in range(n)]
    return rows


@pytest.mark.parametrize("stretch", [C.STRETCH, 3, 1])
def test_equals_all_prefixes(spark, monkeypatch, stretch):
    """Small runs and ranges, so that nodes lie on the borders of many, and stretches that end within conversations and with them."""
    monkeypatch.setattr(C, "ROWS", 7)
    rows = made(stretch, longest=9 if stretch > 1 else 4)
    assert trie_of(spark, rows, stretch=stretch) == plain(rebuilt(rows))


def test_copies_of_one_conversation(spark, monkeypatch):
    """Most conversations are equal: they are spread over many ranges, and the digest of their ids is whole."""
    monkeypatch.setattr(C, "ROWS", 16)
    rows = [(c, k, "user", f"turn {k}", 0, "") for c in range(300) for k in range(2)] + made(9, 20)
    assert trie_of(spark, rows) == plain(rebuilt(rows))


def test_edges(spark):
    """Repeated rows are turns, null ids are left out, a conversation may be rebuilt without turns, texts may be long."""
    rows = [(5, 1, "user", "a", 0, ""), (5, 1, "user", "a", 0, ""), (None, 1, "user", "a", 0, ""), (6, None, None, None, 0, ""), (7, 0, "user", "x" * 100_000, 0, ""), (9, 0, "user", "only", 0, ""), (2**62, 0, "user", "far", 0, "")]
    want = plain(rebuilt(rows))
    assert trie_of(spark, rows) == want and any(not t for t in rebuilt(rows).values())
    assert trie_of(spark, [r for r in rows if r[0] is None]) == set()


def test_merging_compares_no_shared_turn_again():
    """Sequences that share a long beginning: elements compared stay near those that differ, not their product with the prefix."""
    rng = random.Random(4)
    common = [b"%d" % k for k in range(500)]
    seqs = sorted((["", *common, *(b"%d" % rng.randint(0, 9) for _ in range(6))], c) for c in range(400))
    runs = [[], [], [], [], []]
    for seq, c in seqs:
        runs[rng.randrange(5)].append((seq, c))
    items = [[C.Item(s, c, C.common_prefix(run[k - 1][0], s) if k else 0, [], None) for k, (s, c) in enumerate(run)] for run in runs]
    merger = C.Merger(items)
    out = list(merger)
    assert [(i.seq, i.conv) for i, _ in out] == seqs
    assert [s for _, s in out] == [0, *(C.common_prefix(a[0], b[0]) for a, b in zip(seqs, seqs[1:], strict=False))]
    assert merger.compared < 8 * 400 < 500 * 400 / 20


def test_random_merges():
    rng = random.Random(1)
    for _ in range(200):
        runs = []
        for _ in range(rng.randint(1, 9)):
            run = sorted((["", *(rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 5)))], rng.randint(0, 99)) for _ in range(rng.randint(0, 6)))
            runs.append([C.Item(s, c, C.common_prefix(run[k - 1][0], s) if k else 0, [], None) for k, (s, c) in enumerate(run)])
        out = list(C.Merger(runs))
        seqs = sorted((i.seq, i.conv) for run in runs for i in run)
        assert [(i.seq, i.conv) for i, _ in out] == seqs
        assert [s for _, s in out] == [0 if not k else C.common_prefix(seqs[k - 1][0], seqs[k][0]) for k in range(len(seqs))]
