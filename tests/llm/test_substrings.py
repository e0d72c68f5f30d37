import hashlib
import random

import numpy as np

from leafmill.llm import substrings as S

SF = "/root/testdata/sf0.001"


def plain_cuts(data, reach=S.REACH, most=S.MOST):
    """Byte by byte: the gear hash over the whole text, then word ends with the least hash around."""
    ends, h, last = [], 0, -1
    for i, b in enumerate(data):
        h = ((h << 1) + int(S.GEAR[b])) & 0xFFFF
        if b in b" \t\n\r\x0b\x0c":
            last = i
            ends.append((i + 1, h))
        elif i - last >= S.UNSPACED and h >> (16 - S.UNSPACED_BITS) == 0 and (i + 1 == len(data) or data[i + 1] & 0xC0 != 0x80):
            ends.append((i + 1, h))
    out, start = [], 0
    chosen = [e for k, (e, h) in enumerate(ends) if h == min(x for _, x in ends[max(0, k - reach) : k + reach + 1])]
    for end in [*chosen, len(data)]:
        while end - start > most:
            stop = start + most
            while data[stop] & 0xC0 == 0x80:
                stop -= 1
            out.append(stop)
            start = stop
        if end > start:
            out.append(end)
            start = end
    return out


def brute(docs, min_words=S.MIN_WORDS, min_bytes=S.MIN_BYTES):
    """{id: (spans, own spans)} from {id: text}."""
    seen, out = {}, {}
    for i in sorted(docs):
        data, start, runs = (docs[i] or "").encode(), 0, {False: [], True: []}
        for end in plain_cuts(data):
            chunk = data[start:end]
            if chunk in seen:
                of = runs[seen[chunk] == i]
                if of and of[-1][1] == start:
                    of[-1][1] = end
                else:
                    of.append([start, end])
            seen.setdefault(chunk, i)
            start = end
        begun = lambda a, b: sum(data[k : k + 1].strip() != b"" and (k == 0 or data[k - 1 : k].strip() == b"") for k in range(a, b))
        spans, own = ([(a, b) for a, b in runs[k] if begun(a, b) >= min_words or b - a >= min_bytes] for k in (False, True))
        if spans or own:
            out[i] = (spans, own)
    return out


def found(df):
    return {r.id: tuple([(s.pos, s.stop) for s in c] for c in (r.spans, r.own)) for r in df.collect()}


def test_cuts_equal_plain_rule():
    rng = random.Random(4)
    for _ in range(60):
        text = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.choice([1, 4, 9, 700]))) for _ in range(rng.randint(0, 300))).encode()
        assert S.cuts(text) == plain_cuts(text)
    for text in ("", "x", " ", "x" * 1500, "字" * 900, "".join(rng.choice("天地玄黄宇宙洪荒日月") for _ in range(4000)), "a" * 63 + "é" * 700, "to be " * 300):
        assert S.cuts(text.encode()) == plain_cuts(text.encode())


def test_unspaced_text_is_cut_by_content():
    rng = random.Random(8)
    shared = "".join(rng.choice("天地玄黄宇宙洪荒日月盈昃辰宿列张") for _ in range(2000))
    a, b = (("".join(rng.choice("寒来暑往秋收冬藏") for _ in range(n)) + shared).encode() for n in (300, 457))
    parts = lambda t: {t[i:j] for i, j in zip([0, *S.cuts(t)], S.cuts(t))}
    assert sum(map(len, parts(a) & parts(b))) > 0.8 * len(shared.encode())
    assert all(p.decode() for p in parts(a) | parts(b))


def test_cuts_resist_insertions():
    rng = random.Random(6)
    words = [hashlib.md5(bytes([rng.randrange(256)] * 3)).hexdigest()[: rng.randint(2, 9)] for _ in range(4000)]
    a = " ".join(words).encode()
    b = " ".join([*words[:1500], "inserted", *words[1500:]]).encode()
    parts = lambda t: {t[i:j] for i, j in zip([0, *S.cuts(t)], S.cuts(t))}
    assert len(parts(a) - parts(b)) <= 4


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = brute(docs)
    got = S.query(spark, SF).collect()
    assert len(got) == len(docs) and want
    pairs = lambda text: [tuple(map(int, s.split("-"))) for s in text.split(",")] if text else []
    assert {r.doc_id: (pairs(r.spans), pairs(r.own_spans)) for r in got if r.n_spans or r.n_own_spans} == want
    assert all((r.n_spans, r.n_own_spans) == tuple(map(len, want.get(r.doc_id, ([], [])))) and r.repeated == (r.n_spans > 0) for r in got)


def test_every_passage_of_over_50_words_is_found(spark):
    """Exact passages of 51 words or more in an earlier document, by comparing all windows of 51 words."""
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    first, want = {}, set()
    for i in sorted(docs):
        w = (docs[i] or "").split(" ")
        for k in range(len(w) - 50):
            if first.setdefault(tuple(w[k : k + 51]), i) != i:
                want.add(i)
    got = {r.id for r in S.repeats(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("size(spans) > 0").collect()}
    assert len(want) > 50 and want <= got


def test_hot_digests_give_the_same(spark, monkeypatch):
    """With almost every digest that repeats taken for hot, and with none."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").union(spark.range(900, 1300).selectExpr("id", "'one line that very many documents have at the same place, and it is long enough to be a passage of its own, as it goes on and on and on until it ends at last'", "'en'", "'s'", "0L"))
    want = brute({r.doc_id: r.text for r in docs.collect()})
    for least in (1, 10**9):
        monkeypatch.setattr(S, "LEAST_HOT", least)
        monkeypatch.setattr(S, "HOT", 10**6)
        assert found(S.repeats(docs)) == want


def test_shared_passage_is_cut_once(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(2, 9)))
    passage = " ".join(word() for _ in range(60))
    docs = [(i, " ".join(word() for _ in range(80)) + " " + passage + " " + " ".join(word() for _ in range(80))) for i in range(12)]
    docs += [(50, " ".join(word() for _ in range(200))), (None, passage), (None, passage), (51, None), (52, ""), (53, "q" * 90000), (54, "q" * 90000)]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, spans int")
    out = S.deduplicated(df)
    assert out.columns == df.columns
    rows = {-1 if r.doc_id is None else r.doc_id: r.text for r in out.collect()}
    assert rows[0] == docs[0][1] and rows[50] == docs[12][1] and rows[51] is None and rows[52] == "" and rows[-1] == passage
    for i in range(1, 12):
        assert 80 * 2 <= len(rows[i].split()) < 80 * 2 + 35
    assert S.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_own_repetitions(spark):
    line = "one line of nine words that a document repeats "
    docs = {1: line * 9, 2: "nothing of the kind here", 3: line * 4, 4: "word " * 400}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert found(S.repeats(df)) == brute(docs)
    kept = {r.doc_id: r.text for r in S.deduplicated(df).collect()}
    assert len(kept[1]) <= 3 * len(line) and kept[2] == docs[2] and len(kept[4]) < 40
    assert {r.doc_id: r.text for r in S.deduplicated(df, within=False).collect()}[4] == docs[4]


def test_rows_of_one_id_are_documents_of_their_own(spark):
    """Rows (1, P), (2, A + P), (2, X): X shares nothing and keeps every character, in whatever script."""
    passage = " ".join(f"passage{k}" for k in range(120))
    before = " ".join(f"before{k}" for k in range(40))
    for word in ("plain{}", "žluťoučký{}", "漢字仮名{}", "無空白"):
        x = (" " if "{" in word else "").join(word.format(k) for k in range(200))
        rows = [(1, passage), (2, f"{before} {passage}"), (2, x)]
        for order in (rows, rows[::-1]):
            got = {(r.doc_id, r.text[:9]): r.text for r in S.deduplicated(spark.createDataFrame(order, "doc_id long, text string")).collect()}
            assert len(got) == 3 and got[2, x[:9]] == (x if "{" in word else got[2, x[:9]]) and got[1, passage[:9]] == passage
            assert len(got[2, before[:9]]) < len(before) + len(passage) / 3
            if "{" not in word:  # a text that repeats itself is cut within itself only
                assert set(got[2, x[:9]]) <= set(x)
    found = {(r.id, len(r.spans)) for r in S.repeats(spark.createDataFrame([(1, passage), (2, f"{before} {passage}"), (2, "short text")], "doc_id long, text string")).collect()}
    assert found == {(2, 1)}
