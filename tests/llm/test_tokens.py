import itertools
import math
import random
import struct

import duckdb
import pytest
from tokenizers import Tokenizer
from tokenizers.models import Unigram

from leafmill.llm import tokens as T

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pieces():
    with open(T.VOCABULARY, "rb") as f:
        return T.read_pieces(f.read())


def brute(word, pieces, memo):
    """Count of the best segmentation, from the end, without sharing."""
    low = min(pieces.values()) - T.UNKNOWN
    best = {len(word): (0.0, 0)}
    for i in range(len(word) - 1, -1, -1):
        score, n = best[i + 1]
        options = [(score + low, n - len(word[i].encode()))]
        for j in range(i + 1, min(len(word), i + 40) + 1):
            if word[i:j] in pieces:
                options.append((best[j][0] + pieces[word[i:j]], best[j][1] - 1))
        best[i] = max(options)
    return -best[0][1]


def test_pieces(pieces):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=T.VOCABULARY)
    ordinary = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))}
    assert pieces.keys() == ordinary.keys() and T.zipf(ordinary) == pieces
    assert sum(math.exp(s) for s in pieces.values()) == pytest.approx(1)
    ranks = sorted(ordinary, key=ordinary.get, reverse=True)
    assert all(pieces[a] > pieces[b] for a, b in itertools.pairwise(ranks))


def test_scores_of_a_unigram_model_are_kept():
    def field(n, kind, data):
        return bytes([n << 3 | kind]) + (bytes([len(data)]) if kind == 2 else b"") + data

    piece = lambda text, score: field(1, 2, field(1, 2, text.encode()) + field(2, 5, struct.pack("<f", score)))
    pieces = piece("a", -1.5) + piece("ab", -2.25)
    assert T.read_pieces(pieces) == T.read_pieces(pieces + field(2, 2, field(3, 0, b"\x01"))) == {"a": -1.5, "ab": -2.25}
    assert T.read_pieces(pieces + field(2, 2, field(3, 0, b"\x02"))) == T.zipf({"a": -1.5, "ab": -2.25})


def test_query_equals_brute_force(spark, pieces):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    memo = {}
    got = {r.doc_id: (r.n_tokens, r.n_pretokens) for r in T.query(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for i in sorted(docs):
        words = docs[i].split()
        for w in set(words) - memo.keys():
            memo[w] = brute("▁" + w, pieces, memo)
        assert got[i] == (sum(memo[w] for w in words), len(words))


def test_agrees_with_a_unigram_library(pieces):
    """Exactly, on all words of the documents whose characters the vocabulary knows (the library counts others in its own way) and on random ones."""
    rng = random.Random(2)
    model = Tokenizer(Unigram([("<unk>", 0.0), *pieces.items()], unk_id=0))
    counter = T.Counter(pieces)
    words = {"".join(rng.choice("abcdehilnorst▁") for _ in range(rng.randint(1, 30))) for _ in range(2000)}
    for (text,) in duckdb.sql(f"select text from '{SF}/documents.parquet'").fetchall():
        words |= {T.SPACE + w for w in (text or "").split() if all(c in pieces for c in w)}
    assert len(words) > 5000
    for word in words:
        assert counter.count(word) == len(model.encode(word).ids), word


def test_near_the_tokenizer_of_the_vocabulary(pieces):
    """The vocabulary's own tokenizer merges; unigram counts under Zipf's law differ from it by little."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=T.VOCABULARY)
    texts = [" ".join((t or "").split()) for (t,) in duckdb.sql(f"select text from '{SF}/documents.parquet'").fetchall()]
    counter = T.Counter(pieces)
    ours, theirs = sum(counter.text(t)[0] for t in texts), sum(len(model.encode(t)) for t in texts)
    assert ours == pytest.approx(theirs, rel=0.04)


def test_sharing_and_bounds(pieces, monkeypatch):
    words = ["▁" + w for w in ("inter", "internal", "international", "internationally", "\U0001f600x", "ñ" * 30, "a" * 500)]
    fresh = [T.Counter(pieces).count(w) for w in words]
    shared = T.Counter(pieces)
    assert [shared.count(w) for w in words] == fresh == [brute(w, pieces, {}) for w in words]
    monkeypatch.setattr(T, "MAX_NODES", 5)
    assert [shared.count(w) for w in words * 2] == fresh * 2


def test_edges(spark):
    rows = [(1, None, 1), (2, "", 2), (3, " \n", 3), (None, "word", 4), (None, "word", 4), (5, "x" * 100000, 5), (6, "wort " * 50000, 6)]
    got = T.with_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")).collect()
    assert len(got) == len(rows)
    by = {r.id: r for r in got}
    assert by[1].n_tokens == by[2].n_tokens == by[3].n_pretokens == 0
    assert by[6].n_pretokens == 50000 and by[5].n_tokens >= 1
    assert T.with_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
