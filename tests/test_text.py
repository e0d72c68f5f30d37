"""Exact results and invariants of the text operators, against plain Python."""

import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill import constants as C
from leafmill.functions import language, text
from leafmill.operators import segmentation as seg

LOREM = "The quick brown fox jumps over the lazy dog. Pack my box with five dozen liquor jugs! How vexingly quick daft zebras jump?"


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first().r


def plain_sentences(t):
    t = " ".join(t.split())
    out, start = [], 0
    for m in re.finditer(C.SENTENCE_END.replace("SPACE", r"\s"), t):
        piece = t[start : m.end(1)]
        last = piece.split(" ")[-1].rstrip(".").lower()
        if last in C.ABBREVIATIONS or len(last) == 1 and last.isalpha():
            continue
        out.append(piece.strip())
        start = m.end()
    return out + [t[start:].strip()] * bool(t[start:].strip())


def plain_parts(durations, ends, most):
    """Part of each item; written from the rule, not from the expression."""
    rest, out, elapsed, part = sum(durations), [], 0.0, 0
    aim = lambda r: r / math.ceil(r / most) if r > most else r
    if rest <= most:
        return [0] * len(durations)
    target = aim(rest)
    for i, d in enumerate(durations):
        if i and out[-1] == part and elapsed:
            over, under = elapsed + d - target, target - elapsed
            if elapsed + d > most or over > 0 and under < (2 if ends[i - 1] else 1) * over:
                rest, part = rest - elapsed, part + 1
                target, elapsed = aim(rest), 0.0
        out.append(part)
        elapsed += d
    return out


def test_sentences(spark):
    got = one(spark, "Hello Dr. Smith came at 5 p.m. today. He left. \"Why?\" She asked. J. R. R. was here… Yes", lambda c: text.sentences(c))
    assert got == ["Hello Dr. Smith came at 5 p.m. today.", "He left.", '"Why?"', "She asked.", "J. R. R. was here…", "Yes"]
    assert one(spark, "", lambda c: text.sentences(c)) == []


def test_sentences_equal_plain(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    paras = [p for d in docs for p in d.split("\n")]
    got = spark.createDataFrame([(i, p) for i, p in enumerate(paras)], "i int, p string").select("i", text.sentences(F.col("p")).alias("s")).collect()
    assert {r.i: r.s for r in got} == {i: plain_sentences(p) for i, p in enumerate(paras)}


def test_wrapped_lines(spark):
    lines = ["A first line that is con-", "tinues here.", "", "Second para.", "12"]
    assert one(spark, lines, lambda c: seg.paragraphs(c), "array<string>") == ["A first line that is continues here.", "Second para."]


@pytest.mark.parametrize("most", [60, 500, 5000])
def test_chunks_lossless_and_bounded(spark, most):
    paras = [" ".join([LOREM] * 20), "Short one.", " ".join([LOREM] * 3)]
    got = one(spark, paras, lambda c: seg.chunks(c, most), "array<string>")
    assert all(len(c.text) <= most for c in got) and got[-1].ends_paragraph
    assert " ".join(c.text for c in got).split() == " ".join(paras).split()
    if most == 500:
        assert all(c.text[-1] in ".!?" for c in got)


def test_long_word_stands_alone(spark):
    got = one(spark, ["a " + "x" * 50 + " b. C d."], lambda c: seg.chunks(c, 20), "array<string>")
    assert "x" * 50 in [c.text for c in got]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 200), st.booleans()), min_size=1, max_size=40), st.integers(60, 400))
def test_parts(spark, items, most):
    durations, ends = [float(d) for d, _ in items], [e for _, e in items]
    df = spark.createDataFrame([(durations, ends)], "d array<double>, e array<boolean>")
    got = df.select(seg.plan_parts(F.col("d"), F.col("e"), float(most)).alias("p")).first().p
    assert got == plain_parts(durations, ends, most)
    for part in set(got):
        mine = [d for d, p in zip(durations, got, strict=True) if p == part]
        assert sum(mine) <= most or len(mine) == 1


def test_balanced_parts(spark):
    df = spark.createDataFrame([([60.0] * 25, [True] * 25)], "d array<double>, e array<boolean>")
    got = df.select(seg.plan_parts(F.col("d"), F.col("e"), 600.0).alias("p")).first().p
    sizes = [got.count(p) for p in sorted(set(got))]
    assert len(sizes) == 3 and max(sizes) - min(sizes) <= 2


@pytest.mark.parametrize(("t", "want"), [("The cat is on the mat and it was not for this", "en"), ("Das ist nicht der Hund und die Katze", "de"), ("Je to na stole, ale není to pro nás", "cs"), ("", "en"), (None, "en"), ("zzz", "en")])
def test_language(spark, t, want):
    assert one(spark, t, language.detect_language) == want


def test_scenes(spark):
    words = lambda n, c: " ".join([c * 4] * (n - 1) + [c * 4 + "."])
    paras = [words(100, "a"), words(30, "b"), words(400, "c").replace(" cccc cccc", " cccc. Cccc"), words(5, "d")]
    got = spark.createDataFrame([(paras,)], "p array<string>").select(seg.scenes(F.lit("T"), F.col("p")).alias("s")).first().s
    assert " ".join(s.narration for s in got).split() == " ".join(paras).split()
    assert [s.title for s in got] == [f"T ({k}/{len(got)})" for k in range(1, len(got) + 1)] and all(1 <= len(s.bullets) <= 4 for s in got)
    assert got[0].bullets[0].endswith("…") and len(got[0].bullets[0].split()) == 14


def test_most_words_are_not_lower_cased(spark):
    """Lower-casing every last word took much of the time of sentences; only words that are not ASCII need it."""
    texts = ["See DR. Who. He left. É. Then Z. B. came.", "Ask Mr. Ö. Um. Nr. 5. \u212a. Yes. End.", *(f"One {a.upper()}. Two {a.title()}. Three." for a in C.ABBREVIATIONS)]
    words = spark.createDataFrame([(w,) for t in texts for w in t.split()], "w string")
    last = F.lower(F.rtrim("w", F.lit(".")))
    plain = last.rlike(rf"^(?:{'|'.join(a.replace('.', '[.]') for a in C.ABBREVIATIONS)}|\p{{L}})$")
    assert words.where(~text._abbreviated(F.col("w")).eqNullSafe(plain)).count() == 0 and words.where(plain).count() > 50
    shown = words.select(text._abbreviated(F.col("w")))._jdf.queryExecution().optimizedPlan().toString()
    assert "octet_length" in shown
