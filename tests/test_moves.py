"""How much folds over rows move: shuffled and written bytes against the text's, and that what goes on from block to block stays whole."""

import random
import string

import pytest
from pyspark.sql import functions as F

from leafmill.operators import folds
from leafmill.operators import segmentation as seg
from leafmill.plans import basics


def moved(spark):
    """Bytes shuffled, written and spilled so far, of the stages that the session still knows."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(s.shuffleWriteBytes() + s.outputBytes() + s.diskBytesSpilled() for s in (stages.apply(k) for k in range(stages.size())))


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """Two thousand documents of some forty lines, 6 MB of letters that hardly compress."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choices(string.ascii_letters, k=7))
    rows = [(d, k, " ".join(word() for _ in range(rng.randint(2, 12))) + rng.choice([".", ""])) for d in range(2000) for k in range(rng.randint(20, 60))]
    path = str(tmp_path_factory.mktemp("lines"))
    spark.createDataFrame(rows, "doc_id int, line_no int, text string").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), sum(len(r[2]) for r in rows)


def times(spark, df, chars):
    before = moved(spark)
    df().write.format("noop").mode("overwrite").save()
    return (moved(spark) - before) / chars


def test_chunks_move_texts_a_few_times(spark, lines):
    """Lines into paragraphs, paragraphs to disk, paragraphs into chunks."""
    rows, chars = lines
    found = times(spark, lambda: folds.row_chunks(folds.line_paragraphs(rows), 900), chars)
    assert found < 5


def test_segments_move_texts_a_few_times(spark, lines):
    """Segments hold whole documents here, and move no more than chunks."""
    rows, chars = lines
    assert times(spark, lambda: folds.row_chunks(folds.line_paragraphs(rows), 20_000), chars) < 5


def test_paragraphs_move_texts_once(spark, lines):
    """Lines into paragraphs: the texts once, besides them numbers only."""
    rows, chars = lines
    assert times(spark, lambda: folds.line_paragraphs(rows), chars) < 2.5


def test_paragraphs_of_lines_moves_in_proportion(spark, tmp_path):
    """The query on two sizes, its result written: the texts once into blocks and once into the result, besides them numbers only, and no more of either on the larger table. Both are too small to be dealt out by ``session.spread``."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choices(string.ascii_letters, k=7))
    line = lambda: " ".join(word() for _ in range(rng.randint(2, 12))) + rng.choice([".", ""])
    rows = [(d, "\n".join(line() for _ in range(rng.randint(20, 60)))) for d in range(1500)]
    found = []
    for n in (500, 1500):
        spark.createDataFrame(rows[:n], "doc_id long, text string").write.parquet(str(tmp_path / f"{n}/documents.parquet"))
        before = moved(spark)
        basics.paragraphs_of_lines(spark, str(tmp_path / str(n))).write.parquet(str(tmp_path / f"{n}/out"))
        found.append((moved(spark) - before) / sum(len(text) for _, text in rows[:n]))
    assert max(found) < 4 and found[1] < 1.1 * found[0], found


WORDS = "the of and to in that was with for e.g. Dr. Mr. house water under between something extraordinary".split()


def texts(rng, n):
    """Lines that end paragraphs in all ways, go on for long, or are nothing that a paragraph has."""
    kinds = ["", " ", "12", "Page 3 of 4", "x-", "-", "Yes.", "a\u00ad"]
    return [rng.choice(kinds) if rng.random() < 0.25 else " ".join(rng.choices(WORDS, k=rng.randint(1, 14))) + rng.choice(["", "", ".", "-", "!", " "]) for _ in range(n)]


@pytest.mark.parametrize("size", [1, 3, 7])
def test_what_goes_on_from_block_to_block_is_whole(spark, monkeypatch, size):
    """Paragraphs and chunks over many blocks, empty blocks between them, and a null document."""
    monkeypatch.setattr(folds, "BLOCK", size)
    rng = random.Random(size)
    docs = {d: texts(rng, rng.choice([1, 2, 5, 20, 60])) for d in range(25)} | {25: ["no", "end"] * 20, 26: [""] * 9, 27: ["so", *["5"] * 8, "on"], None: texts(rng, 30)}
    rows = [(d, k * (1 + (d or 0) % 2) - 4, line) for d, ls in docs.items() for k, line in enumerate(ls)]
    rng.shuffle(rows)
    arrays = spark.createDataFrame(list(docs.items()), "doc_id int, lines array<string>").withColumn("p", seg.paragraphs(F.col("lines")))
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    want = arrays.select("doc_id", F.posexplode("p").alias("para_no", "text"))
    got = folds.line_paragraphs(spark.createDataFrame(rows, "doc_id int, line_no int, text string"))
    assert got.schema["para_no"].dataType.simpleString() == "int"
    assert key(got) == key(want)
    for most in (40, 400):
        chunks = arrays.select("doc_id", F.posexplode(seg.chunks(F.col("p"), most)).alias("chunk_no", "c")).select("doc_id", "chunk_no", "c.text", "c.ends_paragraph")
        assert key(folds.row_chunks(want, most)) == key(chunks)
