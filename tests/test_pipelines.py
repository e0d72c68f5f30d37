"""Whole plans: audiobooks, slides, and chapters of PDF line tables."""

from pyspark.sql import functions as F

from leafmill.functions import ports
from leafmill.operators import pipelines
from leafmill.sources import sinks

LOREM = "The quick brown fox jumps over the lazy dog. Pack my box with five dozen liquor jugs! How vexingly quick daft zebras jump?"
BOOK = "doc_id int, number int, title string, paragraphs array<string>, doc_title string"


def test_audiobook(spark):
    chapters = spark.createDataFrame([(1, 1, "Short: intro", [LOREM], "My Book"), (1, 2, "Long one", [" ".join([LOREM] * 3)] * 10, "My Book")], BOOK)
    rows = pipelines.audiobook_plan(chapters, 1.5, ports.speech_seconds()).orderBy("track").collect()
    assert [r.track for r in rows] == list(range(1, len(rows) + 1)) and rows[0].filename == "01 - Short intro.mp3" and rows[0].album == "My Book"
    long = [r for r in rows if r.number == 2]
    assert len(long) >= 3 and long[0].filename == "02 - Long one_1.mp3" and long[1].tag_title == "Long one (2)"
    assert all(r.seconds <= 90.5 for r in rows)


def test_video_cues(spark):
    scenes = spark.createDataFrame([(1, 1, "One", k, f"S{k}", LOREM) for k in (1, 2, 3)], "doc_id int, number int, chapter_title string, scene_no int, title string, narration string")
    clips = pipelines.video_plan(scenes, 10.0)
    assert clips.count() == 4 and clips.select("part_no").distinct().count() == 1
    text = sinks.srt_documents(clips).first().srt
    assert text.startswith("1\n00:00:00,200 --> ") and text.count("-->") == 10


def lines(rows):
    return [(1, p, n, t, float(s), b, st) for p, n, t, s, b, st in rows]


def test_pdf_chapters_with_and_without_outline(spark):
    body = lambda name: " ".join([name, "body"] * 30) + "."
    rows = []
    for p, name in enumerate(("Introduction", "Methods", "Results", "Outlook")):
        rows += [(p, 0, "A Running Header", 9, False, True), (p, 1, name, 24, False, True), (p, 2, body(name), 11, False, True), (p, 3, f"page {p + 1}", 9, False, True)]
    df = spark.createDataFrame(lines(rows), "doc_id int, page int, line_no int, text string, size double, bold boolean, block_start boolean")
    titles = spark.createDataFrame([(1, "Paper", "paper")], "doc_id int, doc_title string, stem string")
    entries = [(1, k, 1, t, k + 1) for k, t in enumerate(("Introduction", "Methods", "Results", "Outlook"))]
    kind = "doc_id int, ord int, level int, title string, page int"
    for outline in (entries, []):
        got = pipelines.pdf_chapters(df, spark.createDataFrame(outline, kind), titles).orderBy("number").collect()
        assert [r.title for r in got] == ["Introduction", "Methods", "Results", "Outlook"]
        assert all("A Running Header" not in " ".join(r.paragraphs) and body(r.title) in r.paragraphs for r in got)


def test_pdf_without_chapters_is_one(spark):
    df = spark.createDataFrame(lines([(0, k, "plain text that goes on and on.", 11, False, k == 0) for k in range(5)]), "doc_id int, page int, line_no int, text string, size double, bold boolean, block_start boolean")
    got = pipelines.pdf_chapters(df, spark.createDataFrame([], "doc_id int, ord int, level int, title string, page int"), spark.createDataFrame([(1, "Paper", "paper")], "doc_id int, doc_title string, stem string")).collect()
    assert [r.title for r in got] == ["Paper"]


def test_images_limited(spark):
    df = spark.createDataFrame([(1, 1, k, k // 2, 300 if k != 4 else 50, 300) for k in range(40)], "doc_id int, number int, position int, xref int, width int, height int")
    got = [r.position for r in pipelines.chapter_images(df).orderBy("position").collect()]
    assert len(got) == 10 and got[:3] == [0, 2, 5]


def test_progress(spark):
    r = spark.range(1).select(pipelines.progress(F.lit(3), F.lit(4), 0.2, 0.8).alias("a"), pipelines.progress(F.lit(9), F.lit(4)).alias("b"), pipelines.reveal_steps(F.array(F.lit(1), F.lit(2))).alias("c")).first()
    assert (round(r.a, 6), r.b, r.c) == (0.65, 1.0, 2)
