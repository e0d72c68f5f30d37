"""Whole plans: chapters of PDF line tables, audiobooks and narrated slides. Lazy DataFrames all through."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill import constants as C
from leafmill.functions import text as T
from leafmill.functions import timing
from leafmill.operators import media, structure
from leafmill.operators import segmentation as seg
from leafmill.operators.running import running_totals

#: Words that text before the first chapter needs to be kept, images a chapter shows at most, blocks a page counts as empty below.
PREFACE_WORDS, MAX_PDF_IMAGES = 150, 10


def page_lines(lines: DataFrame) -> DataFrame:
    """[S7] Lines as a PDF extractor gives them, normalised: blank ones out, sizes to a tenth.

    ``lines``: (doc_id, page, line_no, text, size, bold, block_start).
    """
    clean = lines.withColumn("text", T.strip(T.normalize(F.col("text")))).where("text <> ''")
    return clean.withColumn("size", F.bround("size", 1))


def pdf_chapters(lines: DataFrame, outline: DataFrame, titles: DataFrame) -> DataFrame:
    """[S6, P2] Chapters of PDF documents from their lines.

    ``titles``: (doc_id, doc_title, stem). Running headers go first. Chapters start where the outline says, else at
    large headings; a document without either is one chapter. Text before the first chapter is one of its own if
    it has more than 150 words. A blank line stands before each block.
    """
    order = Window.partitionBy("doc_id").orderBy("page", "line_no")
    kept = structure.remove_running_headers(page_lines(lines)).withColumn("i", F.row_number().over(order) - 1)
    by_outline = structure.chapters_from_outline(outline, kept.select("doc_id", "i", "page", "text"))
    fonts = structure.chapters_from_fonts(kept).withColumn("ord", F.col("start"))
    starts = by_outline.unionByName(fonts.join(by_outline.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "start", "title", "ord"))
    sliced = structure.chapter_slices(starts, kept).join(titles, "doc_id")
    line = F.when(F.col("block_start"), F.concat(F.lit("\n"), F.col("text"))).otherwise(F.col("text"))
    rows = sliced.groupBy("doc_id", "chapter_no", "doc_title", "stem").agg(
        F.first("title").alias("title"), F.array_sort(F.collect_list(F.struct("i", line.alias("t")))).alias("l"), F.max(F.max("chapter_no")).over(Window.partitionBy("doc_id")).alias("__last")
    )
    paras = seg.document_paragraphs(F.array_join(F.transform("l", lambda x: x["t"]), "\n"))
    rows = rows.withColumn("paragraphs", paras)
    words = F.aggregate("paragraphs", F.lit(0), lambda a, p: a + T.word_count(p))
    rows = rows.where((F.col("chapter_no") > 0) | (F.col("__last") == 0) | (words > PREFACE_WORDS))
    title = F.when(F.col("chapter_no") > 0, F.col("title")).otherwise(F.col("doc_title"))
    return rows.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("chapter_no")).alias("number"), title.alias("title"), "paragraphs", "doc_title", "stem")


def chapter_images(images: DataFrame, most: int = MAX_PDF_IMAGES) -> DataFrame:
    """[S9, O4] The first images of each chapter: large enough, each object once, ten at most."""
    kept = images.where((F.col("width") >= C.MIN_IMAGE_SIDE) & (F.col("height") >= C.MIN_IMAGE_SIDE))
    once = kept.withColumn("__k", F.row_number().over(Window.partitionBy("doc_id", "number", "xref").orderBy("position"))).where("__k = 1")
    return once.withColumn("__k", F.row_number().over(Window.partitionBy("doc_id", "number").orderBy("position"))).where(F.col("__k") <= most).drop("__k")


def estimated(rate: float = 1.0) -> Callable[[Column], Column]:
    """Speech seconds by the words of a text, where no speech engine measures them."""
    return lambda text: timing.estimate_seconds(T.word_count(text), rate)


def audiobook_plan(chapters: DataFrame, max_minutes: float = 10.0, speech: Callable[[Column], Column] | None = None, ext: str = "mp3") -> DataFrame:
    """[K11, W1, W10, X8, X12, X17] A row for each audio file: its chapter, part, name, title, track and seconds.

    ``chapters``: (doc_id, number, title, paragraphs, doc_title). Chunks, their speech and the parts stay in the
    chapter's row; tracks run through a document. ``speech`` maps a text column to seconds, by default an estimate.
    """
    limit = timing.split_limit(F.lit(float(max_minutes)))
    most = min(900, int(max(200, max(30.0, max_minutes * 60 - C.SPLIT_MARGIN) * C.CHARS_PER_SECOND / 4)))
    speech = speech or estimated()
    chunks = chapters.select("doc_id", "number", "title", "doc_title", F.posexplode(seg.chapter_chunks(F.col("title"), F.col("paragraphs"), most)).alias("k", "c"))
    spoken = chunks.withColumn("seconds", speech(F.col("c.text")) + C.CHUNK_GAP)
    rows = spoken.groupBy("doc_id", "number").agg(F.first("title").alias("title"), F.first("doc_title").alias("doc_title"), F.array_sort(F.collect_list(F.struct("k", "seconds", F.col("c.ends_paragraph").alias("e")))).alias("s"))
    part = seg.plan_parts(F.transform("s", lambda s: s["seconds"]), F.transform("s", lambda s: s["e"]), limit)
    parts = rows.withColumn("p", part).select("doc_id", "number", "title", "doc_title", F.explode(F.arrays_zip("p", "s")).alias("x"))
    parts = parts.groupBy("doc_id", "number", "title", "doc_title", F.col("x.p").alias("part_no")).agg(F.count("*").alias("chunks"), F.sum("x.s.seconds").alias("seconds"))
    n = F.count("*").over(Window.partitionBy("doc_id", "number"))
    last = chapters.groupBy("doc_id").agg(F.max("number").alias("chapter_count"))
    parts = running_totals(parts.withColumn("parts", n), ["doc_id"], [F.col("number").asc(), F.col("part_no").asc()], {"track": F.lit(1)}).join(last, "doc_id").withColumn("track", F.col("track").cast("int"))
    name = media.part_filename(F.col("number"), F.col("chapter_count"), F.col("title"), F.col("part_no") + 1, F.col("parts"), ext)
    return parts.select("doc_id", "number", "part_no", "parts", "track", name.alias("filename"), media.part_title(F.col("title"), F.col("part_no") + 1, F.col("parts")).alias("tag_title"), F.col("doc_title").alias("album"), "chunks", (F.col("seconds") + C.LEAD_SILENCE).alias("seconds"))


def video_plan(scenes: DataFrame, max_minutes: float = 10.0, speech: Callable[[Column], Column] | None = None) -> DataFrame:
    """[K12, B5] A row for each clip of narrated slides: a title clip and the scenes, with part and seconds.

    ``scenes``: (doc_id, number, chapter_title, scene_no, title, narration), scene_no from 1. A part may end behind any
    clip. Cues of a part follow from :func:`leafmill.sources.sinks.clip_cues`.
    """
    speech = speech or estimated()
    titles = scenes.select("doc_id", "number", "chapter_title").distinct().select("doc_id", "number", F.lit(0).alias("clip_no"), F.col("chapter_title").alias("title"), F.col("chapter_title").alias("narration"))
    clips = scenes.select("doc_id", "number", F.col("scene_no").alias("clip_no"), "title", "narration").unionByName(titles)
    clips = clips.withColumn("audio_seconds", speech(F.col("narration"))).withColumn("seconds", F.col("audio_seconds") + C.CLIP_PAD)
    rows = clips.groupBy("doc_id", "number").agg(F.array_sort(F.collect_list(F.struct("clip_no", "title", "narration", "audio_seconds", "seconds"))).alias("c"))
    part = seg.plan_parts(F.transform("c", lambda c: c["seconds"]), F.transform("c", lambda c: F.lit(True)), timing.split_limit(F.lit(float(max_minutes))))
    out = rows.withColumn("p", part).select("doc_id", "number", F.explode(F.arrays_zip("p", "c")).alias("x"))
    return out.select("doc_id", "number", F.col("x.p").alias("part_no"), "x.c.*")


def script_summary(scenes: DataFrame) -> DataFrame:
    """[K13, A12, U1] Scenes, illustrated ones and words of each chapter's script."""
    return scenes.groupBy("doc_id", "number").agg(F.count("*").alias("scenes"), F.count("kind").alias("illustrated"), F.sum(T.word_count(F.col("narration"))).alias("words"))


def reveal_steps(items: Column) -> Column:
    """[X24] Frames of a diagram's reveal: one an item."""
    return F.size(items)


def progress(done: Column, total: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """[X32] A step's share of a job: done of total, within the step's range, 0 to 1."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), done / F.greatest(F.lit(1), total)))
    return F.lit(low) + share * (high - low)
