"""Sinks: subtitles, image catalogues, info lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.functions import timing
from leafmill.operators import media, segmentation


def clip_cues(clips: DataFrame) -> DataFrame:
    """[W5] (doc_id, number, start, stop, cue) of the clips of each document, one after the other.

    ``clips``: (doc_id, clip_no, seconds, audio_seconds, narration). Offsets and first numbers are running sums over
    the clips before; cues are timed within their clip.
    """
    before = Window.partitionBy("doc_id").orderBy("clip_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = clips.withColumn("cues", segmentation.subtitle_cues(F.col("narration")))
    rows = rows.withColumn("offset", F.coalesce(F.sum("seconds").over(before), F.lit(0.0))).withColumn("first", F.coalesce(F.sum(F.size("cues")).over(before), F.lit(0)))
    timed = rows.select("doc_id", "first", F.explode(media.timed_cues(F.col("cues"), F.col("offset"), F.col("audio_seconds"))).alias("x"))
    return timed.select("doc_id", (F.col("first") + F.col("x.number")).cast("int").alias("number"), F.col("x.start").alias("start"), F.col("x.stop").alias("stop"), F.col("x.cue").alias("cue"))


def srt_documents(clips: DataFrame) -> DataFrame:
    """[K6, X15] (doc_id, srt): subtitles as text."""
    cues = clip_cues(clips)
    entry = F.concat(F.col("number").cast("string"), F.lit("\n"), timing.srt_time(F.col("start")), F.lit(" --> "), timing.srt_time(F.col("stop")), F.lit("\n"), F.col("cue"), F.lit("\n"))
    rows = cues.select("doc_id", "number", entry.alias("entry")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("number", "entry"))).alias("e"))
    return rows.select("doc_id", F.array_join(F.transform("e", lambda e: e["entry"]), "\n").alias("srt"))


def write_catalogue(images: DataFrame, path: str) -> bool:
    """[K4, K5] The image catalogue as JSON; nothing is written for no images."""
    if images.isEmpty():
        return False
    images.write.json(path)
    return True


def info_line(number: Column, title: Column, words: Column, images: Column) -> Column:
    """[K2] One line on a chapter."""
    duration = timing.format_duration(timing.estimate_seconds(words))
    shown = F.when(images > 0, F.format_string(", %d images", images)).otherwise("")
    return F.concat(F.lpad(number.cast("string"), 3, " "), F.lit("  "), F.substring(title, 1, 60), F.lit("  "), words.cast("string"), F.lit(" words, "), duration, shown)


def output_dir(path: Column, suffix: str) -> Column:
    """[X10] The folder beside a file, named after it."""
    return F.concat(F.regexp_replace(path, r"[^/]*$", ""), F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", ""), F.lit(f"_{suffix}"))


def local_path(text: Column) -> Column:
    """[S17] A path as people give it: quotes and the scheme ``file:`` taken off."""
    bare = F.regexp_replace(F.trim(text), r"""^(['"])(.*)\1$""", "$2")
    return F.when(bare.startswith("file://"), F.url_decode(F.replace(F.regexp_replace(bare, r"^file://[^/]*", ""), F.lit("+"), F.lit("%2B")))).otherwise(bare)


def needs_recognition(chars: Column, images: Column, drawings: Column) -> Column:
    """[F10, S8] A page with hardly any text but pictures or many drawings."""
    return (chars < 25) & ((images > 0) | (drawings > 20))
