"""File names, tags, cue times and plans of audio and video output, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill import constants as C
from leafmill.functions import text as T


def number_width(chapters: Column) -> Column:
    """[X9] Digits of the chapter number in file names: two at least."""
    return F.greatest(F.lit(2), F.length(chapters.cast("string")))


def part_filename(number: Column, chapters: Column, title: Column, part: Column, parts: Column, ext: str) -> Column:
    """[X8] ``NN - Title.ext``, with ``_k`` where a chapter has several parts."""
    no = number.cast("string")
    width = F.greatest(number_width(chapters), F.length(no))
    name = F.concat(F.repeat(F.lit("0"), width - F.length(no)), no, F.lit(" - "), T.safe_filename(title, compose=False))
    return F.concat(name, F.when(parts > 1, F.concat(F.lit("_"), part.cast("string"))).otherwise(""), F.lit(f".{ext}"))


def part_title(title: Column, part: Column, parts: Column) -> Column:
    """[X17] The title tag of a part."""
    return F.concat(title, F.when(parts > 1, F.concat(F.lit(" ("), part.cast("string"), F.lit(")"))).otherwise(""))


def audio_tags(title: Column, album: Column, track: Column, author: Column) -> Column:
    """[X17] Tags of an audio file; the artist only where there is an author."""
    tags = F.create_map(F.lit("title"), title, F.lit("album"), album, F.lit("track"), track.cast("string"), F.lit("genre"), F.lit("Audiobook"))
    return F.when(F.coalesce(author, F.lit("")) != "", F.map_concat(tags, F.create_map(F.lit("artist"), author))).otherwise(tags)


def timed_cues(cues: Column, offset: Column, audio: Column) -> Column:
    """[W5] Number, start, stop and text of a clip's cues: speech time by length, after the audio's delay."""

    def build(c: Column) -> Column:
        grown = lambda a, x: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + F.length(x)))
        ends = F.aggregate(c, F.array().cast("array<int>"), grown)

        def of(stops: Column) -> Column:
            total = F.greatest(F.lit(1), F.get(stops, F.size(stops) - 1))
            at = lambda n: offset + C.AUDIO_DELAY + audio * n / total
            return F.transform(c, lambda x, i: F.struct((i + 1).alias("number"), at(stops[i] - F.length(x)).alias("start"), at(stops[i]).alias("stop"), x.alias("cue")))

        return T.let(ends, of)

    return T.let(cues, build)
