"""Durations, sizes and media arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill import constants as C


def estimate_seconds(words: Column, rate: float = 1.0) -> Column:
    """[X13] Narration time at 175 words a minute."""
    return words / F.lit(C.WORDS_PER_MINUTE * rate) * 60


def format_duration(seconds: Column) -> Column:
    """[X14] ``2 h 05 min``, ``12 min``, ``3 min 07 s`` or ``9 s``; halves round to even."""
    n = F.bround(seconds, 0).cast("long")
    h, m, s = F.floor(n / 3600).cast("long"), F.floor(n % 3600 / 60).cast("long"), n % 60
    return (
        F.when(h > 0, F.format_string("%d h %02d min", h, m))
        .when(m >= 10, F.format_string("%d min", m))
        .when(m > 0, F.format_string("%d min %02d s", m, s))
        .otherwise(F.format_string("%d s", s))
    )


def srt_time(seconds: Column) -> Column:
    """[X15] ``HH:MM:SS,mmm``; halves of a millisecond round to even."""
    ms = F.bround(seconds * 1000, 0).cast("long")
    at = lambda unit, size: F.floor(ms / unit).cast("long") % size
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000).cast("long"), at(60_000, 60), at(1000, 60), ms % 1000)


def format_size(size: Column) -> Column:
    """[X16] ``1.5 GB`` from a billion bytes, else whole ``MB``."""
    return F.when(size >= 1e9, F.format_string("%.1f GB", size / 1e9)).otherwise(F.format_string("%.0f MB", size / 1e6))


def chunk_chars(max_seconds: Column) -> Column:
    """[X11] Characters of a chunk for parts of so many seconds: a quarter of a part, 200 to 900."""
    return F.least(F.lit(900.0), F.greatest(F.lit(200.0), max_seconds * C.CHARS_PER_SECOND / 4)).cast("int")


def split_limit(max_minutes: Column) -> Column:
    """[X12] Seconds of a part: the minutes less a margin, 30 at least."""
    return F.greatest(F.lit(30.0), max_minutes * 60 - C.SPLIT_MARGIN)


def reveal_starts(audio: Column, n: Column) -> Column:
    """[W6] When each of ``n`` frames of a reveal begins: the first at 0, the rest spread over the speech."""
    later = F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.lit(C.AUDIO_DELAY) + audio * C.REVEAL_SPAN * k / n)
    return F.when(n > 1, F.concat(F.array(F.lit(0.0)), later)).otherwise(F.array(F.lit(0.0)))


def engine_rate(engine: Column, rate: Column) -> Column:
    """[X28] A speech rate in each engine's own terms."""
    return (
        F.when(engine == "edge", F.format_string("%+d%%", F.bround((rate - 1) * 100, 0).cast("int")))
        .when(engine == "piper", F.format_string("%.4f", 1 / F.greatest(F.lit(0.25), rate)))
        .when(engine == "kokoro", F.format_string("%.4f", F.least(F.lit(2.0), F.greatest(F.lit(0.5), rate))))
        .when(engine == "macos", F.bround(180 * rate, 0).cast("int").cast("string"))
    )


def clip_fade(starts: Column, total: Column) -> Column:
    """[X19] Starts clamped to the clip, and the cross-fade: 0.8 of the smallest gap, 0.04 to 0.4 s."""
    clamped = F.transform(starts, lambda s: F.least(s, total - 0.1))
    ends = F.concat(F.slice(clamped, 2, F.size(clamped)), F.array(total))
    gap = F.array_min(F.zip_with(clamped, ends, lambda a, b: b - a))
    return F.struct(clamped.alias("starts"), F.greatest(F.lit(0.04), F.least(F.lit(0.4), gap * 0.8)).alias("fade"))


def fit_rect(width: Column, height: Column, box_w: Column, box_h: Column) -> Column:
    """[X22] The largest rectangle of an image's shape in a box, centred: x, y, w, h."""
    scale = F.least(box_w / width, box_h / height)
    w, h = F.greatest(F.lit(1), (width * scale).cast("int")), F.greatest(F.lit(1), (height * scale).cast("int"))
    return F.struct(F.floor((box_w - w) / 2).cast("int").alias("x"), F.floor((box_h - h) / 2).cast("int").alias("y"), w.alias("w"), h.alias("h"))


def picture_size(side: Column, aspect: Column) -> Column:
    """[X20] Width and height of a picture: the model's pixels at an aspect of 1/2 to 2, in steps of 64, 256 at least."""
    a = F.least(F.lit(2.0), F.greatest(F.lit(0.5), aspect))
    step = lambda x: F.greatest(F.lit(256), (F.bround(x / 64, 0) * 64).cast("int"))
    return F.struct(step(side * F.sqrt(a)).alias("width"), step(side / F.sqrt(a)).alias("height"))


def cache_key(model: Column, width: Column, height: Column, style: Column, prompt: Column) -> Column:
    """[X21] Name of a generated picture: 16 hex digits of SHA-256."""
    return F.substring(F.sha2(F.concat_ws("|", model, F.concat_ws("x", width.cast("string"), height.cast("string")), style, prompt).cast("binary"), 256), 1, 16)


def seed(text: Column) -> Column:
    """[X21] A seed from the first four bytes of SHA-256."""
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))


def rect_gap(a: Column, b: Column) -> Column:
    """[X30] Distance of two rectangles along the axis on which they are farther apart; 0 if they touch."""
    return F.greatest(F.lit(0.0), b["x0"] - a["x1"], a["x0"] - b["x1"], b["y0"] - a["y1"], a["y0"] - b["y1"])


def plain_number(value: Column) -> Column:
    """[X23] Thousands apart by a blank, at most two decimals."""
    return F.regexp_replace(F.regexp_replace(F.replace(F.format_number(value, 2), F.lit(","), F.lit(" ")), r"(\.\d*?)0+$", "$1"), r"\.$", "")
