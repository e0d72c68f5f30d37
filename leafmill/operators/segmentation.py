"""Paragraphs, chunks, timed parts, scenes and cues of a text, as column expressions.

Every one is a fold over arrays of its own row, so none needs a shuffle; states carry references to
strings, not copies. Order is that of the arrays, and explicit ordinals go with what is exploded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill import constants as C
from leafmill.functions import text as T

CHUNK = "array<struct<text:string,ends_paragraph:boolean>>"
UNIT = "array<struct<text:string,whole:boolean,first:boolean>>"


def _strings() -> Column:
    return F.array().cast("array<string>")


def paragraphs(lines: Column, compose: bool = False) -> Column:
    """[P1] Paragraphs from visually wrapped lines.

    A blank line ends one; so does a line that ends like a sentence and is shorter than three quarters
    of the typical line, the one at 0.8 of the lengths in order. A hyphen at a line's end is glued to
    a lower-case start; page numbers are left out.
    """
    clean = F.transform(lines, lambda x: T.rstrip(T.normalize(x, compose)))

    def fold(rows: Column) -> Column:
        lengths = F.array_sort(F.transform(F.filter(rows, lambda x: x != ""), F.length))
        typical = F.coalesce(F.get(lengths, F.floor(F.size(lengths) * F.lit(0.8)).cast("int")), F.lit(0))

        def step(s: Column, raw: Column) -> Column:
            def of(line: Column) -> Column:
                glued = F.concat(F.substring(s["cur"], 1, F.length(s["cur"]) - 1), line)
                plain = F.when(s["cur"] == "", line).otherwise(F.concat(s["cur"], F.lit(" "), line))
                joined = F.when(s["cur"].endswith("-") & line.rlike(r"^\p{Ll}"), glued).otherwise(plain)
                ends = (typical > 0) & F.substring(line, -1, 1).isin(*'.!?:…"”') & (F.length(line) < typical * F.lit(0.75))
                keep = F.struct(s["out"].alias("out"), joined.alias("cur"))
                flush = lambda cur: F.struct(F.concat(s["out"], F.array(cur)).alias("out"), F.lit("").alias("cur"))
                return F.when(line == "", flush(s["cur"])).when(T.is_page_number(line), s).when(ends, flush(joined)).otherwise(keep)

            return T.let(T.strip(raw), of)

        start = F.struct(_strings().alias("out"), F.lit("").alias("cur"))
        return F.aggregate(rows, start, step, lambda s: F.concat(s["out"], F.array(s["cur"])))

    return F.array_remove(F.transform(T.let(clean, fold), lambda p: T.clean_paragraph(p, compose)), "")


def document_paragraphs(text: Column, compose: bool = False) -> Column:
    """Paragraphs of a plain text."""
    return paragraphs(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), compose)


def greedy_wrap(words: Column, most: Column | int) -> Column:
    """[P5] Words packed into lines of at most ``most`` characters; a longer word stands alone."""
    most = F.lit(most) if isinstance(most, int) else most
    start = F.struct(_strings().alias("out"), F.lit("").alias("cur"))

    def step(s: Column, word: Column) -> Column:
        full = (s["cur"] != "") & (F.length(s["cur"]) + F.length(word) + 1 > most)
        more = F.when(s["cur"] == "", word).otherwise(F.concat(s["cur"], F.lit(" "), word))
        return F.when(full, F.struct(F.concat(s["out"], F.array(s["cur"])).alias("out"), word.alias("cur"))).otherwise(F.struct(s["out"].alias("out"), more.alias("cur")))

    return F.aggregate(words, start, step, lambda s: F.when(s["cur"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["cur"]))))


def units(paras: Column, most: int) -> Column:
    """Paragraphs that fit whole, and of longer ones the sentences, wrapped where they are too long."""
    whole = lambda p: F.array(F.struct(p.alias("text"), F.lit(True).alias("whole"), F.lit(True).alias("first")))
    wrapped = lambda s: F.when(F.length(s) <= most, F.array(s)).otherwise(greedy_wrap(F.split(s, " "), most))
    parts = lambda p: F.transform(F.flatten(F.transform(T.sentences(p), wrapped)), lambda x, i: F.struct(x.alias("text"), F.lit(False).alias("whole"), (i == 0).alias("first")))
    each = lambda p: F.when(F.length(p) <= most, whole(p)).otherwise(parts(p))
    return F.flatten(F.transform(F.array_remove(F.transform(paras, T.strip), ""), each))


def chunks(paras: Column, most: int = 1500) -> Column:
    """[P4] Paragraphs packed into chunks of at most ``most`` characters, cut at their ends or else between sentences."""
    start = F.struct(F.array().cast(CHUNK).alias("out"), F.lit("").alias("buf"))

    def add(s: Column, ends: bool) -> Column:
        made = F.struct(T.strip(s["buf"]).alias("text"), F.lit(ends).alias("ends_paragraph"))
        return F.when(s["buf"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(made)))

    def step(s: Column, u: Column) -> Column:
        fits = F.length(s["buf"]) + F.length(u["text"]) + 1 <= most
        state = lambda out, buf: F.struct(out.alias("out"), buf.alias("buf"))
        joined = lambda by: F.when(s["buf"] == "", u["text"]).otherwise(F.concat(s["buf"], F.lit(by), u["text"]))
        return (
            F.when(u["whole"] & fits, state(s["out"], joined("\n")))
            .when(u["whole"] | u["first"], state(add(s, True), u["text"]))
            .when((s["buf"] != "") & ~fits, state(add(s, False), u["text"]))
            .otherwise(state(s["out"], joined(" ")))
        )

    return F.aggregate(units(paras, most), start, step, lambda s: add(s, True))


def chapter_chunks(title: Column, paras: Column, most: int) -> Column:
    """[P6] The title, as a sentence, and the chunks of the chapter."""
    spoken = F.concat(F.regexp_replace(title, r"[.:!?]+$", ""), F.lit("."))
    return F.concat(F.array(F.struct(spoken.alias("text"), F.lit(True).alias("ends_paragraph"))), chunks(paras, most))


def segments(paras: Column, most: int = C.SEGMENT_CHARS) -> Column:
    """[P7] Chunk texts for a model's context; an empty chapter is one empty segment."""
    found = F.transform(chunks(paras, most), lambda c: c["text"])
    return T.let(found, lambda s: F.when(F.size(s) == 0, F.array(F.lit(""))).otherwise(s))


def plan_parts(durations: Column, ends: Column, most: Column | float) -> Column:
    """[W1] Part number (from 0) of each duration, in parts of at most ``most`` seconds of nearly equal length.

    The aim is the rest divided by the parts it needs. A part ends before an item that would exceed
    the limit, or that would overshoot the aim by more than stopping undershoots it; at a paragraph's
    end the overshoot counts twice.
    """
    most = F.lit(float(most)) if isinstance(most, int | float) else most
    aim = lambda rest: F.when(rest > most, rest / F.ceil(rest / most)).otherwise(rest)
    total = F.aggregate(durations, F.lit(0.0), lambda a, d: a + d)
    items = F.zip_with(durations, ends, lambda d, e: F.struct(d.alias("d"), e.alias("e")))

    def plan(sum_: Column) -> Column:
        start = F.struct(
            F.array().cast("array<int>").alias("out"), sum_.alias("rest"), aim(sum_).alias("target"), F.lit(0.0).alias("elapsed"),
            F.lit(0).alias("part"), F.lit(True).alias("empty"), F.lit(False).alias("ended"),
        )

        def step(s: Column, x: Column) -> Column:
            over, under = s["elapsed"] + x["d"] - s["target"], s["target"] - s["elapsed"]
            eager = F.when(s["ended"], 2.0).otherwise(1.0)
            cut = ~s["empty"] & (sum_ > most) & ((s["elapsed"] + x["d"] > most) | ((over > 0) & (under < eager * over)))
            rest = s["rest"] - s["elapsed"]
            state = lambda rest, target, elapsed, part: F.struct(
                F.concat(s["out"], F.array(part)).alias("out"), rest.alias("rest"), target.alias("target"), elapsed.alias("elapsed"),
                part.alias("part"), F.lit(False).alias("empty"), x["e"].alias("ended"),
            )
            return F.when(cut, state(rest, aim(rest), F.lit(0.0) + x["d"], s["part"] + 1)).otherwise(state(s["rest"], s["target"], s["elapsed"] + x["d"], s["part"]))

        return F.aggregate(items, start, step, lambda s: s["out"])

    return T.let(total, plan)


def subtitle_cues(text: Column) -> Column:
    """[P9] Sentences wrapped at 90 characters."""
    return F.flatten(F.transform(T.sentences(text), lambda s: greedy_wrap(T.tokens(s), C.SUBTITLE_CHARS)))


def scenes(title: Column, paras: Column) -> Column:
    """[P8] Slides of about 170 words: title, bullets (first sentences, shortened) and narration.

    Units are paragraphs of at most 170 words and the sentences of longer ones; a slide begins once
    the last one has 70 % of the words.
    """
    mark = lambda u, i: F.struct(u.alias("text"), (i == 0).alias("start"), T.word_count(u).alias("words"))
    split = lambda p: F.transform(F.when(T.word_count(p) <= C.SCENE_WORDS, F.array(p)).otherwise(T.sentences(p)), mark)
    kind = "array<struct<text:string,start:boolean,words:int>>"
    start = F.struct(F.array().cast(f"array<{kind}>").alias("out"), F.array().cast(kind).alias("cur"), F.lit(0).alias("n"))

    def step(s: Column, u: Column) -> Column:
        cut = (s["n"] >= C.SCENE_WORDS * 0.7) & (F.size(s["cur"]) > 0)
        fresh = F.struct(F.concat(s["out"], F.array(s["cur"])).alias("out"), F.array(u).alias("cur"), u["words"].alias("n"))
        return F.when(cut, fresh).otherwise(F.struct(s["out"].alias("out"), F.concat(s["cur"], F.array(u)).alias("cur"), (s["n"] + u["words"]).alias("n")))

    folded = F.aggregate(F.flatten(F.transform(paras, split)), start, step, lambda s: F.when(F.size(s["cur"]) > 0, F.concat(s["out"], F.array(s["cur"]))).otherwise(s["out"]))

    def build(slices: Column) -> Column:
        def scene(units_: Column, i: Column) -> Column:
            starts = F.transform(F.filter(units_, lambda u: u["start"]), lambda u: u["text"])
            starts = F.when(F.size(starts) > 0, starts).otherwise(F.array(units_[0]["text"]))
            bullets = F.transform(F.slice(starts, 1, C.MAX_BULLETS), lambda p: T.shorten(F.coalesce(F.get(T.sentences(p), 0), F.lit(""))))
            name = F.when(F.size(slices) == 1, title).otherwise(F.concat(title, F.lit(" ("), (i + 1).cast("string"), F.lit("/"), F.size(slices).cast("string"), F.lit(")")))
            return F.struct(name.alias("title"), F.array_remove(bullets, "").alias("bullets"), F.array_join(F.transform(units_, lambda u: u["text"]), " ").alias("narration"))

        return F.transform(slices, scene)

    return T.let(folded, build)
