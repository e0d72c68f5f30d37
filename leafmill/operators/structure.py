"""Structure of documents: running headers, headings, chapters, clean-up and selection.

Tables carry explicit ordinals. Windows are by document (or page), so work grows with a document and
not with the table; per-document facts are found by partial aggregation and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill import constants as C
from leafmill.functions import text as T


def masked(text: Column) -> Column:
    """Digits as ``#``, so that page numbers agree."""
    return F.regexp_replace(text, r"\d+", "#")


def remove_running_headers(lines: DataFrame, share: float = 0.3) -> DataFrame:
    """[A5] Lines without those that repeat at the edges of pages.

    ``lines``: (doc_id, page, line_no, text, ...). Edges are the first two and last two lines of a page; a
    masked text on at least max(3, ``share``) of the pages goes from the edges. Documents of fewer than
    four pages stay whole.
    """
    up = Window.partitionBy("doc_id", "page").orderBy("line_no")
    down = Window.partitionBy("doc_id", "page").orderBy(F.desc("line_no"))
    marked = lines.withColumn("__edge", (F.row_number().over(up) <= 2) | (F.row_number().over(down) <= 2)).withColumn("__mask", masked(F.col("text")))
    pages = lines.groupBy("doc_id").agg(F.countDistinct("page").alias("__pages")).where("__pages >= 4")
    edges = marked.where("__edge").select("doc_id", "page", "__mask").distinct().groupBy("doc_id", "__mask").agg(F.count("*").alias("__n"))
    repeated = edges.join(pages, "doc_id").where(F.col("__n") >= F.greatest(F.lit(3.0), F.col("__pages") * share)).select("doc_id", "__mask", F.lit(True).alias("__edge"))
    return marked.join(repeated, ["doc_id", "__mask", "__edge"], "left_anti").select(*lines.columns)


def body_size(lines: DataFrame) -> DataFrame:
    """[A6] (doc_id, body): the font size that most characters have; of equals the first seen."""
    sizes = lines.groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("w"), F.min(F.struct("page", "line_no")).alias("first"))
    best = sizes.withColumn("at", F.struct(-F.col("w"), F.col("first")))
    return best.groupBy("doc_id").agg(F.min_by("size", "at").alias("body"))


def heading_level(levels: DataFrame, kind: str) -> DataFrame:
    """[A7] (doc_id, level) of chapters from (doc_id, level), a row a heading.

    ``outline``: the top level, or the next one used if the top one occurs once (Markdown, tables of
    contents). ``repeated``: the smallest level used twice, else the smallest.
    """
    counts = levels.groupBy("doc_id", "level").agg(F.count("*").alias("n"))
    listed = counts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("level", "n"))).alias("l"))
    if kind == "outline":
        level = F.when((F.col("l")[0]["n"] == 1) & (F.size("l") > 1), F.get("l", F.lit(1))["level"]).otherwise(F.col("l")[0]["level"])
    else:
        level = F.coalesce(F.get(F.filter("l", lambda x: x["n"] >= 2), F.lit(0))["level"], F.col("l")[0]["level"])
    return listed.select("doc_id", level.alias("level"))


def heading_candidates(lines: DataFrame) -> DataFrame:
    """[W3, first half] Lines with body, candidate and head: large headings, or chapter lines that stand out."""
    with_body = lines.join(body_size(lines), "doc_id")
    chapter = T.is_chapter_line(F.col("text"))
    large = (F.col("size") >= F.col("body") * 1.25) & T.looks_like_heading(F.col("text")) & (F.length("text") > 1)
    candidate = large | (chapter & (F.col("bold") | (F.col("size") > F.col("body"))) & F.col("block_start"))
    rounded = F.bround("size", 0).cast("int")
    marked = with_body.withColumn("candidate", candidate).withColumn("rounded", rounded)
    counts = marked.where("candidate").groupBy("doc_id", "rounded").agg(F.count("*").alias("n"))
    limit = counts.groupBy("doc_id").agg(F.coalesce(F.max(F.when(F.col("n") >= 2, F.col("rounded"))), F.min("rounded")).alias("threshold"))
    return marked.join(limit, "doc_id", "left").withColumn("head", F.col("candidate") & ((F.col("rounded") >= F.col("threshold")) | chapter)).drop("rounded")


def chapters_from_fonts(lines: DataFrame) -> DataFrame:
    """[W3] (doc_id, start, title): chapter starts by font, start counting the document's lines from 0.

    Up to three styled lines of a page that follow one another are one heading, joined by a blank behind
    ``.`` or ``:`` and by a dash otherwise. The merge is a fold over the lines near headings.
    """
    order = Window.partitionBy("doc_id").orderBy("page", "line_no")
    marked = heading_candidates(lines).withColumn("i", F.row_number().over(order) - 1)
    styled = (F.col("size") >= F.col("body") * 1.15) | (F.col("bold") & (F.col("size") >= F.col("body")))
    marked = marked.withColumn("joins", F.col("head") | (styled & T.looks_like_heading(F.col("text")))).where("joins")
    rows = marked.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "page", "text", "head"))).alias("rows"))
    kind = "array<struct<i:int,page:bigint,parts:array<string>,last:int>>"
    start = F.array().cast(kind)

    def step(out: Column, x: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        follows = F.coalesce((last["last"] == x["i"] - 1) & (last["page"] == x["page"]) & (F.size(last["parts"]) < 3), F.lit(False))
        grown = F.struct(last["i"].alias("i"), last["page"].alias("page"), F.concat(last["parts"], F.array(x["text"])).alias("parts"), x["i"].alias("last"))
        fresh = F.struct(x["i"].alias("i"), x["page"].cast("bigint").alias("page"), F.array(x["text"]).alias("parts"), x["i"].alias("last"))
        return F.when(follows, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(grown))).when(x["head"], F.concat(out, F.array(fresh))).otherwise(out)

    found = rows.select("doc_id", F.explode(F.aggregate("rows", start, step)).alias("h"))
    separator = F.when(F.col("h.parts")[0].rlike(r"[.:]$"), " ").otherwise(" – ")
    return found.select("doc_id", F.col("h.i").alias("start"), F.when(separator == " ", F.array_join("h.parts", " ")).otherwise(F.array_join("h.parts", " – ")).alias("title"))


def chapters_from_outline(outline: DataFrame, lines: DataFrame) -> DataFrame:
    """[J4, O3] (doc_id, start, title, ord): outline entries of the chapter level at their lines.

    ``outline``: (doc_id, ord, level, title, page), pages from 1; ``lines``: (doc_id, i, page, text), pages
    from 0. A start is the first line on or after the page; or, on the page, the first line whose squashed
    text begins the title or the other way round. An as-of join as an equi-join on the document with the
    page condition, then a minimum.
    """
    pages = lines.groupBy("doc_id").agg(F.max("page").alias("last_page"), F.count("*").alias("n"))
    chosen = outline.where("page >= 1").join(heading_level(outline.where("page >= 1").select("doc_id", "level"), "outline"), ["doc_id", "level"])
    chosen = chosen.select("doc_id", "ord", F.trim("title").alias("title"), (F.col("page") - 1).alias("p")).join(pages, "doc_id").where("p between 0 and last_page")
    squashed = lines.select("doc_id", "i", "page", T.squash(F.col("text")).alias("sq"))
    firsts = squashed.groupBy("doc_id", "page").agg(F.min("i").alias("i"))
    after = chosen.join(firsts, "doc_id").where("page >= p").groupBy("doc_id", "ord").agg(F.min("i").alias("first"))
    target = T.squash(F.col("title"))
    named = chosen.withColumn("target", target).join(squashed, (chosen.doc_id == squashed.doc_id) & (chosen.p == squashed.page)).where("sq <> '' and (startswith(target, sq) or startswith(sq, target))")
    exact = named.groupBy(chosen.doc_id, "ord").agg(F.min("i").alias("exact"))
    out = chosen.join(after, ["doc_id", "ord"], "left").join(exact, ["doc_id", "ord"], "left")
    return out.select("doc_id", F.coalesce("exact", "first", "n").cast("int").alias("start"), "title", "ord")


def chapter_slices(starts: DataFrame, lines: DataFrame) -> DataFrame:
    """[W4] (doc_id, chapter_no, title, i, ...): the lines of each chapter, chapter 0 being those before the first start."""
    order = Window.partitionBy("doc_id").orderBy("start", "ord")
    ranges = starts.withColumn("chapter_no", F.row_number().over(order)).withColumn("stop", F.lead("start").over(order)).withColumnRenamed("doc_id", "d")
    inside = (F.col("d") == lines.doc_id) & (lines.i >= F.col("start")) & (F.col("stop").isNull() | (lines.i < F.col("stop")))
    joined = lines.join(ranges, inside, "left")
    return joined.select(lines.doc_id, F.coalesce("chapter_no", F.lit(0)).alias("chapter_no"), F.coalesce("title", F.lit("")).alias("title"), *[c for c in lines.columns if c != "doc_id"])


def is_contents(title: Column, paras: Column) -> Column:
    """A chapter that is a table of contents: by title, or by lines that end in page numbers."""
    like = F.size(F.filter(paras, lambda p: (F.length(p) < 100) & p.rlike(r"(\.{3,}|\s)\d{1,4}\s*$")))
    return T.is_contents_title(title) | ((F.size(paras) >= 5) & (like / F.greatest(F.lit(1), F.size(paras)) > 0.6))


def strip_licence(paras: DataFrame) -> DataFrame:
    """[F8] Paragraphs between a public-domain library's start and end markers.

    ``paras``: (doc_id, chapter_no, title, para_no, text). Without markers only chapters titled so go; a
    start marker that is the very first paragraph stays.
    """
    order = Window.partitionBy("doc_id").orderBy("chapter_no", "para_no")
    marks = paras.withColumn("__k", F.row_number().over(order) - 1)
    rule = lambda word: F.col("text").rlike(rf"(?i)^\*{{3}}\s*{word} OF (THE|THIS) PROJECT GUTENBERG")
    whole = Window.partitionBy("doc_id")
    marks = marks.withColumn("__s", F.min(F.when(rule("START"), F.col("__k"))).over(whole)).withColumn("__e", F.min(F.when(rule("END"), F.col("__k"))).over(whole))
    after = F.when(F.coalesce("__s", F.lit(0)) == 0, F.lit(-1)).otherwise(F.col("__s"))
    inside = F.col("__s").isNull() & F.col("__e").isNull() | (F.col("__k") > after) & (F.col("__e").isNull() | (F.col("__k") < F.col("__e")))
    return marks.where(inside & ~F.col("title").rlike("(?i)project gutenberg")).select(*paras.columns)


def postprocess(chapters: DataFrame) -> DataFrame:
    """[F9, W2, P15] Chapters cleaned, numbered and with tiny front matter merged.

    ``chapters``: (doc_id, number, title, paragraphs, doc_title, stem). Blank paragraphs go; so do leading
    ones that repeat the title, empty chapters and tables of contents. Two or more leading chapters of under
    60 words are one, if a longer one follows; a chapter titled like the file takes the document's title.
    """
    paras = F.array_remove(F.transform("paragraphs", T.strip), "")
    clean = chapters.withColumn("title", T.strip(F.regexp_replace("title", r"(?U)\s+", " "))).withColumn("paragraphs", paras)
    key = T.squash(F.col("title"))
    repeats = lambda p: (F.length(p) < C.TITLE_PREFIX) & F.contains(F.col("__key"), T.squash(p))
    keep_from = F.coalesce(F.array_min(F.filter(F.transform("paragraphs", lambda p, i: F.when(~repeats(p), i)), lambda i: i.isNotNull())), F.size("paragraphs"))
    clean = clean.withColumn("__key", F.when(F.col("title") == "", T.squash(F.lit("Chapter 1"))).otherwise(key))
    clean = clean.withColumn("paragraphs", _from(keep_from))
    kept = clean.where((F.size("paragraphs") > 0) & ~is_contents(F.col("title"), F.col("paragraphs"))).drop("__key")
    order = Window.partitionBy("doc_id").orderBy("number")
    kept = kept.withColumn("number", F.row_number().over(order))
    kept = kept.withColumn("title", F.when(F.col("title") == "", F.concat(F.lit("Chapter "), F.col("number").cast("string"))).otherwise(F.col("title")))
    return merge_tiny(kept)


def _from(first: Column) -> Column:
    return T.let(first, lambda k: F.filter("paragraphs", lambda p, i: i >= k))


def merge_tiny(chapters: DataFrame) -> DataFrame:
    """[P15] Leading chapters of under 60 words as one; numbers from 1."""
    words = F.aggregate("paragraphs", F.lit(0), lambda a, p: a + T.word_count(p))
    whole = Window.partitionBy("doc_id")
    marked = chapters.withColumn("__first", F.min(F.when(words >= C.TINY_WORDS, F.col("number"))).over(whole))
    merges = F.col("__first").isNotNull() & (F.col("__first") >= 3) & (F.col("number") < F.col("__first"))
    grouped = marked.groupBy("doc_id", F.when(merges, 1).otherwise(F.col("number")).alias("__group")).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("number", "paragraphs"))), lambda x: x["paragraphs"])).alias("paragraphs"),
        F.min_by("title", "number").alias("title"), F.first("doc_title").alias("doc_title"), F.first("stem").alias("stem"),
    )
    named = F.when((F.col("title") == F.col("stem")) & (F.col("doc_title") != F.col("stem")), F.col("doc_title")).otherwise(F.col("title"))
    order = Window.partitionBy("doc_id").orderBy("__group")
    return grouped.select("doc_id", F.row_number().over(order).alias("number"), named.alias("title"), "paragraphs", "doc_title", "stem")


def merge_subtitles(lines: DataFrame) -> DataFrame:
    """[P17, X26] A short chapter line takes the short title below it; the title's own line becomes blank.

    ``lines``: (doc_id, line_no, text). The title is the next line that is not blank, at most three lines
    down, in title case, 80 characters at most, no chapter line, and followed by a blank line or the end.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    row = lines.withColumn("__i", F.row_number().over(order)).withColumn("__t", T.strip(F.col("text"))).withColumn("__next", F.lead(T.strip(F.col("text"))).over(order))
    following = F.first(F.when(F.col("__t") != "", F.struct("__i", "__t", "__next")), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    row = row.withColumn("__f", following)
    takes = (
        T.is_chapter_line(F.col("text")) & (F.length("__t") <= 20) & F.col("__f").isNotNull() & (F.col("__f.__i") - F.col("__i") <= 3)
        & (F.coalesce("__f.__next", F.lit("")) == "") & (F.length("__f.__t") <= 80) & ~T.is_chapter_line(F.col("__f.__t")) & T.is_title_case(F.col("__f.__t"))
    )
    row = row.withColumn("__takes", F.coalesce(takes, F.lit(False)))
    before = F.last(F.when(F.col("__t") != "", F.struct("__takes", "__f")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    given = F.coalesce(before["__takes"] & (before["__f"]["__i"] == F.col("__i")), F.lit(False))
    text = F.when(F.col("__takes"), F.concat("__t", F.lit(" "), F.col("__f.__t"))).when(given, "").otherwise(F.col("text"))
    return row.withColumn("text", text).select(*lines.columns)


def text_chapters(lines: DataFrame) -> DataFrame:
    """[S2] (doc_id, number, title, doc_title, paragraphs, stem) of plain-text and Markdown files.

    ``lines``: (doc_id, line_no, text, stem, markdown). Fenced code goes. Headings of the chapter level begin
    chapters, higher ones name the document, lower ones are paragraphs of their own; without headings
    chapter lines of under 90 characters do. Rules and inline marks go in Markdown files only.
    """
    from leafmill.operators import segmentation

    facts = lines.select("doc_id", "stem", "markdown").distinct()
    rows = merge_subtitles(lines.select("doc_id", "line_no", "text"))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    fence = T.strip(F.col("text")).startswith("```")
    rows = rows.withColumn("__fence", fence)
    level = F.length(F.regexp_extract("text", r"^(#{1,6})\s+(.+?)\s*#*\s*$", 1))
    rows = rows.withColumn("level", level)  # headings inside fences count in the histogram
    chapter = heading_level(rows.where("level > 0").select("doc_id", "level"), "outline").withColumnRenamed("level", "chapter_level")
    rows = rows.withColumn("__code", F.sum(F.col("__fence").cast("int")).over(order) % 2 == 1).where("not __fence and not __code")
    rows = rows.join(chapter, "doc_id", "left").join(facts, "doc_id", "left")
    heading = T.strip_markdown(F.regexp_extract("text", r"^(#{1,6})\s+(.+?)\s*#*\s*$", 2))
    stripped = T.strip(F.col("text"))
    begins = F.when(F.col("level") > 0, F.col("level") == F.col("chapter_level")).otherwise(F.col("chapter_level").isNull() & T.is_chapter_line(F.col("text")) & (F.length(stripped) < 90))
    names = (F.col("level") > 0) & (F.col("level") < F.col("chapter_level"))
    rule = F.col("markdown") & F.col("text").rlike(r"^\s*([-*_]\s*){3,}$")
    body = F.when((F.col("level") > 0), F.concat(F.lit("\n"), heading, F.lit("\n"))).when(rule, "").when(F.col("markdown"), T.strip_markdown(F.col("text"))).otherwise(F.col("text"))
    rows = rows.withColumn("__begins", F.coalesce(begins, F.lit(False))).withColumn("__names", F.coalesce(names, F.lit(False)))
    rows = rows.withColumn("__title", F.when(F.col("__begins"), F.when(F.col("level") > 0, heading).otherwise(stripped)).when(F.col("__names"), heading))
    rows = rows.withColumn("__c", F.sum(F.col("__begins").cast("int")).over(order)).withColumn("__body", F.when(~F.col("__begins") & ~F.col("__names"), body))
    doc = rows.groupBy("doc_id").agg(F.max_by(F.when(F.col("__names"), F.col("__title")), F.when(F.col("__names"), F.col("line_no"))).alias("named"), F.min(F.when(~F.col("__names"), F.col("line_no"))).alias("__text_at"))
    opening = rows.join(doc, "doc_id").where(F.col("__names") & (F.col("__text_at").isNull() | (F.col("line_no") < F.col("__text_at")))).groupBy("doc_id").agg(F.max_by("__title", "line_no").alias("opening"))
    grouped = rows.groupBy("doc_id", "__c").agg(
        F.max(F.when(F.col("__begins"), F.col("__title"))).alias("title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("__body").isNotNull(), F.struct("line_no", "__body")))), lambda x: x["__body"]), "\n").alias("body"),
    )
    name = F.regexp_replace("stem", "_", " ")
    out = grouped.join(doc, "doc_id").join(opening, "doc_id", "left").join(facts.select("doc_id", "stem"), "doc_id")
    out = out.withColumn("paragraphs", segmentation.document_paragraphs(F.col("body"), False))
    out = out.where((F.col("__c") > 0) | (F.size("paragraphs") > 0))
    title = F.when(F.col("__c") > 0, F.col("title")).otherwise(F.coalesce("opening", name))
    numbers = Window.partitionBy("doc_id").orderBy("__c")
    return out.select("doc_id", F.row_number().over(numbers).alias("number"), title.alias("title"), "paragraphs", F.coalesce("named", name).alias("doc_title"), "stem")


def select_chapters(chapters: DataFrame, numbers: DataFrame) -> DataFrame:
    """[F1, U5] Chapters whose (doc_id, number) is wanted; numbers stay as they are."""
    return chapters.join(numbers.select("doc_id", "number").distinct(), ["doc_id", "number"], "left_semi")


def chapter_selection(spec: Column, count: Column) -> Column:
    """``1,3-5`` as distinct numbers from 0, in order of mention; raises where one is out of range or reversed."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")

    def numbers(p: Column) -> Column:
        low = F.trim(F.split(p, "-")[0]).cast("int")
        high = F.when(F.contains(p, F.lit("-")), F.trim(F.get(F.split(p, "-"), 1)).cast("int")).otherwise(low)
        wrong = F.raise_error(F.concat(F.lit("chapters: "), p)).cast("array<int>")
        return F.when((low >= 1) & (low <= high) & (high <= count), F.sequence(low - 1, high - 1)).otherwise(wrong)

    return F.array_distinct(F.flatten(F.transform(parts, numbers)))


def reused_sections(sections: DataFrame, chapters: DataFrame) -> DataFrame:
    """Script sections of selected chapters: by number, or by title where the number is 0."""
    numbered = sections.where("number <> 0").join(chapters.select("doc_id", "number"), ["doc_id", "number"], "left_semi")
    titled = sections.where("number = 0").join(chapters.select("doc_id", F.col("title").alias("chapter_title")), ["doc_id", "chapter_title"], "left_semi")
    return numbered.unionByName(titled)


def chapters_of_sections(sections: DataFrame, chapters: DataFrame) -> DataFrame:
    """[J5] (doc_id, section_no, chapter): the first chapter of a section's number, or of its title if that is 0."""
    by_number = sections.where("number <> 0").join(chapters.select("doc_id", "number", F.col("number").alias("chapter")), ["doc_id", "number"], "left")
    titles = chapters.groupBy("doc_id", F.col("title").alias("chapter_title")).agg(F.min("number").alias("chapter"))
    by_title = sections.where("number = 0").join(titles, ["doc_id", "chapter_title"], "left")
    return by_number.select("doc_id", "section_no", "chapter").unionByName(by_title.select("doc_id", "section_no", "chapter"))


def numbered_chapters(chapters: DataFrame) -> DataFrame:
    """[W2] Unnumbered chapters (0) take their position; chapter_count is the most of count and numbers."""
    order = Window.partitionBy("doc_id").orderBy("position")
    whole = Window.partitionBy("doc_id")
    number = F.coalesce(F.nullif("number", F.lit(0)), F.row_number().over(order))
    out = chapters.withColumn("number", number)
    return out.withColumn("chapter_count", F.greatest(F.count("*").over(whole), F.max("number").over(whole)))
