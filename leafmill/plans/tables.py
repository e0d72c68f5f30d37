"""Queries of structure, selection and joins over the data tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill import constants as C
from leafmill.functions import answers, ports, text, timing
from leafmill.operators import calls, structure
from leafmill.operators.running import running_totals
from leafmill.plans import sql
from leafmill.plans.catalog import register
from leafmill.scratch import scratch_path, written
from leafmill.session import table
from leafmill.sources import markup


def _lines(spark, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents")
    return df.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("k", "line")).select("doc_id", "source", (F.col("k") + 1).alias("line_no"), "line")


@register(
    "running_headers",
    f"""WITH {sql.LINES}, l AS (SELECT source, doc_id AS page, line_no, line, regexp_replace(line, '[0-9]+', '#', 'g') AS mask,
  row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS up, row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) AS down FROM lines JOIN documents USING (doc_id)),
e AS (SELECT *, up <= 2 OR down <= 2 AS edge FROM l), p AS (SELECT source, count(DISTINCT page) AS pages FROM l GROUP BY source HAVING count(DISTINCT page) >= 4),
r AS (SELECT source, mask FROM (SELECT DISTINCT source, page, mask FROM e WHERE edge) JOIN p USING (source) GROUP BY source, mask, pages HAVING count(*) >= greatest(3, pages * 0.05))
SELECT source, CAST(count(*) AS BIGINT) AS kept, CAST(sum(length(line)) AS BIGINT) AS chars FROM e WHERE NOT (edge AND EXISTS (SELECT 1 FROM r WHERE r.source = e.source AND r.mask = e.mask)) GROUP BY source""",
)
def running_headers(spark, sf_dir: str) -> DataFrame:
    """[A5] A source as a book, its documents as pages; the share is lowered to 5 % so that lines do repeat here."""
    lines = _lines(spark, sf_dir).select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), "line_no", F.col("line").alias("text"))
    kept = structure.remove_running_headers(lines, 0.05)
    return kept.groupBy(F.col("doc_id").alias("source")).agg(F.count("*").alias("kept"), F.sum(F.length("text")).alias("chars"))


@register(
    "heading_lines",
    f"WITH {sql.LINES} SELECT doc_id, CAST(line_no AS INT) AS line_no, trim(line) AS heading FROM lines WHERE length(trim(line)) BETWEEN 1 AND 90 AND NOT regexp_matches(trim(line), '[.,;]$') "
    r"AND len(regexp_extract_all(line, '\S+')) <= 12",
)
def heading_lines(spark, sf_dir: str) -> DataFrame:
    """Lines that could be headings."""
    return _lines(spark, sf_dir).where(text.looks_like_heading(F.col("line"))).select("doc_id", "line_no", text.strip(F.col("line")).alias("heading"))


@register(
    "body_size",
    f"WITH {sql.LINES}, s AS (SELECT source, length(line) % 7 AS size, sum(length(line)) AS w, min(doc_id * 1000000 + line_no) AS first FROM lines JOIN documents USING (doc_id) GROUP BY 1, 2) "
    "SELECT source, CAST(arg_max(size, w * 1000000000000 - first) AS DOUBLE) AS body FROM s GROUP BY source",
)
def body_size(spark, sf_dir: str) -> DataFrame:
    """[A6] The size that most characters have; a line's length modulo 7 plays its font size."""
    lines = _lines(spark, sf_dir).select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), "line_no", F.col("line").alias("text"), (F.length("line") % 7).cast("double").alias("size"))
    return structure.body_size(lines).withColumnRenamed("doc_id", "source")


_CHAPTERS = "chapters AS (SELECT conv_id AS doc_id, CAST(turn AS INT) AS number, text FROM conversations)"


@register(
    "selected_summary",
    rf"WITH {_CHAPTERS}, w AS (SELECT doc_id, number, len(regexp_extract_all(coalesce(text, ''), '\S+')) AS words FROM chapters) SELECT doc_id, CAST(count(*) AS BIGINT) AS chapters, CAST(sum(words) AS BIGINT) AS words, "
    f"CAST(count(*) FILTER (WHERE number % 2 = 1) AS BIGINT) AS selected, CAST(coalesce(sum(words) FILTER (WHERE number % 2 = 1), 0) AS BIGINT) AS selected_words, {sql.duration('sum(words) / 175.0 * 60')} AS duration FROM w GROUP BY doc_id",
)
def selected_summary(spark, sf_dir: str) -> DataFrame:
    """[A3] A conversation as a document, its turns as chapters: all of them and the odd ones."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("number"), text.word_count(F.col("text")).cast("long").alias("words"))
    odd = F.col("number") % 2 == 1
    out = rows.groupBy("doc_id").agg(F.count("*").alias("chapters"), F.sum("words").alias("words"), F.count_if(odd).alias("selected"), F.coalesce(F.sum(F.when(odd, F.col("words"))), F.lit(0)).alias("selected_words"))
    return out.withColumn("duration", timing.format_duration(timing.estimate_seconds(F.col("words"))))


@register(
    "selected_chapters",
    f"WITH {_CHAPTERS} SELECT doc_id, number, text FROM chapters WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND number IN (1, 2, 5)",
)
def selected_chapters(spark, sf_dir: str) -> DataFrame:
    """[F1, U5] Chapters that a selection names; numbers are kept."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("number"), "text")
    wanted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(5))).alias("number"))
    return structure.select_chapters(rows, wanted)


@register(
    "merged_front_matter",
    rf"""WITH {_CHAPTERS}, w AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY number) AS n, trim(text) AS text, len(regexp_extract_all(text, '\S+')) AS words FROM chapters WHERE trim(coalesce(text, '')) <> ''),
f AS (SELECT *, min(n) FILTER (WHERE words >= 60) OVER (PARTITION BY doc_id) AS big FROM w),
g AS (SELECT *, CASE WHEN big >= 3 AND n < big THEN 1 ELSE n END AS g FROM f)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g) AS INT) AS number, CAST(count(*) AS BIGINT) AS paragraphs, CAST(sum(words) AS BIGINT) AS words FROM g GROUP BY doc_id, g""",
)
def merged_front_matter(spark, sf_dir: str) -> DataFrame:
    """[F9, P15, W2] Turns as chapters: cleaned, leading tiny ones merged, numbered."""
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    chapters = rows.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("number"), F.lit("Zzyzx").alias("title"), F.array("text").alias("paragraphs"), F.lit("d").alias("doc_title"), F.lit("s").alias("stem"))
    out = structure.postprocess(chapters)
    words = F.aggregate("paragraphs", F.lit(0).cast("long"), lambda a, p: a + text.word_count(p))
    return out.select("doc_id", "number", F.size("paragraphs").cast("long").alias("paragraphs"), words.alias("words"))


@register(
    "page_titles_safe",
    r"""WITH t AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages),
c AS (SELECT page_id, trim(regexp_replace(regexp_replace(title, '[\\/:*?"<>|\x00-\x1f]+', ' ', 'g'), '[ \t\x{00a0}]+', ' ', 'g'), ' .') AS t FROM t)
SELECT page_id, CASE WHEN t = '' THEN 'Untitled' WHEN length(t) > 80 THEN rtrim(regexp_replace(left(t, 80), ' [^ ]*$', ''), ' .,;-') ELSE t END AS filename FROM c""",
)
def page_titles_safe(spark, sf_dir: str) -> DataFrame:
    """[X7] Page titles as file names."""
    title = F.coalesce(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", text.safe_filename(title).alias("filename"))


@register("html_blocks")
def html_blocks(spark, sf_dir: str) -> DataFrame:
    """[P10, S5, X29] Blocks of every page in order."""
    return markup.html_blocks(table(spark, sf_dir, "pages"))


_ELEMENTS = r"""shown AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<(script|style|title|template)\b.*?</(script|style|title|template)>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS html FROM pages),
tags AS (SELECT page_id, list_filter(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1), lambda t: t <> 'head') AS t FROM shown),
elements AS (SELECT page_id, k - 1 AS ord, t[k] AS tag FROM (SELECT *, unnest(range(1, len(t) + 1)) AS k FROM tags))"""


@register(
    "anchor_blocks",
    f"WITH {_ELEMENTS} SELECT page_id, CAST(ord AS INT) AS ord, tag, CAST(min(CASE WHEN tag IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6', 'p', 'li', 'blockquote', 'pre', 'dt', 'dd', 'img') THEN ord END) "
    "OVER (PARTITION BY page_id ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS INT) AS block FROM elements",
)
def anchor_blocks(spark, sf_dir: str) -> DataFrame:
    """[J11] The block at or behind each element of every page, as if each were what a table of contents points at."""
    elements, _ = written(markup.html_elements(table(spark, sf_dir, "pages")), "elements")
    return markup.anchor_blocks(elements, elements.select("page_id", "ord", "tag"))


@register(
    "page_contents",
    r"""WITH n AS (SELECT page_id, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav FROM pages),
e AS (SELECT page_id, regexp_extract_all(nav, '<a href="([^"]*)">', 1) AS href, regexp_extract_all(nav, '<a href="[^"]*">([^<]*)</a>', 1) AS text FROM n)
SELECT page_id, CAST(k - 1 AS INT) AS entry, 0 AS depth, text[k] AS text, href[k] AS href FROM (SELECT *, unnest(range(1, len(href) + 1)) AS k FROM e)""",
)
def page_contents(spark, sf_dir: str) -> DataFrame:
    """[P12, S5] The contents that every page's navigation lists, with depth."""
    found = markup.contents(markup.html_elements(table(spark, sf_dir, "pages")))
    entry = F.row_number().over(Window.partitionBy("page_id").orderBy("ord")) - 1
    return found.select("page_id", entry.alias("entry"), "depth", "text", "href")


@register(
    "document_json",
    "SELECT conv_id AS doc_id, CAST(count(*) AS BIGINT) AS chapters, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations WHERE text IS NOT NULL GROUP BY conv_id",
)
def document_json(spark, sf_dir: str) -> DataFrame:
    """[K1, X31, P16] Documents written to JSON and read again; counted from what was read."""
    from leafmill.sources import files

    rows = table(spark, sf_dir, "conversations").where("text is not null")
    chapters = rows.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("number"), F.lit("t").alias("title"), F.array("text").alias("paragraphs"), F.lit("d").alias("doc_title"))
    read = files.document_json(chapters).select("doc_id", F.from_json("json", "title string, chapters array<struct<title:string,paragraphs:array<string>>>").alias("d"))
    chars = F.aggregate("d.chapters", F.lit(0).cast("long"), lambda a, c: a + F.length(c["paragraphs"][0]))
    return read.select("doc_id", F.size("d.chapters").cast("long").alias("chapters"), chars.alias("chars"))


@register(
    "audio_progress",
    "SELECT conv_id AS doc_id, CAST(turn AS INT) AS number, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS done, CAST(sum(length(text)) OVER (PARTITION BY conv_id) AS BIGINT) AS total FROM conversations",
)
def audio_progress(spark, sf_dir: str) -> DataFrame:
    """[W8, A12] Characters spoken so far, and in all; a running total over range partitions, so a conversation may be of any length."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("chars"))
    done = running_totals(turns, ["conv_id"], [F.col("turn").asc_nulls_first()], {"done": F.col("chars")})
    total = turns.groupBy("conv_id").agg(F.sum("chars").alias("total"))
    return done.join(total, "conv_id").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("number"), "done", "total")


_ANSWER = """'{"scenes": [{"title": "T' || CAST(turn AS STRING) || '", "bullets": ["a", "b"], "narration": "' || role || '"}, {"title": "U", "bullets": [' || CASE conv_id % 4 WHEN 1 THEN '1' ELSE '"c"' END || '], "narration": "said ' || CAST(length(text) AS STRING) || '"}' || CASE conv_id % 4 WHEN 2 THEN ', {"title": "V", "bullets": []}' ELSE '' END || ']}'"""


@register(
    "answer_verdicts",
    f"""WITH w AS (SELECT conv_id, turn, {_ANSWER} AS whole, length(text) % 250 AS stop FROM conversations), a AS (SELECT *, CASE turn % 4 WHEN 3 THEN replace(whole, '": [', '"; [') ELSE substring(whole, 1, CAST(stop AS INT)) END AS answer FROM w),
v AS (SELECT *, CASE WHEN turn % 4 = 3 THEN 'malformed' WHEN json_valid(answer) THEN 'whole' ELSE 'cut' END AS verdict FROM a)
SELECT conv_id, turn, verdict, CASE WHEN verdict = 'whole' AND conv_id % 4 = 1 THEN '$.scenes[1].bullets[0]' WHEN verdict = 'whole' AND conv_id % 4 = 2 THEN '$.scenes[2].narration' END AS fault,
  CASE WHEN verdict = 'malformed' THEN 0 ELSE len(regexp_extract_all(answer, '"narration": "[^"]*"}}')) END AS kept FROM v""",
)
def answer_verdicts(spark, sf_dir: str) -> DataFrame:
    """[H11, P14, B2] Answers made of every turn, cut at all lengths or broken: the verdict, the field at fault, and the scenes that can be kept."""
    turns = table(spark, sf_dir, "conversations").withColumns({"whole": F.expr(_ANSWER), "stop": (F.length("text") % 250).cast("int")})
    answer = F.when(F.col("turn") % 4 == 3, F.replace("whole", F.lit('": ['), F.lit('"; ['))).otherwise(F.substring("whole", F.lit(1), F.col("stop")))
    found = turns.select("conv_id", "turn", answer.alias("answer")).withColumn("j", answers.judged(answers.SCENES)(F.col("answer")))
    scenes = F.from_json(answers.mended(F.col("answer")), "scenes array<struct<title:string,narration:string>>")["scenes"]
    kept = F.when(F.col("j.verdict") == "malformed", 0).otherwise(F.coalesce(F.size(F.filter(scenes, lambda s: s["narration"].isNotNull())), F.lit(0)))
    return found.select("conv_id", "turn", "j.verdict", "j.fault", kept.cast("long").alias("kept"))


@register("cached_speech", r"SELECT conv_id, turn, greatest(0.5, len(regexp_extract_all(text, '\S+')) / 2.5) AS seconds FROM conversations")
def cached_speech(spark, sf_dir: str) -> DataFrame:
    """[B5, B3, D1] Seconds of speech of every turn, from a speech engine that is called once for each distinct text, a few at a time."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    spoken, _ = calls.cached_calls(turns, "text", lambda text: repr(ports.silent_speech(text)), scratch_path(spark, "speech"))
    return spoken.select("conv_id", "turn", F.col("result").cast("double").alias("seconds"))


@register(
    "parts_estimate",
    rf"SELECT doc_id, CAST(greatest(1, ceil(len(regexp_extract_all(text, '\S+')) / 175.0 * 60 / greatest(30, 10 * 60 - {C.SPLIT_MARGIN}))) AS INT) AS parts, "
    rf"CAST(least(900, greatest(200, greatest(30, 10 * 60 - {C.SPLIT_MARGIN}) * 15 / 4)) AS INT) AS chunk_chars FROM documents",
)
def parts_estimate(spark, sf_dir: str) -> DataFrame:
    """[A2, X11, X12, X13] How many parts of ten minutes a document gives, and how long its chunks may be."""
    limit = timing.split_limit(F.lit(10.0))
    seconds = timing.estimate_seconds(text.word_count(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.greatest(F.lit(1), F.ceil(seconds / limit)).cast("int").alias("parts"), timing.chunk_chars(limit).alias("chunk_chars"))


@register(
    "image_dedupe",
    "WITH i AS (SELECT source, doc_id, sha256(text) AS sha, n_chars % 400 AS width FROM documents) SELECT source, sha AS sha256, min(doc_id) AS position, '03-' || left(sha, 8) || '.png' AS file FROM i WHERE width >= 200 GROUP BY source, sha",
)
def image_dedupe(spark, sf_dir: str) -> DataFrame:
    """[A9, F16, K5] The first of equal images; a document's text plays an image's bytes, its length the width."""
    from leafmill.operators import figures

    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.lit(3).alias("chapter"), F.col("doc_id").alias("position"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), (F.col("n_chars") % 400).alias("width"), F.lit(300).alias("height"))
    return figures.distinct_images(rows).select(F.col("doc_id").alias("source"), "sha256", "position", "file")


@register(
    "limited_illustrations",
    """WITH s AS (SELECT conv_id AS doc_id, turn AS scene_no, CASE WHEN length(text) % 5 = 0 THEN NULL WHEN length(text) % 2 = 0 THEN 'picture' ELSE 'diagram' END AS kind FROM conversations),
n AS (SELECT *, count(*) OVER w AS n, count(kind) OVER w AS shown, min(scene_no) OVER w AS first FROM s WINDOW w AS (PARTITION BY doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind IS NULL ORDER BY scene_no <> first OR n = 1, kind = 'diagram', scene_no DESC) AS k FROM n)
SELECT doc_id, scene_no, kind, kind IS NOT NULL AND k > shown - greatest(1, ceil(n * 0.6)) AS kept FROM r""",
)
def limited_illustrations(spark, sf_dir: str) -> DataFrame:
    """[W9] At most 60 % of a conversation's turns stay illustrated."""
    from leafmill.operators import figures

    n = F.length("text")
    kind = F.when(n % 5 == 0, None).when(n % 2 == 0, "picture").otherwise("diagram")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit(1).alias("section_no"), F.col("turn").alias("scene_no"), kind.alias("kind"))
    return figures.limit_illustrations(rows).drop("section_no")


def _conversation_chapters(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    title = F.concat(F.lit("Turn "), F.col("turn").cast("string"))
    return rows.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("number"), title.alias("title"), F.array(text.strip(F.col("text"))).alias("paragraphs"), F.concat(F.lit("Talk "), F.col("conv_id").cast("string")).alias("doc_title"))


@register("audiobook_plan")
def audiobook_plan(spark, sf_dir: str) -> DataFrame:
    """[K11] Audio files of every conversation, its turns as chapters, in parts of half a minute."""
    from leafmill.operators import pipelines

    out = pipelines.audiobook_plan(_conversation_chapters(spark, sf_dir), 0.5)
    return out.withColumn("seconds", F.round("seconds", 4))


@register(
    "script_summary",
    r"SELECT conv_id AS doc_id, CAST(turn AS INT) AS number, CAST(1 AS BIGINT) AS scenes, CAST(CASE WHEN role = 'user' THEN 1 ELSE 0 END AS BIGINT) AS illustrated, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS words FROM conversations WHERE text IS NOT NULL",
)
def script_summary(spark, sf_dir: str) -> DataFrame:
    """[K13, A12] Scripts of one scene a turn; a user's turn counts as illustrated."""
    from leafmill.operators import pipelines

    rows = table(spark, sf_dir, "conversations").where("text is not null")
    return pipelines.script_summary(rows.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("number"), F.col("text").alias("narration"), F.when(F.col("role") == "user", "picture").alias("kind")))


@register("video_plan")
def video_plan(spark, sf_dir: str) -> DataFrame:
    """[K12, P8] Clips of every conversation's extractive slides, in parts of a minute."""
    from leafmill.operators import pipelines
    from leafmill.operators import segmentation as seg

    chapters = _conversation_chapters(spark, sf_dir)
    scenes = chapters.select("doc_id", "number", F.col("title").alias("chapter_title"), F.posexplode(seg.scenes(F.col("title"), F.col("paragraphs"))).alias("k", "s"))
    rows = scenes.select("doc_id", "number", "chapter_title", (F.col("k") + 1).alias("scene_no"), "s.title", "s.narration")
    return pipelines.video_plan(rows, 1.0).withColumns({c: F.round(c, 4) for c in ("audio_seconds", "seconds")})
