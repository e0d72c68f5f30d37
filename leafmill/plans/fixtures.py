"""Queries whose inputs both engines derive by the same expressions: rows of the given tables, behind a few fixed rows of odd cases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill import constants as C
from leafmill.functions import text as T
from leafmill.functions import timing
from leafmill.operators import catalogs, figures, media, structure
from leafmill.operators import segmentation as seg
from leafmill.plans import sql
from leafmill.plans.basics import PLANNED
from leafmill.plans.catalog import register


def values(name: str, columns: str, *rows: str, more: str = "") -> str:
    """A common table expression that Spark and DuckDB both accept: fixed rows, and with ``more`` those of a query over the given tables."""
    return f"{name} AS (SELECT * FROM (VALUES {', '.join(rows)}) t({columns}){f' UNION ALL {more}' if more else ''})"


#: The given tables that inputs are derived from.
GIVEN = ("conversations", "part", "orders", "documents")


def _viewed(spark, sf_dir: str, fixture: str):
    for name in GIVEN:
        if f"FROM {name}" in fixture:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(f"WITH {fixture} SELECT * FROM {fixture.split(' ', 1)[0]}")


def on(fixture: str, query: Callable[[DataFrame], DataFrame]):
    """A query over one input."""
    return lambda spark, sf_dir: query(_viewed(spark, sf_dir, fixture))


def frames(spark, *fixtures: str, sf_dir: str = "") -> list[DataFrame]:
    return [_viewed(spark, sf_dir, f) for f in fixtures]


_TURN = "CAST(1000 + conv_id * 1000 + turn AS INT)"
_FLAT = "replace(text, chr(10), ' ')"
_SAID = "FROM conversations WHERE text IS NOT NULL AND turn IS NOT NULL"


LINES = values(
    "ls", "id, line", "(1, '12')", "(2, 'Page 3 of 10')", "(3, ' page 7 ')", "(4, '3/44')", "(5, '12345')", "(6, 'Page one')", "(7, 'Chapter IV')", "(8, 'CHAPTER 2. The End')", "(9, 'Part of the reason')",
    "(10, 'Kapitel 3')", "(11, 'Chapters')", "(12, 'Figure 3: The heart')", "(13, 'Fig. 2')", "(14, 'Figure 5 shows that')", "(15, 'Table 4.2 Values')", "(16, 'Abb. 1-2 Herz')", "(17, 'A line that ends.')", "(18, 'Too many words for a heading because it goes on and on and on and')",
    more=f"""SELECT {_TURN}, CASE turn % 7 WHEN 0 THEN CAST(length(text) AS STRING) WHEN 1 THEN 'Page ' || CAST(turn AS STRING) || ' of ' || CAST(conv_id AS STRING) WHEN 2 THEN 'Chapter ' || CAST(conv_id % 30 AS STRING) || '. ' || substring({_FLAT}, 1, 20) WHEN 3 THEN 'Figure ' || CAST(turn AS STRING) || ': ' || substring({_FLAT}, 1, 30) WHEN 4 THEN 'Fig. ' || CAST(turn AS STRING) || ' ' || lower(substring({_FLAT}, 1, 15)) WHEN 5 THEN substring({_FLAT}, 1, 60) ELSE {_FLAT} END {_SAID}""",
)

register(
    "line_kinds",
    f"""WITH {LINES} SELECT id, regexp_matches(line, '(?i)^\\s*(page\\s*)?\\d{{1,4}}(\\s*(/|of)\\s*\\d{{1,4}})?\\s*$') AS page_number,
  regexp_matches(line, '(?i)^\\s*({C.CHAPTER_WORDS})\\s+([0-9]+|[ivxlcdm]+|[a-z]+)\\b.*$') AS chapter_line,
  regexp_matches(line, '(?i)^\\s*({C.CAPTION_WORDS})\\.?\\s*[0-9ivxlcdm]+([.:–-]\\s*|\\s|$)') AND NOT regexp_matches(regexp_replace(line, '(?i)^\\s*({C.CAPTION_WORDS})\\.?\\s*[0-9ivxlcdm]+([.:–-]\\s*|\\s|$)', ''), '^\\p{{Ll}}') AS caption,
  length(trim(line)) BETWEEN 1 AND 90 AND NOT regexp_matches(trim(line), '[.,;]$') AND len(regexp_extract_all(line, '\\S+')) <= 12 AS heading FROM ls""",
)(on(LINES, lambda d: d.select("id", T.is_page_number(F.col("line")).alias("page_number"), T.is_chapter_line(F.col("line")).alias("chapter_line"), T.is_caption(F.col("line")).alias("caption"), T.looks_like_heading(F.col("line")).alias("heading"))))

MENTIONS = values("ms", "id, body", "(1, 'See Figure 2.1 and Fig. 3, then figures 4')", "(2, 'Table 4-2 beside Abb. 5; obr. 6.1')", "(3, 'configuration of tables')", "(4, 'as in fig 7–2.')", "(5, '')",
    more=f"""SELECT {_TURN}, substring({_FLAT}, 1, 40) || ' see Figure ' || CAST(turn AS STRING) || '.' || CAST(conv_id % 9 AS STRING) || ' and tables ' || CAST(conv_id % 40 AS STRING) || ' or ' || role {_SAID}""",
)
register(
    "figure_refs",
    f"""WITH {MENTIONS}, m AS (SELECT id, unnest(regexp_extract_all(body, '(?i)\\b(?:{C.REFERENCE_WORDS})\\.?\\s*\\d+(?:[.–-]\\d+)*')) AS r, unnest(range(0, len(regexp_extract_all(body, '(?i)\\b(?:{C.REFERENCE_WORDS})\\.?\\s*\\d+(?:[.–-]\\d+)*')))) AS pos FROM ms)
SELECT id, CAST(pos AS INT) AS pos, CASE WHEN lower(r) LIKE 'tab%' THEN 'table ' ELSE 'figure ' END || regexp_replace(regexp_extract(r, '\\d.*$'), '[–-]', '.', 'g') AS key FROM m""",
)(on(MENTIONS, lambda d: d.select("id", F.posexplode(T.figure_refs(F.col("body"))).alias("pos", "key"))))

NAMES = values("ns", "id, name", "(1, 'Part 1: \"Why?\" / How')", "(2, '   ')", f"(3, '{'word ' * 50}')", "(4, 'a' || chr(9) || 'b..')", "(5, '. x .')",
    more=f"""SELECT CAST(1000 + p_partkey AS INT), CASE p_partkey % 3 WHEN 0 THEN p_name || ': "' || p_brand || '"?' WHEN 1 THEN ' ' || p_name || ' / ' || p_name || ' * ' || p_type || p_name || '..' ELSE p_type END FROM part WHERE p_name IS NOT NULL""",
)
register(
    "safe_names",
    """WITH %s, c AS (SELECT id, trim(regexp_replace(regexp_replace(name, '[\\\\/:*?"<>|\\x00-\\x1f]+', ' ', 'g'), '[ \\t\\x{00a0}]+', ' ', 'g'), ' .') AS t FROM ns)
SELECT id, CASE WHEN t = '' THEN 'Untitled' WHEN length(t) > 80 THEN rtrim(regexp_replace(left(t, 80), ' [^ ]*$', ''), ' .,;-') ELSE t END AS name FROM c""" % NAMES,
)(on(NAMES, lambda d: d.select("id", T.safe_filename(F.col("name"), compose=False).alias("name"))))

MARKDOWN = values("mds", "id, line", "(1, 'An ![alt](x.png) image')", "(2, 'a [link](http://x) here')", "(3, 'some `code` and **bold** or __strong__')", "(4, '*em* and _it_ but snake_case_name')", "(5, '- item')", "(6, '12. item')", "(7, '> quoted')", "(8, 'plain * star')")
register(
    "strip_markdown",
    f"""WITH {MARKDOWN} SELECT id, CASE id WHEN 1 THEN 'An  image' WHEN 2 THEN 'a link here' WHEN 3 THEN 'some code and bold or strong' WHEN 4 THEN 'em and it but snake_case_name' WHEN 7 THEN 'quoted' WHEN 8 THEN 'plain * star' ELSE 'item' END AS line FROM mds""",
)(on(MARKDOWN, lambda d: d.select("id", T.strip_markdown(F.col("line")).alias("line"))))

RAW = values("rs", "id, raw", "(1, 'con-' || chr(10) || 'tinues')", "(2, 'soft' || chr(173) || 'hyphen')", "(3, 'a' || chr(13) || chr(10) || 'b' || chr(13) || 'c')", "(4, ' many   blanks ' || chr(160) || ' x ')", "(5, 'ﬁne')",
    more=f"""SELECT {_TURN}, substring(text, 1, 50) || ' con-' || chr(10) || 'tinues' || chr(13) || chr(10) || 'x' || chr(173) || 'y   ' || substring(text, 51, 200) {_SAID}""",
)
register(
    "normalized_text",
    f"""WITH {RAW} SELECT id, trim(regexp_replace(replace(regexp_replace(regexp_replace(replace(replace(raw, 'ﬁ', 'fi'), chr(173), ''), '\\r\\n?', chr(10), 'g'), '(\\w)-\\n(\\w)', '\\1\\2', 'g'), chr(10), ' '), '[ \\t\\x{{00a0}}]+', ' ', 'g')) AS clean FROM rs""",
)(on(RAW, lambda d: d.select("id", T.clean_paragraph(F.col("raw")).alias("clean"))))

SECONDS = values("ss", "id, s", "(1, CAST(0.4 AS DOUBLE))", "(2, CAST(59.5 AS DOUBLE))", "(3, CAST(61.0 AS DOUBLE))", "(4, CAST(754.2 AS DOUBLE))", "(5, CAST(7325.0 AS DOUBLE))", "(6, CAST(2.5 AS DOUBLE))", "(7, CAST(3599.9995 AS DOUBLE))",
    more=f"""SELECT CAST(1000 + o_orderkey AS INT), CAST(o_totalprice AS DOUBLE) / 97 FROM orders""",
)
register("durations", f"WITH {SECONDS} SELECT id, {sql.duration('s')} AS duration, {sql.srt('s')} AS srt FROM ss")(on(SECONDS, lambda d: d.select("id", timing.format_duration(F.col("s")).alias("duration"), timing.srt_time(F.col("s")).alias("srt"))))

SIZES = values("zs", "id, n", "(1, CAST(1500000000 AS BIGINT))", "(2, CAST(999999 AS BIGINT))", "(3, CAST(345600000 AS BIGINT))", "(4, CAST(5200000000 AS BIGINT))",
    more=f"""SELECT CAST(1000 + o_orderkey AS INT), CAST(o_orderkey AS BIGINT) * 7919 + 1234567 FROM orders""",
)
register("format_sizes", f"WITH {SIZES} SELECT id, CASE WHEN n >= 1e9 THEN printf('%.1f GB', n / 1e9) ELSE printf('%.0f MB', n / 1e6) END AS size FROM zs")(on(SIZES, lambda d: d.select("id", timing.format_size(F.col("n")).alias("size"))))

AUDIO = values("au", "id, audio, n", "(1, CAST(10.0 AS DOUBLE), 4)", "(2, CAST(3.0 AS DOUBLE), 1)", "(3, CAST(7.5 AS DOUBLE), 2)",
    more=f"""SELECT {_TURN}, CAST(length(text) + 10 AS DOUBLE) / 15, CAST(1 + turn % 5 AS INT) {_SAID}""",
)
register("reveal_frames", f"WITH {AUDIO} SELECT id, CAST(k AS INT) AS k, round(CASE WHEN k = 0 THEN 0.0 ELSE 0.2 + audio * 0.85 * k / n END, 6) AS start FROM (SELECT id, audio, n, unnest(range(0, n)) AS k FROM au)")(
    on(AUDIO, lambda d: d.select("id", F.posexplode(timing.reveal_starts(F.col("audio"), F.col("n"))).alias("k", "start")).withColumn("start", F.round("start", 6)))
)
register("clip_fades", f"WITH {AUDIO} SELECT id, round(greatest(0.04, least(0.4, 0.8 * least(audio / 10, least(audio / 10 + 0.1, audio - 0.1) - audio / 10, audio - least(audio / 10 + 0.1, audio - 0.1)))), 6) AS fade FROM au")(
    on(AUDIO, lambda d: d.select("id", F.round(timing.clip_fade(F.array(F.lit(0.0), F.col("audio") / 10, F.col("audio") / 10 + 0.1), F.col("audio"))["fade"], 6).alias("fade")))
)

SHAPES = values("sh", "id, w, h, bw, bh", "(1, 1600, 900, 800, 800)", "(2, 300, 900, 1920, 1080)", "(3, 10, 10, 55, 20)", "(4, 4000, 10, 100, 100)",
    more=f"""SELECT CAST(1000 + p_partkey AS INT), CAST(10 + p_size * 37 AS INT), CAST(20 + p_partkey % 900 AS INT), CAST(50 + p_partkey % 1900 AS INT), CAST(20 + p_partkey % 1000 AS INT) FROM part""",
)
register(
    "fit_rect",
    f"WITH {SHAPES}, s AS (SELECT *, least(bw / w, bh / h) AS k FROM sh), z AS (SELECT *, greatest(1, CAST(floor(w * k) AS INT)) AS fw, greatest(1, CAST(floor(h * k) AS INT)) AS fh FROM s) SELECT id, CAST((bw - fw) // 2 AS INT) AS x, CAST((bh - fh) // 2 AS INT) AS y, fw AS w, fh AS h FROM z",
)(on(SHAPES, lambda d: d.select("id", timing.fit_rect(*map(F.col, ("w", "h", "bw", "bh"))).alias("r")).select("id", "r.*")))

ASPECTS = values("asp", "id, side, aspect", "(1, 1024, CAST(1.0 AS DOUBLE))", "(2, 1024, CAST(2.4 AS DOUBLE))", "(3, 512, CAST(0.3 AS DOUBLE))", "(4, 768, CAST(1.5 AS DOUBLE))",
    more=f"""SELECT CAST(1000 + p_partkey AS INT), CASE p_partkey % 3 WHEN 0 THEN 512 WHEN 1 THEN 768 ELSE 1024 END, 0.25 + CAST(p_partkey % 311 AS DOUBLE) / 100 FROM part""",
)
register(
    "picture_dims",
    f"WITH {ASPECTS}, a AS (SELECT id, side, least(2.0, greatest(0.5, aspect)) AS r FROM asp) SELECT id, CAST(greatest(256, round_even(side * sqrt(r) / 64, 0) * 64) AS INT) AS width, CAST(greatest(256, round_even(side / sqrt(r) / 64, 0) * 64) AS INT) AS height FROM a",
)(on(ASPECTS, lambda d: d.select("id", timing.picture_size(F.col("side"), F.col("aspect")).alias("p")).select("id", "p.*")))

PROMPTS = values("ps", "id, model, w, h, style, prompt", "(1, 'm', 512, 512, 'flat', 'a red house')", "(2, 'm', 512, 576, 'flat', 'a red house')", "(3, 'n', 1024, 1024, '', 'é')",
    more=f"""SELECT {_TURN}, 'm' || role, 512, CAST(64 * (8 + turn % 5) AS INT), 'flat', text {_SAID} AND role IS NOT NULL""",
)
register(
    "picture_cache_key",
    f"WITH {PROMPTS} SELECT id, left(sha256(model || '|' || w || 'x' || h || '|' || style || '|' || prompt), 16) AS key, CAST(('0x' || left(sha256(prompt), 8)) AS BIGINT) & 2147483647 AS seed FROM ps",
)(on(PROMPTS, lambda d: d.select("id", timing.cache_key(F.col("model"), F.col("w"), F.col("h"), F.col("style"), F.col("prompt")).alias("key"), timing.seed(F.col("prompt")).alias("seed"))))

BARS = values("bs", "diagram_id, item, value", "(1, 'a', CAST(10.0 AS DOUBLE))", "(1, 'b', CAST(0.0 AS DOUBLE))", "(1, 'c', CAST(2.5 AS DOUBLE))", "(2, 'z', CAST(0.0 AS DOUBLE))",
    more=f"""SELECT CAST(1000 + conv_id AS INT), CAST(turn AS STRING), CAST(length(text) AS DOUBLE) {_SAID}""",
)
register("bar_lengths", f"WITH {BARS} SELECT diagram_id, item, value, greatest(6.0, 1000 * value / (CASE WHEN max(value) OVER w = 0 THEN 1.0 ELSE max(value) OVER w END)) AS length FROM bs WINDOW w AS (PARTITION BY diagram_id)")(on(BARS, lambda d: figures.bar_lengths(d, F.lit(1000.0))))

PLAN = values("pl", "id, k, d, e", *[f"({i}, {k}, CAST({d} AS DOUBLE), {str(e).lower()})" for i, ds in ((1, [10, 20, 30]), (2, [60] * 25), (3, [31, 47, 12, 88, 5, 64, 90, 23, 71, 40] * 4), (4, [700, 20, 20]), (5, [0.5])) for k, d in enumerate(ds) for e in [i != 3 or k % 3 == 2]])


def _plan_sql(ids: str, most: str) -> str:
    lists = f"lists AS (SELECT id AS doc_id, list(d ORDER BY k) AS d, list(e ORDER BY k) AS e, list_reduce(list(d ORDER BY k), lambda a, b: a + b) AS total FROM pl WHERE {ids} GROUP BY id)"
    return f"(WITH {PLAN}, {lists}, {PLANNED.format(most=most)} SELECT doc_id AS id, CAST(chunk_no AS INT) AS k, CAST(part_no AS INT) AS part FROM parts)"


@register("parts_fixture", f"SELECT * FROM {_plan_sql('id <> 3', '600.0')} UNION ALL SELECT * FROM {_plan_sql('id = 3', '300.0')}")
def parts_fixture(spark, sf_dir: str) -> DataFrame:
    """[W1] Parts of fixed durations."""
    (rows,) = frames(spark, PLAN)
    lists = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "d", "e"))).alias("x"))
    most = F.when(F.col("id") == 3, 300.0).otherwise(600.0)
    return lists.select("id", F.posexplode(seg.plan_parts(F.transform("x", lambda x: x["d"]), F.transform("x", lambda x: x["e"]), most)).alias("k", "part"))


SPECS = values("sp", "id, spec, n", "(1, '1,3-4', 5)", "(2, '2,2', 3)", "(3, ' 1 , ,2-2', 2)", "(4, '5-5,1', 5)",
    more=f"""SELECT CAST(1000 + p_partkey AS INT), CAST(1 + p_partkey % 4 AS STRING) || ', ' || CAST(2 + p_partkey % 3 AS STRING) || '-' || CAST(5 + p_size % 5 AS STRING), 12 FROM part""",
)
register(
    "chapter_selection",
    f"""WITH {SPECS}, p AS (SELECT id, unnest(list_filter(list_transform(string_split(spec, ','), lambda x: trim(x)), lambda x: x <> '')) AS part, generate_subscripts(list_filter(list_transform(string_split(spec, ','), lambda x: trim(x)), lambda x: x <> ''), 1) AS o FROM sp),
x AS (SELECT id, o, unnest(range(CAST(string_split(part, '-')[1] AS INT) - 1, CAST(string_split(part, '-')[-1] AS INT))) AS chapter FROM p)
SELECT id, CAST(chapter AS INT) AS chapter FROM x GROUP BY id, chapter""",
)(on(SPECS, lambda d: d.select("id", F.explode(structure.chapter_selection(F.col("spec"), F.col("n"))).alias("chapter"))))

BOOK = values(
    "bk", "doc_id, chapter_no, title, para_no, text", "(1, 1, 'Front', 0, 'legal text')", "(1, 1, 'Front', 1, '*** START OF THE PROJECT GUTENBERG EBOOK X ***')", "(1, 1, 'Front', 2, 'kept one')", "(1, 2, 'Two', 0, 'kept two')",
    "(1, 2, 'Two', 1, '*** END OF THIS PROJECT GUTENBERG EBOOK')", "(1, 3, 'Licence', 0, 'gone')", "(2, 1, 'A', 0, 'no markers')", "(2, 2, 'The Project Gutenberg License', 0, 'gone')", "(3, 1, 'B', 0, '*** START OF THE PROJECT GUTENBERG')", "(3, 1, 'B', 1, 'after')",
    more=f"""SELECT CAST(1000 + conv_id AS INT), CAST(1 + turn AS INT), CASE WHEN conv_id % 7 = 0 AND turn = 5 THEN 'The Project Gutenberg License' ELSE 'Chapter ' || CAST(turn AS STRING) END, 0, CASE WHEN turn = 1 AND conv_id % 3 = 0 THEN '*** START OF THE PROJECT GUTENBERG EBOOK' WHEN turn = 4 AND conv_id % 5 = 0 THEN '*** END OF THIS PROJECT GUTENBERG EBOOK' ELSE {_FLAT} END {_SAID}""",
)
register(
    "gutenberg_strip",
    f"""WITH {BOOK}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chapter_no, para_no) - 1 AS k FROM bk),
m AS (SELECT *, min(k) FILTER (WHERE regexp_matches(text, '(?i)^\\*{{3}}\\s*START OF (THE|THIS) PROJECT GUTENBERG')) OVER w AS s, min(k) FILTER (WHERE regexp_matches(text, '(?i)^\\*{{3}}\\s*END OF (THE|THIS) PROJECT GUTENBERG')) OVER w AS e FROM k WINDOW w AS (PARTITION BY doc_id))
SELECT doc_id, chapter_no, title, para_no, text FROM m WHERE ((s IS NULL AND e IS NULL) OR (k > coalesce(nullif(s, 0), -1) AND (e IS NULL OR k < e))) AND NOT regexp_matches(title, '(?i)project gutenberg')""",
)(on(BOOK, structure.strip_licence))

CONTENTS = values("ct", "id, title, paras", "(1, 'Contents', ARRAY['x'])", "(2, 'contents of the box', ARRAY['x'])", "(3, 'One', ARRAY['Intro .... 3', 'Methods 12', 'Results 40', 'Notes', 'Index 99'])", "(4, 'One', ARRAY['a 1', 'b 2', 'c 3'])", "(5, 'Inhaltsverzeichnis', ARRAY['x'])",
    more=f"""SELECT {_TURN}, CASE conv_id % 5 WHEN 0 THEN 'Contents' WHEN 1 THEN 'Obsah knihy' ELSE 'Chapter ' || CAST(turn AS STRING) END, ARRAY[substring({_FLAT}, 1, 20) || ' .... 3', substring({_FLAT}, 21, 20) || CASE turn % 2 WHEN 0 THEN ' 12' ELSE '' END, substring({_FLAT}, 41, 200) || ' 40', CASE conv_id % 2 WHEN 0 THEN 'Notes' ELSE 'Notes 77' END, 'Index 99'] AS paras {_SAID}""",
)
CONTENTS_DUCK = CONTENTS.replace("ARRAY[", "[")
register(
    "toc_filter",
    f"""WITH {CONTENTS_DUCK} SELECT id, regexp_matches(title, '(?i)^\\s*(table of )?contents|^(obsah|inhalt(sverzeichnis)?|table des matières|índice)|^indice\\s*$') OR (len(paras) >= 5 AND len(list_filter(paras, lambda p: length(p) < 100 AND regexp_matches(p, '(\\.{{3,}}|\\s)\\d{{1,4}}\\s*$'))) / len(paras) > 0.6) AS contents FROM ct""",
)(on(CONTENTS.replace("ARRAY[", "array(").replace("])", "))").replace("] AS paras", ") AS paras"), lambda d: d.select("id", structure.is_contents(F.col("title"), F.col("paras")).alias("contents"))))

PDF = values(
    "pg", "doc_id, i, page, line_no, text, size, bold, block_start", *[
        f"(1, {i}, {p}, {n}, '{t}', CAST({s} AS DOUBLE), {b}, {st})" for i, (p, n, t, s, b, st) in enumerate([
            (0, 0, "Introduction", 24, "false", "true"), (0, 1, "body text of the first page that goes on for long", 11, "false", "true"), (1, 0, "Methods.", 24, "false", "true"), (1, 1, "Methods", 24, "false", "true"),
            (1, 2, "and Materials", 14, "false", "false"), (1, 3, "more body text of the second page here", 11, "false", "true"), (2, 0, "running body text", 11, "false", "true"), (2, 1, "Chapter 3", 12, "true", "true"), (2, 2, "the last body text of the document", 11, "false", "false")])],
)
register("font_chapters", "SELECT * FROM (VALUES (1, 0, 'Introduction'), (1, 3, 'Methods – and Materials'), (1, 7, 'Chapter 3')) t(doc_id, start, title)")(on(PDF, structure.chapters_from_fonts))

OUTLINE = values("ol", "doc_id, ord, level, title, page", "(1, 0, 1, 'The Book', 1)", "(1, 1, 2, 'Introduction', 1)", "(1, 2, 2, 'Methods and Materials', 2)", "(1, 3, 2, 'Chapter 3: The End', 3)", "(1, 4, 3, 'Deep', 3)", "(1, 5, 2, 'Beyond', 9)", "(1, 6, 2, 'Unnamed', 3)")


PAGE_LINES = f"pl AS (SELECT CAST(1000 + conv_id AS INT) AS doc_id, CAST(turn AS INT) AS i, CAST(turn AS INT) AS page, substring({_FLAT}, 1, 60) AS text {_SAID})"
PAGE_OUTLINE = f"""po AS (SELECT CAST(1000 + conv_id AS INT) AS doc_id, CAST(turn AS INT) AS ord, CAST(CASE WHEN turn = 0 AND conv_id % 2 = 0 THEN 1 WHEN turn % 3 = 2 THEN 3 ELSE 2 END AS INT) AS level,
  CASE turn % 4 WHEN 3 THEN 'Not on its page' ELSE substring({_FLAT}, 1, 25) END AS title, CAST(turn + 1 + conv_id % 2 AS INT) AS page {_SAID})"""
PAGE_STARTS = f"ps AS (SELECT CAST(1000 + conv_id AS INT) AS doc_id, CAST(turn AS INT) AS start, role AS title, CAST(turn AS INT) AS ord {_SAID} AND (turn + conv_id) % 3 = 0)"


@register(
    "outline_chapters",
    f"""WITH {OUTLINE}, {PDF}, {PAGE_LINES}, {PAGE_OUTLINE}, o AS (SELECT * FROM ol UNION ALL SELECT * FROM po), g AS (SELECT doc_id, i, page, text FROM pg UNION ALL SELECT * FROM pl),
n AS (SELECT doc_id, level, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY level) AS k FROM o GROUP BY doc_id, level),
lv AS (SELECT doc_id, CASE WHEN max(n) FILTER (WHERE k = 1) = 1 AND count(*) > 1 THEN max(level) FILTER (WHERE k = 2) ELSE min(level) END AS level FROM n GROUP BY doc_id),
c AS (SELECT o.*, page - 1 AS p, regexp_replace(lower(title), '[\\W_]+', '', 'g') AS target FROM o JOIN lv USING (doc_id, level) WHERE page - 1 <= (SELECT max(page) FROM g WHERE g.doc_id = o.doc_id)),
q AS (SELECT *, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS sq FROM g), t AS (SELECT c.*, regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS sq FROM c),
a AS (SELECT c.doc_id, c.ord, min(g.i) AS i FROM c JOIN g ON g.doc_id = c.doc_id AND g.page >= c.p GROUP BY ALL),
e AS (SELECT t.doc_id, t.ord, min(q.i) AS i FROM t JOIN q ON q.doc_id = t.doc_id AND q.page = t.p AND q.sq <> '' AND (starts_with(t.sq, q.sq) OR starts_with(q.sq, t.sq)) GROUP BY ALL)
SELECT c.doc_id, CAST(coalesce(e.i, a.i) AS INT) AS start, trim(title) AS title, c.ord AS ord FROM c LEFT JOIN a USING (doc_id, ord) LEFT JOIN e USING (doc_id, ord)""",
)
def outline_chapters(spark, sf_dir: str) -> DataFrame:
    """[J4, A7, O3] Outline entries at their lines; conversations are documents of a page a turn."""
    outline, lines, given, of_given = frames(spark, OUTLINE, PDF, PAGE_LINES, PAGE_OUTLINE, sf_dir=sf_dir)
    return structure.chapters_from_outline(outline.unionByName(of_given), lines.select("doc_id", "i", "page", "text").unionByName(given))


@register(
    "chapter_slices",
    f"WITH {PDF}, {PAGE_LINES}, {PAGE_STARTS}, s AS (SELECT * FROM (VALUES (1, 1, 'A', 0), (1, 3, 'B', 1), (1, 7, 'C', 2)) t(doc_id, start, title, ord) UNION ALL SELECT * FROM ps), "
    "l AS (SELECT doc_id, i FROM pg UNION ALL SELECT doc_id, i FROM pl), r AS (SELECT *, row_number() OVER w AS n, lead(start) OVER w AS stop FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY start)) "
    "SELECT l.doc_id, l.i, CAST(coalesce(n, 0) AS INT) AS chapter_no, coalesce(title, '') AS title FROM l LEFT JOIN r ON r.doc_id = l.doc_id AND l.i >= start AND (stop IS NULL OR l.i < stop)",
)
def chapter_slices(spark, sf_dir: str) -> DataFrame:
    """[W4] Lines between chapter starts."""
    lines, starts, given, of_given = frames(spark, PDF, values("s", "doc_id, start, title, ord", "(1, 1, 'A', 0)", "(1, 3, 'B', 1)", "(1, 7, 'C', 2)"), PAGE_LINES, PAGE_STARTS, sf_dir=sf_dir)
    both = lines.select("doc_id", "i").unionByName(given.select("doc_id", "i"))
    return structure.chapter_slices(starts.unionByName(of_given), both).select("doc_id", "i", "chapter_no", "title")


SUBTITLES = values("st", "doc_id, line_no, text", "(1, 1, 'CHAPTER I.')", "(1, 2, '')", "(1, 3, 'Down the Rabbit-Hole')", "(1, 4, '')", "(1, 5, 'Alice was')", "(1, 6, 'CHAPTER II.')", "(1, 7, 'she went on and')", "(1, 8, '')", "(2, 1, 'Chapter 3')", "(2, 2, 'The Pool')")
register("chapter_subtitles", f"WITH {SUBTITLES} SELECT doc_id, line_no, CASE WHEN doc_id = 1 AND line_no = 1 THEN 'CHAPTER I. Down the Rabbit-Hole' WHEN doc_id = 2 AND line_no = 1 THEN 'Chapter 3 The Pool' WHEN text IN ('Down the Rabbit-Hole', 'The Pool') THEN '' ELSE text END AS text FROM st")(on(SUBTITLES, structure.merge_subtitles))

NUMBERS = values("nu", "doc_id, position, number", "(1, 1, 0)", "(1, 2, 7)", "(1, 3, 0)", "(2, 1, 0)",
    more=f"""SELECT CAST(1000 + conv_id AS INT), CAST(turn AS INT), CAST(CASE turn % 3 WHEN 0 THEN 0 ELSE turn + 3 END AS INT) {_SAID}""",
)
register("numbered_chapters", f"WITH {NUMBERS}, n AS (SELECT doc_id, position, CAST(CASE WHEN number = 0 THEN row_number() OVER (PARTITION BY doc_id ORDER BY position) ELSE number END AS INT) AS number FROM nu) SELECT *, greatest(count(*) OVER w, max(number) OVER w) AS chapter_count FROM n WINDOW w AS (PARTITION BY doc_id)")(on(NUMBERS, structure.numbered_chapters))

IMAGES = values(
    "im", "doc_id, chapter, position, file, width, height, caption, kind, description, sha256", "(1, 1, 1, 'a.png', 800, 400, 'Figure 2.1: Wide', 'chart', '', 's1')", "(1, 1, 2, 'b.png', 300, 500, 'Fig. 3 Tall', '', '', 's2')", "(1, 1, 3, 'c.png', 300, 500, 'Figure 2.1 again', 'text', 'words', 's3')",
    "(1, 1, 4, 'd.png', 300, 300, '', 'photo', 'a cat', 's4')", "(1, 2, 5, 'e.png', 300, 300, 'Table 1', '', '', 's1')",
    more=f"""SELECT CAST(1000 + conv_id AS INT), 1, CAST(turn AS INT), 'f' || CAST(conv_id AS STRING) || '_' || CAST(turn AS STRING) || '.png', CAST(200 + length(text) % 700 AS INT), 400, CASE turn % 3 WHEN 2 THEN '' ELSE 'Figure ' || CAST(turn AS STRING) || ': ' || substring({_FLAT}, 1, 20) END, CASE turn % 4 WHEN 0 THEN 'photo' WHEN 1 THEN '' WHEN 2 THEN 'text' ELSE 'decorative' END, CASE conv_id % 3 WHEN 0 THEN '' ELSE substring({_FLAT}, 1, 30) END, 's' || CAST(conv_id % 50 AS STRING) {_SAID}""",
)
SCENES = values(
    "sc", "doc_id, chapter, scene_no, title, bullets, narration, book_image", "(1, 1, 1, 'One', '', 'see Figure 2.1 and Fig. 3', '')", "(1, 1, 2, 'Two', 'as Fig. 3 says', 'or figure 2.1', '')", "(1, 1, 3, 'Three', '', 'Figure 9', 'x.png')",
    "(1, 1, 4, 'Four', '', 'Fig. 3', 'b.png')", "(1, 2, 1, 'Five', '', 'Table 1', '')",
    more=f"""SELECT CAST(1000 + conv_id AS INT), 1, CAST(turn + 1 AS INT), 'Scene ' || CAST(turn AS STRING), CASE conv_id % 2 WHEN 0 THEN '' ELSE 'as figure ' || CAST(turn + 2 AS STRING) || ' says' END, 'then see Figure ' || CAST(turn + 1 AS STRING) || ' and Fig. 0', CASE turn % 5 WHEN 1 THEN 'f' || CAST(conv_id AS STRING) || '_' || CAST(turn + 1 AS STRING) || '.png' ELSE '' END {_SAID}""",
)


@register(
    "mentioned_figures",
    f"""WITH {SCENES}, {IMAGES}, ref AS (SELECT '(?i)\\b(?:{C.REFERENCE_WORDS})\\.?\\s*\\d+(?:[.–-]\\d+)*' AS re),
key AS (SELECT *, regexp_extract(caption, re) AS r FROM im, ref), fig AS (SELECT doc_id, chapter, CASE WHEN lower(r) LIKE 'tab%' THEN 'table ' ELSE 'figure ' END || regexp_replace(regexp_extract(r, '\\d.*$'), '[–-]', '.', 'g') AS key,
  arg_min({{'file': file, 'width': width, 'height': height}}, position) AS image FROM key WHERE r <> '' GROUP BY ALL),
m AS (SELECT doc_id, chapter, scene_no, regexp_extract_all(title || ' ' || bullets || ' ' || narration, re) AS l FROM sc, ref), u AS (SELECT *, unnest(l) AS r, unnest(range(0, len(l))) AS pos FROM m),
hit AS (SELECT u.doc_id, u.chapter, u.scene_no, arg_min({{'key': key, 'image': image}}, pos) AS f FROM (SELECT *, CASE WHEN lower(r) LIKE 'tab%' THEN 'table ' ELSE 'figure ' END || regexp_replace(regexp_extract(r, '\\d.*$'), '[–-]', '.', 'g') AS key FROM u) u JOIN fig USING (doc_id, chapter, key) GROUP BY ALL),
x AS (SELECT sc.*, f, f IS NOT NULL AND f.image.file <> book_image AS new FROM sc LEFT JOIN hit USING (doc_id, chapter, scene_no))
SELECT doc_id, chapter, scene_no, title, CASE WHEN new THEN f.key END AS figure, CASE WHEN new THEN f.image.file ELSE book_image END AS shows, CASE WHEN new THEN CASE WHEN f.image.width >= f.image.height * 1.4 THEN 'full' ELSE 'right' END END AS placement FROM x""",
)
def mentioned_figures(spark, sf_dir: str) -> DataFrame:
    """[J1, X4, X5] The figure that each scene's text refers to first."""
    scenes, images = frames(spark, SCENES, IMAGES, sf_dir=sf_dir)
    found = figures.mentioned_figures(scenes.withColumn("bullets", F.array("bullets")), images)
    return found.select("doc_id", "chapter", "scene_no", "title", "figure", "shows", "placement")


register(
    "suitable_images",
    f"""WITH {IMAGES} SELECT file, (description <> '' OR caption <> '') AND kind NOT IN ('text', 'decorative') AS suitable, coalesce(nullif(kind, ''), 'image') || ': ' || coalesce(nullif(description, ''), '(no description)') || CASE WHEN caption <> '' THEN ' Caption in the book: "' || caption || '"' ELSE '' END AS summary FROM im""",
)(on(IMAGES, lambda d: d.select("file", figures.is_suitable(F.col("kind"), F.col("description"), F.col("caption")).alias("suitable"), figures.image_summary(F.col("kind"), F.col("description"), F.col("caption")).alias("summary"))))


KNOWN = values(
    "known", "sha256, kind, description, position", "('s1', 'photo', 'd', 1)", "('s2', '', '', 2)", "('s9', 'map', 'm', 3)",
    more=f"""SELECT DISTINCT 's' || CAST(conv_id % 50 AS STRING), CASE conv_id % 50 % 4 WHEN 0 THEN '' ELSE 'photo' END, 'd', 4 {_SAID} AND conv_id % 2 = 0""",
)


@register("images_to_describe", f"WITH {IMAGES}, {KNOWN} SELECT file FROM im WHERE sha256 NOT IN (SELECT sha256 FROM known WHERE kind <> '')")
def images_to_describe(spark, sf_dir: str) -> DataFrame:
    """[J6, S12, B3] Images that no catalogue entry describes."""
    images, known = frames(spark, IMAGES, KNOWN, sf_dir=sf_dir)
    return figures.described(images.select("file", "sha256"), known)[1].select("file")


FIGURES = values("fg", "page_id, figure_no, x0, y0, x1, y1", "(1, 1, 100, 100, 300, 300)", "(1, 2, 100, 500, 300, 700)", "(2, 1, 0, 0, 50, 50)",
    more=f"""SELECT CAST(1000 + conv_id AS INT), CAST(turn AS INT), CAST(length(text) % 200 AS INT), CAST(turn * 60 AS INT), CAST(length(text) % 200 + 150 AS INT), CAST(turn * 60 + 50 AS INT) {_SAID} AND turn % 2 = 0""",
)
CAPTIONS = values("cp", "page_id, x0, y0, x1, y1, text", "(1, 100, 310, 300, 330, 'Figure 1: under')", "(1, 110, 80, 290, 90, 'Figure 0: over')", "(1, 400, 520, 500, 560, 'Figure 2: beside')", "(1, 100, 745, 300, 760, 'Figure 3: far')", "(2, 400, 10, 450, 30, 'Figure 9: too far')",
    more=f"""SELECT CAST(1000 + conv_id AS INT), CAST(length(text) % 400 AS INT), CAST(turn * 60 + length(text) % 50 AS INT), CAST(length(text) % 400 + 80 AS INT), CAST(turn * 60 + length(text) % 50 + 12 AS INT), 'Figure ' || CAST(turn AS STRING) || ': ' || substring({_FLAT}, 1, 30) {_SAID} AND turn % 2 = 1""",
)
_BOX = "struct(double(x0) as x0, double(y0) as y0, double(x1) as x1, double(y1) as y1) as box"


@register(
    "nearest_caption",
    f"""WITH {FIGURES}, {CAPTIONS}, d AS (SELECT f.page_id, figure_no, c.text, CASE WHEN c.x0 < f.x1 AND c.x1 > f.x0 THEN CASE WHEN greatest(0, c.y0 - f.y1, f.y0 - c.y1) <= 40 THEN greatest(0, c.y0 - f.y1, f.y0 - c.y1) END
  WHEN c.y0 < f.y1 AND c.y1 > f.y0 AND greatest(c.x0 - f.x1, f.x0 - c.x1) <= 250 THEN greatest(c.x0 - f.x1, f.x0 - c.x1) END AS d FROM fg f JOIN cp c USING (page_id)),
m AS (SELECT page_id, figure_no, arg_min(text, {{'d': d, 't': text}}) AS caption FROM d WHERE d IS NOT NULL GROUP BY ALL) SELECT page_id, figure_no, coalesce(caption, '') AS caption FROM fg LEFT JOIN m USING (page_id, figure_no)""",
)
def nearest_caption(spark, sf_dir: str) -> DataFrame:
    """[J2] The nearest caption of every figure."""
    figs, caps = frames(spark, FIGURES, CAPTIONS, sf_dir=sf_dir)
    return figures.nearest_captions(figs.selectExpr("page_id", "figure_no", _BOX), caps.selectExpr("page_id", "text", _BOX))


@register("caption_assignment", "SELECT * FROM (VALUES (1, 0, 0), (1, 1, 1), (1, 2, -1)) t(page_id, caption_no, group_no)")
def caption_assignment(spark, sf_dir: str) -> DataFrame:
    """[J3, W7, X30] Drawing clusters of a page, and captions that take them greedily in order."""
    box = lambda *v: "named_struct(" + ", ".join(f"'{n}', double({x})" for n, x in zip(("x0", "y0", "x1", "y1"), v, strict=True)) + ")"
    rects = f"array({box(0, 0, 50, 50)}, {box(60, 10, 90, 40)}, {box(0, 200, 50, 250)}, {box(10, 270, 40, 290)})"
    caps = f"array({box(0, 55, 90, 60)}, {box(0, 60, 90, 64)}, {box(500, 900, 600, 910)})".replace("double(60), 'x1'", "double(300), 'x1'").replace("double(64)", "double(304)")
    df = spark.sql(f"SELECT 1 AS page_id, {rects} AS rects, {caps} AS caps")
    return df.select("page_id", F.posexplode(figures.assign_captions(F.col("caps"), figures.clusters(F.col("rects")))).alias("caption_no", "group_no"))


CHOICES = values("ch", "section, ord, scene, number, reason", "(1, 1, 1, 2, 'good  fit')", "(1, 2, 1, 1, 'second answer')", "(1, 3, 2, 9, 'none')", "(1, 4, 3, 2, 'again')", "(1, 5, 8, 1, 'unknown')", "(1, 6, 4, CAST(NULL AS INT), '')")


@register(
    "choice_validation",
    "SELECT * FROM (VALUES (1, 1, 'b.png', 'good fit'), (1, 2, NULL, 'Kept the generated picture: there is no book image 9.'), (1, 3, NULL, 'Kept the generated picture: book image 2 is shown in another scene.'), (1, 4, NULL, '-')) t(section, scene, book_image, reason)",
)
def choice_validation(spark, sf_dir: str) -> DataFrame:
    """[J12, F11, U4] What a model's choices of book images come to."""
    scenes, images, choices = frames(
        spark, values("s", "section, scene, kind, book_image", "(1, 1, 'picture', '')", "(1, 2, 'picture', '')", "(1, 3, 'picture', '')", "(1, 4, 'picture', '')", "(1, 5, 'picture', 'z.png')"),
        values("i", "section, position, file, kind, description, caption", "(1, 1, 'a.png', 'photo', 'x', '')", "(1, 2, 'z.png', 'photo', 'x', '')", "(1, 3, 't.png', 'text', 'x', '')", "(1, 4, 'b.png', '', '', 'Figure')"), CHOICES,
    )
    return figures.choose_images(scenes, images, choices)


@register("illustrations_cleaned", "SELECT * FROM (VALUES (1, 'picture', 'a red house', 'zoom_in', 0), (2, NULL, NULL, NULL, -1), (3, NULL, NULL, NULL, -1), (4, 'diagram', '', 'reveal', 2), (5, NULL, NULL, NULL, -1), (6, 'picture', 'a busy street without charts', 'pan', 0)) t(id, kind, prompt, animation, items)")
def illustrations_cleaned(spark, sf_dir: str) -> DataFrame:
    """Illustrations repaired or dropped."""
    item = lambda label, detail, value: f"named_struct('label', '{label}', 'detail', '{detail}', 'value', double({value}))"
    row = lambda i, kind, prompt, animation, type_, items: f"SELECT {i} AS id, named_struct('kind', '{kind}', 'prompt', '{prompt}', 'animation', '{animation}', 'type', '{type_}', 'caption', '', 'items', array({', '.join(items) or item('', '', 0)})) AS ill"
    rows = [
        row(1, "picture", "a  red house", "spin", "", []), row(2, "picture", "a flow chart of it", "pan", "", []), row(3, "picture", "too few", "pan", "", []),
        row(4, "diagram", "x", "pan", "bars", [item(" a ", "", 3), item("b", "", 0), item("c", "", -1), item(" ", "", 5)]), row(5, "diagram", "", "reveal", "cycle", [item("a", "", 1), item("b", "", 1)]), row(6, "picture", "a busy street without charts", "pan", "", []),
    ]
    df = spark.sql(" UNION ALL ".join(rows)).withColumn("c", figures.clean_illustration(F.col("ill")))
    return df.select("id", "c.kind", "c.prompt", "c.animation", F.when(F.col("c").isNotNull(), F.size("c.items")).otherwise(-1).alias("items"))


VOICES = values("vo", "id, name, quality, code, family, size_bytes, num_speakers", "('cs_CZ-jirka-medium', 'jirka', 'medium', 'cs_CZ', 'cs', 63000000, 1)", "('hu_HU-anna-low', 'anna', 'low', 'hu_HU', 'hu', 0, 1)", "('hu_HU-imre-medium', 'imre', 'medium', 'hu_HU', 'hu', 60000000, 1)", "('hu_HU-multi-medium', 'multi', 'medium', 'hu_HU', 'hu', 1, 4)",
    more=f"""SELECT 'nl_NL-v' || CAST(p_partkey AS STRING) || '-medium', 'v' || CAST(p_partkey AS STRING), CASE p_partkey % 2 WHEN 0 THEN 'medium' ELSE 'low' END, 'nl_NL', 'nl', CAST(p_partkey % 4 * 10000000 AS INT), 1 FROM part""",
)


@register("default_voice", "SELECT * FROM (VALUES ('cs', 'cs_CZ-jirka-medium'), ('hu', 'hu_HU-imre-medium'), ('xx', 'en_US-ryan-high'), ('de', 'en_US-ryan-high')) t(language, voice)")
def default_voice(spark, sf_dir: str) -> DataFrame:
    """[A10] The default voice of languages."""
    wanted, catalogue, preferred = frames(spark, values("w", "language", "('cs')", "('hu')", "('xx')", "('de')"), VOICES, values("p", "language, id", "('cs', 'cs_CZ-jirka-medium')", "('de', 'de_DE-thorsten-high')"), sf_dir=sf_dir)
    return catalogs.default_voices(wanted, catalogue, preferred, "en_US-ryan-high")


INSTALLED = values("inst", "id", "('hu_HU-anna-low')", "('sk_SK-lili-medium')", more="SELECT CASE p_partkey % 2 WHEN 0 THEN 'nl_NL' ELSE 'nb_NO' END || '-v' || CAST(p_partkey AS STRING) || '-medium' FROM part WHERE p_partkey % 3 = 0")


@register(
    "voice_outer_join",
    f"""WITH {VOICES}, {INSTALLED}, j AS (SELECT coalesce(v.id, i.id) AS id, v.*EXCLUDE(id), i.id IS NOT NULL AS here FROM vo v FULL JOIN inst i ON v.id = i.id), c AS (SELECT *, coalesce(code, string_split(id, '-')[1]) AS c FROM j)
SELECT id, coalesce(name, string_split(id, '-')[2]) || CASE WHEN coalesce(quality, '') <> '' THEN ' · ' || quality ELSE '' END AS name, coalesce(family, string_split(c, '_')[1]) AS language, replace(c, '_', '-') AS locale, CASE WHEN here THEN 'downloaded' WHEN coalesce(size_bytes, 0) > 0 THEN printf('%.0f MB download', size_bytes / 1e6) ELSE '' END AS note FROM c""",
)
def voice_outer_join(spark, sf_dir: str) -> DataFrame:
    """[J10, U2] Voices of the catalogue and those installed."""
    catalogue, installed = frames(spark, VOICES, INSTALLED, sf_dir=sf_dir)
    return catalogs.installed_and_catalogued(catalogue, installed)


CODED = values("cd", "id", "('af_heart')", "('bm_george')", "('ff_siwis')", "('pm_santa')")
register("coded_voices", "SELECT * FROM (VALUES ('af_heart', 'Heart', 'en', 'en-US', 'female'), ('bm_george', 'George', 'en', 'en-GB', 'male'), ('ff_siwis', 'Siwis', 'fr', 'fr-FR', 'female'), ('pm_santa', 'Santa', 'pt', 'pt-BR', 'male')) t(id, name, language, locale, gender)")(on(CODED, catalogs.coded_voices))

SAY = values("sy", "line", "('Anna                de_DE    # Hallo')", "('Zoe (Enhanced)      en_US    # Hello')", "('noise')", "('Daniel              en_GB    # Hello')")


@register("listed_voices", "SELECT * FROM (VALUES ('de', 'Anna'), ('en', 'Zoe (Enhanced)'), ('fr', 'Zoe (Enhanced)')) t(language, voice)")
def listed_voices(spark, sf_dir: str) -> DataFrame:
    """[S14, A11] Voices parsed from a listing, and the default of languages."""
    lines, wanted = frames(spark, SAY, values("w", "language", "('de')", "('en')", "('fr')"))
    return catalogs.marked_default(wanted, catalogs.listed_voices(lines))


ENGINES = values("en", "id, engine, language, voice, rate", "(1, 'kokoro', 'cs', '', CAST(1.25 AS DOUBLE))", "(2, 'kokoro', 'fr', '', CAST(3.0 AS DOUBLE))", "(3, 'edge', 'cs', '', CAST(0.9 AS DOUBLE))", "(4, 'kokoro', 'cs', 'af_heart', CAST(1.0 AS DOUBLE))", "(5, 'macos', 'en', '', CAST(1.1 AS DOUBLE))", "(6, 'piper', 'en', '', CAST(0.1 AS DOUBLE))",
    more=f"""SELECT {_TURN}, CASE turn % 4 WHEN 0 THEN 'kokoro' WHEN 1 THEN 'edge' WHEN 2 THEN 'piper' ELSE 'macos' END, CASE conv_id % 3 WHEN 0 THEN 'cs' WHEN 1 THEN 'fr' ELSE 'de' END, CASE conv_id % 5 WHEN 0 THEN 'v' ELSE '' END, 0.3 + CAST(length(text) % 37 AS DOUBLE) / 11 {_SAID}""",
)
register(
    "engine_choice",
    f"""WITH {ENGINES}, e AS (SELECT *, CASE WHEN engine = 'kokoro' AND language NOT IN ('en', 'es', 'fr', 'hi', 'it', 'pt') AND voice = '' THEN 'piper' ELSE engine END AS uses FROM en)
SELECT id, uses AS engine, CASE uses WHEN 'edge' THEN printf('%+d%%', CAST(round_even((rate - 1) * 100, 0) AS INT)) WHEN 'piper' THEN printf('%.4f', 1 / greatest(0.25, rate)) WHEN 'kokoro' THEN printf('%.4f', least(2.0, greatest(0.5, rate))) ELSE CAST(CAST(round_even(180 * rate, 0) AS INT) AS VARCHAR) END AS rate FROM e""",
)(on(ENGINES, lambda d: d.withColumn("engine", catalogs.engine_for(F.col("engine"), F.col("language"), F.col("voice"))).select("id", "engine", timing.engine_rate(F.col("engine"), F.col("rate")).alias("rate"))))

MODELS = values("mo", "id, name", "(1, 'gemma3')", "(2, 'gemma3:4b')", "(3, 'user/model')", "(4, 'hf.co/org/repo/name:Q4')", "(5, 'host:80/a/b')")
register(
    "model_refs",
    f"""SELECT * FROM (VALUES (1, '{catalogs.DEFAULT_HOST}', 'library', 'gemma3', 'latest', 'gemma3:latest'), (2, '{catalogs.DEFAULT_HOST}', 'library', 'gemma3', '4b', 'gemma3:4b'), (3, '{catalogs.DEFAULT_HOST}', 'user', 'model', 'latest', 'user/model:latest'),
(4, 'hf.co', 'org/repo', 'name', 'Q4', 'hf.co/org/repo/name:Q4'), (5, 'host:80', 'a', 'b', 'latest', 'host:80/a/b:latest')) t(id, host, namespace, name, tag, display)""",
)(on(MODELS, lambda d: d.withColumn("r", catalogs.model_ref(F.col("name"))).select("id", "r.*", catalogs.model_display(F.col("r")).alias("display"))))

MANIFESTS = values("mf", "store, priority, name, digest, size", "('ollama', 1, 'a:1', 'd1', CAST(10 AS BIGINT))", "('cache', 2, 'a:1', 'd1', CAST(10 AS BIGINT))", "('ollama', 1, 'b:1', 'd2', CAST(20 AS BIGINT))", "('cache', 2, 'b:1', 'd2', CAST(20 AS BIGINT))", "('cache', 2, 'c:1', 'd3', CAST(NULL AS BIGINT))", "('cache', 2, 'd:1', 'd9', CAST(1 AS BIGINT))",
    more=f"""SELECT CASE turn WHEN 0 THEN 'ollama' ELSE 'cache' END, CAST(1 + turn AS INT), 'm' || CAST(conv_id AS STRING), 'c' || CAST(conv_id AS STRING), CAST(length(text) AS BIGINT) {_SAID} AND turn < 2""",
)
BLOBS = values("bl", "store, digest, bytes", "('ollama', 'd1', CAST(10 AS BIGINT))", "('cache', 'd1', CAST(10 AS BIGINT))", "('ollama', 'd2', CAST(19 AS BIGINT))", "('cache', 'd2', CAST(20 AS BIGINT))", "('cache', 'd3', CAST(5 AS BIGINT))",
    more=f"""SELECT CASE turn WHEN 0 THEN 'ollama' ELSE 'cache' END, 'c' || CAST(conv_id AS STRING), CAST(length(text) + conv_id % 2 * (1 - turn) + (conv_id % 3) * turn AS BIGINT) {_SAID} AND turn < 2""",
)


@register("model_lookup", f"WITH {MANIFESTS}, {BLOBS}, f AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY priority) AS k FROM mf JOIN bl USING (store, digest) WHERE bytes = coalesce(size, bytes)) SELECT name, store, digest, bytes AS size FROM f WHERE k = 1")
def model_lookup(spark, sf_dir: str) -> DataFrame:
    """[J8, U3, S15] Models that are there with the size stated, first store first."""
    return catalogs.local_models(*frames(spark, MANIFESTS, BLOBS, sf_dir=sf_dir))


_WANTED = "SELECT DISTINCT 'm' || CAST(conv_id AS STRING) FROM conversations WHERE conv_id IS NOT NULL"


@register("missing_models", f"WITH {MANIFESTS}, {BLOBS} SELECT name FROM (SELECT * FROM (VALUES ('a:1'), ('d:1'), ('e:1')) t(name) UNION ALL {_WANTED}) WHERE name NOT IN (SELECT name FROM mf JOIN bl USING (store, digest) WHERE bytes = coalesce(size, bytes))")
def missing_models(spark, sf_dir: str) -> DataFrame:
    """[J9, U4] Recommended models that are not there."""
    manifests, blobs, wanted = frames(spark, MANIFESTS, BLOBS, values("w", "name", "('a:1')", "('d:1')", "('e:1')", more=_WANTED), sf_dir=sf_dir)
    return catalogs.missing_models(wanted, catalogs.local_models(manifests, blobs))


REGISTRY = values("rg", "model, path, size", "('m', 'a', CAST(10 AS BIGINT))", "('m', 'b', CAST(20 AS BIGINT))", "('n', 'c', CAST(5 AS BIGINT))",
    more=f"""SELECT 'm' || CAST(conv_id AS STRING), 'p' || CAST(conv_id AS STRING) || '_' || CAST(turn AS STRING), CAST(length(text) AS BIGINT) {_SAID}""",
)


PRESENT = values(
    "p", "path, size", "('a', CAST(10 AS BIGINT))", "('b', CAST(19 AS BIGINT))",
    more=f"""SELECT 'p' || CAST(conv_id AS STRING) || '_' || CAST(turn AS STRING), CAST(length(text) + CASE conv_id % 3 WHEN 0 THEN 1 ELSE 0 END AS BIGINT) {_SAID} AND turn % 2 = 0""",
)


@register("download_sizes", f"WITH {REGISTRY}, {PRESENT} SELECT model, CAST(sum(rg.size) AS BIGINT) AS total, CAST(coalesce(sum(rg.size) FILTER (WHERE coalesce(p.size, -1) <> rg.size), 0) AS BIGINT) AS missing FROM rg LEFT JOIN p USING (path) GROUP BY model")
def download_sizes(spark, sf_dir: str) -> DataFrame:
    """[A13, H3, H4] Bytes of models, in all and still missing."""
    registry, present = frames(spark, REGISTRY, PRESENT, sf_dir=sf_dir)
    return catalogs.download_sizes(registry, present)


SECTIONS = values("se", "doc_id, section_no, number, chapter_title", "(1, 1, 2, 'x')", "(1, 2, 0, 'B')", "(1, 3, 9, 'B')", "(1, 4, 0, 'none')",
    more=f"""SELECT CAST(1000 + conv_id AS INT), CAST(turn + 1 AS INT), CAST(CASE turn % 2 WHEN 0 THEN turn + 1 + conv_id % 4 ELSE 0 END AS INT), 'T' || CAST((turn + conv_id) % 5 AS STRING) {_SAID}""",
)
CHAPTERS = values("cs", "doc_id, number, title", "(1, 1, 'A')", "(1, 2, 'B')", "(1, 3, 'B')",
    more=f"""SELECT CAST(1000 + conv_id AS INT), CAST(turn + 1 AS INT), 'T' || CAST(turn % 3 AS STRING) {_SAID}""",
)


@register("section_chapters", f"WITH {SECTIONS}, {CHAPTERS} SELECT s.doc_id, section_no, coalesce(CASE WHEN s.number <> 0 THEN (SELECT min(number) FROM cs c WHERE c.doc_id = s.doc_id AND c.number = s.number) ELSE (SELECT min(number) FROM cs c WHERE c.doc_id = s.doc_id AND c.title = s.chapter_title) END, -1) AS chapter FROM se s")
def section_chapters(spark, sf_dir: str) -> DataFrame:
    """[J5] The chapter of every section."""
    return structure.chapters_of_sections(*frames(spark, SECTIONS, CHAPTERS, sf_dir=sf_dir)).fillna(-1, ["chapter"])


@register("reused_sections", f"WITH {SECTIONS}, {CHAPTERS} SELECT section_no FROM se s WHERE (number <> 0 AND number IN (SELECT number FROM cs c WHERE c.doc_id = s.doc_id)) OR (number = 0 AND chapter_title IN (SELECT title FROM cs c WHERE c.doc_id = s.doc_id))")
def reused_sections(spark, sf_dir: str) -> DataFrame:
    """Sections of a script that the selection keeps."""
    return structure.reused_sections(*frames(spark, SECTIONS, CHAPTERS, sf_dir=sf_dir)).select("section_no")


@register("scene_images", f"WITH {SCENES}, {IMAGES}, s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chapter ORDER BY scene_no) AS k FROM sc), i AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chapter ORDER BY position) AS k FROM im) SELECT s.chapter, s.scene_no, i.file FROM s LEFT JOIN i USING (doc_id, chapter, k)")
def scene_images(spark, sf_dir: str) -> DataFrame:
    """[J14] The k-th scene and the k-th image."""
    scenes, images = frames(spark, SCENES, IMAGES, sf_dir=sf_dir)
    return figures.scene_images(scenes, images).select("chapter", "scene_no", "file")


ILLUSTRATED = values(
    "il", "scene_no, prompt, placement, book_image", "(1, 'p', 'left', 'own.png')", "(2, 'p', 'left', 'gone.png')", "(3, 'p', 'full', '')",
    more=f"""SELECT {_TURN}, 'p' || CAST(length(text) % 90 AS STRING), CASE turn % 2 WHEN 0 THEN 'left' ELSE 'full' END, CASE conv_id % 2 WHEN 0 THEN 'f' || CAST(conv_id AS STRING) || '.png' ELSE '' END {_SAID}""",
)
OWN = values("ow", "file", "('own.png')", more=f"SELECT DISTINCT 'f' || CAST(conv_id AS STRING) || '.png' {_SAID} AND conv_id % 3 = 0")
MADE = values("md", "prompt, placement, file", "('p', 'left', 'made.png')", more=f"SELECT DISTINCT 'p' || CAST(length(text) % 60 AS STRING), 'left', 'm' || CAST(length(text) % 60 AS STRING) || '.png' {_SAID}")


@register("picture_files", f"WITH {ILLUSTRATED}, {OWN}, {MADE} SELECT scene_no, coalesce(ow.file, md.file) AS file FROM il LEFT JOIN ow ON ow.file = book_image LEFT JOIN md USING (prompt, placement)")
def picture_files(spark, sf_dir: str) -> DataFrame:
    """[J7, B4] The file of every illustration."""
    return figures.picture_files(*frames(spark, ILLUSTRATED, OWN, MADE, sf_dir=sf_dir)).select("scene_no", "file")


TAGS = values("tg", "id, title, album, track, author", "(1, 'T', 'A', 3, 'X Y')", "(2, 'T', 'A', 4, '')",
    more=f"""SELECT {_TURN}, substring(text, 1, 20), coalesce(role, 'r'), CAST(turn AS INT), CASE conv_id % 3 WHEN 0 THEN '' ELSE 'A. Writer' END {_SAID}""",
)
register("audio_tags", f"WITH {TAGS} SELECT id, k AS tag, v AS value FROM (SELECT id, unnest(['title', 'album', 'track', 'genre', 'artist']) AS k, unnest([title, album, CAST(track AS VARCHAR), 'Audiobook', nullif(author, '')]) AS v FROM tg) WHERE v IS NOT NULL")(
    on(TAGS, lambda d: d.select("id", F.explode(media.audio_tags(F.col("title"), F.col("album"), F.col("track"), F.col("author"))).alias("tag", "value")))
)

PLAIN = values("pn", "id, v", "(1, CAST(1234567.5 AS DOUBLE))", "(2, CAST(12.0 AS DOUBLE))", "(3, CAST(0.256 AS DOUBLE))", "(4, CAST(1000 AS DOUBLE))",
    more=f"""SELECT CAST(1000 + o_orderkey AS INT), CAST(o_totalprice AS DOUBLE) * (1 + o_orderkey % 7) FROM orders""",
)
register("plain_numbers", f"WITH {PLAIN} SELECT id, rtrim(rtrim(replace(format('{{:,.2f}}', v), ',', ' '), '0'), '.') AS number FROM pn")(on(PLAIN, lambda d: d.select("id", timing.plain_number(F.col("v")).alias("number"))))

DIAGRAMS = values("dg", "diagram_id, type, item_no, value, captioned", *[f"({d}, '{t}', {k}, CAST({v} AS DOUBLE), {c})" for d, (t, n, c) in enumerate([("flow", 3, "false"), ("bars", 3, "true"), ("comparison", 2, "false"), ("timeline", 4, "true")], 1) for k in range(n) for v in [(k + 1) * 5]],
    more=f"""SELECT CAST(1000 + conv_id AS INT), CASE conv_id % 4 WHEN 0 THEN 'flow' WHEN 1 THEN 'bars' WHEN 2 THEN 'comparison' ELSE 'timeline' END, CAST(turn AS INT), CAST(length(text) AS DOUBLE), conv_id % 3 = 0 {_SAID} AND turn < 5""",
)


@register(
    "diagram_boxes",
    f"""WITH {DIAGRAMS}, r AS (SELECT *, count(*) OVER w AS n, max(value) OVER w AS most, 1600.0 AS w, 900.0 - CASE WHEN captioned THEN 56 ELSE 0 END AS h FROM dg WINDOW w AS (PARTITION BY diagram_id))
SELECT diagram_id, item_no, round(CASE WHEN type = 'bars' THEN 0.0 ELSE item_no * ((w - 40.0 * (n - 1)) / n + 40) END, 4) AS x, round(CASE WHEN type = 'bars' THEN greatest(6.0, w * value / most) ELSE (w - 40.0 * (n - 1)) / n END, 4) AS width, CAST(item_no % 7 AS INT) AS color FROM r""",
)
def diagram_boxes(spark, sf_dir: str) -> DataFrame:
    """[D8, R4, R7, R10-R12] Boxes of diagram items."""
    from leafmill.operators import diagrams

    (rows,) = frames(spark, DIAGRAMS, sf_dir=sf_dir)
    return diagrams.item_boxes(rows, 1600, 900).select("diagram_id", "item_no", F.round("box.x", 4).alias("x"), F.round("box.w", 4).alias("width"), "color")


ANSWERS = values("an", "doc_id, number, segment_no, answer, title", """(1, 1, 1, '{"scenes": [{"title": " A ", "bullets": [" x ", "", "y"], "narration": "one"}, {"title": "B", "bullets": [], "narration": " "}]}', 'T')""", """(1, 2, 1, 'broken', 'Second')""",
    more=f"""SELECT CAST(1000 + conv_id AS INT), CAST(turn + 1 AS INT), 1, CASE turn % 3 WHEN 2 THEN substring(text, 1, 20) ELSE '{{"scenes": [{{"title": " T' || CAST(turn AS STRING) || '", "bullets": ["x"], "narration": " said ' || CAST(length(text) AS STRING) || ' "}}, {{"title": "none", "narration": ""}}]}}' END, 'Chapter ' || CAST(turn AS STRING) {_SAID}""",
)


@register(
    "script_fallback",
    f"""SELECT * FROM (VALUES (1, 1, 'ai', 'A', 'one'), (1, 2, 'extractive', 'Second', 'Some words.')) t(doc_id, number, source, title, narration)
UNION ALL SELECT CAST(1000 + conv_id AS INT), CAST(turn + 1 AS INT), CASE turn % 3 WHEN 2 THEN 'extractive' ELSE 'ai' END, CASE turn % 3 WHEN 2 THEN 'Chapter ' || turn ELSE 'T' || turn END, CASE turn % 3 WHEN 2 THEN 'Some words.' ELSE 'said ' || length(text) END {_SAID}""",
)
def script_fallback(spark, sf_dir: str) -> DataFrame:
    """[B1, B2, F12, D5] A model's scenes, or extractive ones where its answer cannot be used."""
    from leafmill.functions import ports

    (rows,) = frames(spark, ANSWERS, sf_dir=sf_dir)
    sections = rows.withColumn("paragraphs", F.array(F.lit("Some words.")))
    found = ports.scenes_or_fallback(sections, seg.scenes(F.col("title"), F.col("paragraphs")))
    return found.select("doc_id", "number", "source", F.explode("scenes").alias("s")).select("doc_id", "number", "source", "s.title", "s.narration")

CLIPS = values("cl", "doc_id, clip_no, seconds, audio_seconds, narration", "(1, 1, CAST(5.0 AS DOUBLE), CAST(4.0 AS DOUBLE), 'One two. Three.')", "(1, 2, CAST(3.0 AS DOUBLE), CAST(2.0 AS DOUBLE), 'Four.')", "(2, 1, CAST(2.5 AS DOUBLE), CAST(2.0 AS DOUBLE), '')", "(2, 2, CAST(2.5 AS DOUBLE), CAST(2.0 AS DOUBLE), 'Five.')")


@register("clip_cues", "SELECT doc_id, number, CAST(start AS DOUBLE) AS start, CAST(stop AS DOUBLE) AS stop, cue FROM (VALUES (1, 1, 0.2, 2.485714, 'One two.'), (1, 2, 2.485714, 4.2, 'Three.'), (1, 3, 5.2, 7.2, 'Four.'), (2, 1, 2.7, 4.7, 'Five.')) t(doc_id, number, start, stop, cue)")
def clip_cues(spark, sf_dir: str) -> DataFrame:
    """[W5, K6] Cues of several clips of a document."""
    from leafmill.sources import sinks

    (clips,) = frames(spark, CLIPS)
    return sinks.clip_cues(clips).withColumns({c: F.round(c, 6) for c in ("start", "stop")})


LEVELS = values("lv", "doc_id, level", "(1, 1)", "(1, 2)", "(1, 2)", "(1, 3)", "(2, 1)", "(2, 1)", "(3, 2)", "(4, 3)", "(4, 1)",
    more=f"""SELECT CAST(1000 + conv_id AS INT), CAST(1 + length(text) % 4 AS INT) {_SAID}""",
)


@register("heading_levels", f"WITH {LEVELS}, c AS (SELECT doc_id, level, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY level) AS k FROM lv GROUP BY doc_id, level) SELECT doc_id, CASE WHEN max(n) FILTER (WHERE k = 1) = 1 AND count(*) > 1 THEN max(level) FILTER (WHERE k = 2) ELSE min(level) END AS outline, coalesce(min(level) FILTER (WHERE n >= 2), min(level)) AS repeated FROM c GROUP BY doc_id")
def heading_levels(spark, sf_dir: str) -> DataFrame:
    """[A7] The chapter level of documents, by either rule."""
    (levels,) = frames(spark, LEVELS, sf_dir=sf_dir)
    outline = structure.heading_level(levels, "outline").withColumnRenamed("level", "outline")
    return outline.join(structure.heading_level(levels, "repeated").withColumnRenamed("level", "repeated"), "doc_id")


PATHS = values("pa", "id, path, chars, images, drawings", "(1, '/a/b.c/My Book.pdf', 10, 1, 0)", "(2, 'x.txt', 10, 0, 21)", "(3, '\"/q d/e.md\"', 30, 5, 50)", "(4, 'file:///tmp/a%20b.txt', 0, 0, 3)", "(5, '/n/.hidden', 0, 0, 0)",
    more=f"""SELECT {_TURN}, CASE turn % 3 WHEN 0 THEN '/data/' || CAST(conv_id AS STRING) || '/Turn ' || CAST(turn AS STRING) || '.v' || CAST(turn AS STRING) || '.pdf' WHEN 1 THEN '"/q ' || CAST(conv_id AS STRING) || '/e.md"' ELSE 'file:///tmp/a%20' || CAST(conv_id AS STRING) || '.txt' END, CAST(length(text) % 50 AS INT), CAST(conv_id % 2 AS INT), CAST(length(text) % 40 AS INT) {_SAID}""",
)


@register(
    "path_intake",
    f"""WITH {PATHS}, b AS (SELECT *, CASE WHEN path LIKE 'file://%' THEN replace(regexp_replace(path, '^file://[^/]*', ''), '%20', ' ') ELSE trim(path, '"') END AS bare FROM pa)
SELECT id, bare AS path, regexp_replace(bare, '([^/])\\.[^./]*$', '\\1') || '_audio' AS folder, chars < 25 AND (images > 0 OR drawings > 20) AS recognise FROM b""",
)
def path_intake(spark, sf_dir: str) -> DataFrame:
    """[S17, X10, F10] Paths as given, output folders, and pages that need character recognition."""
    from leafmill.sources import sinks

    (rows,) = frames(spark, PATHS, sf_dir=sf_dir)
    rows = rows.withColumn("path", sinks.local_path(F.col("path")))
    return rows.select("id", "path", sinks.output_dir(F.col("path"), "audio").alias("folder"), sinks.needs_recognition(F.col("chars"), F.col("images"), F.col("drawings")).alias("recognise"))


LISTED = values("li", "id, name, language, locale, gender", "('b', 'Beta', 'en', 'en-US', 'female')", "('a', 'Alpha', 'en', 'en-GB', '')", "('c', 'Cesar', 'es', 'es-ES', 'male')")


@register("voice_list", "SELECT * FROM (VALUES ('en', 1, 'b', 'Beta (en-US, female)'), ('en', 2, 'a', 'Alpha (en-GB)'), ('cs', 1, 'b', 'Beta (en-US, female)'), ('cs', 2, 'a', 'Alpha (en-GB)'), ('cs', 3, 'c', 'Cesar (es-ES, male)')) t(wanted, ord, id, label)")
def voice_list(spark, sf_dir: str) -> DataFrame:
    """[F14, O1, X27] Voices on offer for a language, the current one first."""
    (rows,) = frames(spark, LISTED)
    lists = [catalogs.voices_for(rows, lang, "b").select(F.lit(lang).alias("wanted"), "ord", "id", catalogs.voice_label(F.col("name"), F.col("locale"), F.col("gender")).alias("label")) for lang in ("en", "cs")]
    return lists[0].unionByName(lists[1])


LANGUAGES = values("lg", "language", "('en')", "('cs')", "('xx')",
    more=f"""SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL AND lang NOT IN ('en', 'cs', 'xx')""",
)
_NAMED = ", ".join(f"('{k}', '{v}')" for k, v in C.LANGUAGE_NAMES.items())
_CODED = ", ".join(f"('{k}', '{v}')" for k, v in C.OCR_CODES.items())
register("language_names", f"WITH {LANGUAGES} SELECT language, coalesce(n.name, language) AS name, coalesce(o.code, 'eng') AS ocr FROM lg LEFT JOIN (VALUES {_NAMED}) n(k, name) ON n.k = language LEFT JOIN (VALUES {_CODED}) o(k, code) ON o.k = language")(
    on(LANGUAGES, lambda d: d.select("language", F.coalesce(F.try_element_at(catalogs.text_map(C.LANGUAGE_NAMES), F.col("language")), F.col("language")).alias("name"), F.coalesce(F.try_element_at(catalogs.text_map(C.OCR_CODES), F.col("language")), F.lit("eng")).alias("ocr")))
)
