"""Shared pieces of the DuckDB counterparts: common table expressions over ``documents``."""

from __future__ import annotations

from leafmill import constants as C

#: (doc_id, line_no, line)
LINES = "lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"

#: (doc_id, para_no, text): lines joined, a short line that ends like a sentence ending a paragraph.
PARAGRAPHS = (
    LINES
    + """,
typical AS (SELECT doc_id, list_sort(list(length(rtrim(line))))[CAST(floor(count(*) * 0.8) AS INT) + 1] AS typical FROM lines WHERE trim(line) <> '' GROUP BY doc_id),
flagged AS (SELECT l.doc_id, line_no, trim(line) AS line, trim(line) = '' AS blank,
            regexp_matches(trim(line), '[.!?:…"”]$') AND length(trim(line)) < typical * 0.75 AS ends FROM lines l JOIN typical USING (doc_id)),
numbered AS (SELECT *, coalesce(sum(CASE WHEN blank OR ends THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM flagged),
joined AS (SELECT doc_id, g, trim(regexp_replace(string_agg(line, ' ' ORDER BY line_no), '[ \t]+', ' ', 'g')) AS text FROM numbered
           WHERE NOT blank AND NOT regexp_matches(line, '(?i)^(page\\s*)?\\d{1,4}(\\s*(/|of)\\s*\\d{1,4})?$') GROUP BY doc_id, g),
paragraphs AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS para_no, text FROM joined WHERE text <> '')"""
)

_ABBREVIATIONS = ", ".join(f"'{a}'" for a in C.ABBREVIATIONS)

#: (doc_id, para_no, sent_no, text); needs PARAGRAPHS. The capital behind a boundary is consumed and put back.
SENTENCES = f"""
pieces AS (SELECT doc_id, para_no, unnest(p) AS piece, unnest(range(1, len(p) + 1)) AS k FROM (SELECT doc_id, para_no, string_split(regexp_replace(text,
           '([.!?…]+["''”’»)\\]]*)\\s+(["''“‘«(\\[]?[A-ZÀ-ÖØ-ÞĀ-Ž0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS p FROM paragraphs)),
runs AS (SELECT *, lower(rtrim(string_split(piece, ' ')[-1], '.')) AS last FROM pieces),
grouped AS (SELECT *, coalesce(sum(CASE WHEN last IN ({_ABBREVIATIONS}) OR regexp_full_match(last, '\\p{{L}}') THEN 0 ELSE 1 END)
            OVER (PARTITION BY doc_id, para_no ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM runs),
sentences AS (SELECT doc_id, para_no, row_number() OVER (PARTITION BY doc_id, para_no ORDER BY g) - 1 AS sent_no, string_agg(piece, ' ' ORDER BY k) AS text FROM grouped GROUP BY doc_id, para_no, g)"""

#: (lang, ord, word)
STOPS = "stops AS (SELECT DISTINCT * FROM (VALUES {}) t(lang, ord, word))".format(
    ", ".join(f"('{lang}', {k}, '{w}')" for k, (lang, words) in enumerate(C.STOP_WORDS.items()) for w in words.split())
)

#: (doc_id, language); needs STOPS.
LANGUAGE = """
words AS (SELECT doc_id, unnest(regexp_extract_all(lower(left(text, 20000)), '[\\p{L}\\p{Nl}\\p{No}]+')) AS word FROM documents),
scores AS (SELECT doc_id, lang, ord, count(*) AS n FROM words JOIN stops USING (word) GROUP BY doc_id, lang, ord),
best AS (SELECT doc_id, arg_max(lang, n * 100 - ord) AS lang FROM scores GROUP BY doc_id),
language AS (SELECT d.doc_id, coalesce(b.lang, 'en') AS language FROM documents d LEFT JOIN best b USING (doc_id))"""


def duration(seconds: str) -> str:
    """SQL of a formatted duration."""
    n = f"CAST(round_even({seconds}, 0) AS BIGINT)"
    return (
        f"CASE WHEN {n} >= 3600 THEN printf('%d h %02d min', {n} // 3600, {n} % 3600 // 60) WHEN {n} >= 600 THEN printf('%d min', {n} // 60) "
        f"WHEN {n} >= 60 THEN printf('%d min %02d s', {n} // 60, {n} % 60) ELSE printf('%d s', {n}) END"
    )


def srt(seconds: str) -> str:
    """SQL of a subtitle time."""
    ms = f"CAST(round_even(({seconds}) * 1000, 0) AS BIGINT)"
    return f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"
