"""Queries over PDF files made of ``documents``: every text is laid out as a file, and what is read back is compared with the text."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text
from leafmill.memory import give_back
from leafmill.operators import figures
from leafmill.plans.catalog import register
from leafmill.session import table
from leafmill.sources import pdf

#: Layout of the files: lines of a page, of a block; every so manieth line is bold, and has a box.
PAGE, BLOCK, BOLD, BOXED = 40, 5, 7, 8


def _object(out: list[bytes], places: list[int], body: bytes) -> None:
    places.append(sum(map(len, out)))
    out.append(b"%d 0 obj\n%s\nendobj\n" % (len(places), body))


def _stream(data: bytes, more: bytes = b"") -> bytes:
    packed = zlib.compress(data, 1)
    return b"<< /Filter /FlateDecode /Length %d %s >>\nstream\n%s\nendstream" % (len(packed), more, packed)


def file_of(lines: list[str], title: str) -> bytes:
    """A PDF file with one line below the other: a large first line on each page, a gap behind each block, an outline of the first lines."""
    chars = {c: k for k, c in enumerate(sorted({c for line in lines for c in line}), 1)}
    codes = {ord(c): "%04X" % k for c, k in chars.items()}
    show = lambda s: b"<" + s.translate(codes).encode() + b"> Tj"
    pages = [lines[k : k + PAGE] for k in range(0, len(lines), PAGE)] or [[]]
    named = [b"<%04X> <%s>" % (k, c.encode("utf-16-be", "surrogatepass").hex().encode()) for c, k in chars.items()]
    table_of = b"begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange " + b" ".join(b"%d beginbfchar %s endbfchar" % (len(named[k : k + 100]), b" ".join(named[k : k + 100])) for k in range(0, len(named), 100)) + b" endcmap"
    out, places = [b"%PDF-1.7\n"], []
    first = 10  # number of the first page's object
    shown = lambda s: b"<FEFF" + s.encode("utf-16-be", "surrogatepass").hex().encode() + b">"
    heads = [k for k, p in enumerate(pages) if p]
    entry = first + 2 * len(pages)
    _object(out, places, b"<< /Type /Catalog /Pages 2 0 R /Outlines 9 0 R >>")
    _object(out, places, b"<< /Type /Pages /MediaBox [0 0 595 842] /Count %d /Kids [%s] >>" % (len(pages), b" ".join(b"%d 0 R" % (first + 2 * k) for k in range(len(pages)))))
    _object(out, places, b"<< /Title %s /Author (Leaf \\(mill\\)) >>" % shown(title))
    for bold in (b"", b"-Bold"):
        _object(out, places, b"<< /Type /Font /Subtype /Type0 /BaseFont /Plain%s /Encoding /Identity-H /DescendantFonts [%d 0 R] /ToUnicode 8 0 R >>" % (bold, 6 if not bold else 7))
    for bold in (b"", b"-Bold"):
        _object(out, places, b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Plain%s /DW 500 /W [1 [250 250] 5 9 400] >>" % bold)
    _object(out, places, _stream(table_of))
    _object(out, places, b"<< /First %d 0 R /Last %d 0 R >>" % (entry, entry + len(heads) - 1) if heads else b"<< >>")
    for k, page in enumerate(pages):
        _object(out, places, b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /R 4 0 R /B 5 0 R >> >> >>" % (first + 2 * k + 1))
        content = []
        for i, line in enumerate(page):
            size, font = (18 if i == 0 else 11), (b"B" if (k * PAGE + i) % BOLD == BOLD - 1 else b"R")
            y = 800 - 14 * i - 14 * (i // BLOCK)
            # every other line has its size in the matrix
            content.append(b"BT /%s %d Tf 1 0 0 1 72 %d Tm %s ET" % (font, size, y, show(line)) if i % 2 else b"BT /%s 1 Tf %d 0 0 %d 72 %d Tm %s ET" % (font, size, size, y, show(line)))
            if i % BOXED == BOXED - 1:
                content.append(b"q 1 0 0 1 10 20 cm 0 %d %d 8 re S Q" % (y - 20, 20 + len(line) % 300))
        _object(out, places, _stream(b"\n".join(content)))
    for n, k in enumerate(heads):
        following = b"/Next %d 0 R" % (entry + n + 1) if n + 1 < len(heads) else b""
        _object(out, places, b"<< /Title %s /Dest [%d 0 R /Fit] %s >>" % (shown(pages[k][0][:60]), first + 2 * k, following))
    at = sum(map(len, out))
    out.append(b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R /Info 3 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(places) + 1, b"".join(b"%010d 00000 n \n" % p for p in places), len(places) + 1, at))
    return b"".join(out)


def pdf_files(documents: DataFrame) -> DataFrame:
    """(path, content): each document as a PDF file; null where the text is null."""
    lines = F.filter(F.transform(F.split("text", "\n"), text.strip), lambda x: x != "")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for low in range(0, batch.num_rows, 100):
                part = batch.slice(low, 100)
                made = [None if x is None else file_of(x, f"Document {i}") for i, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], ["path", "content"])
            give_back()

    return documents.select(F.col("doc_id").cast("string").alias("path"), lines.alias("lines")).mapInArrow(batches, "path string, content binary")


def _parts(spark, sf_dir: str) -> DataFrame:
    return pdf.file_parts(pdf_files(table(spark, sf_dir, "documents")))


_LINES = f"""lines AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS n, line FROM (
  SELECT doc_id, k, trim(l[k]) AS line FROM (SELECT *, unnest(range(1, len(l) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))) WHERE line <> '')"""


@register(
    "pdf_lines",
    f"WITH {_LINES} SELECT doc_id, CAST(n // {PAGE} AS INT) AS page, CAST(n % {PAGE} AS INT) AS line_no, line AS text, CASE WHEN n % {PAGE} = 0 THEN 18.0::DOUBLE ELSE 11.0 END AS size, "
    f"n % {BOLD} = {BOLD - 1} AS bold, n % {PAGE} % {BLOCK} = 0 AS block_start FROM lines",
)
def pdf_lines(spark, sf_dir: str) -> DataFrame:
    """[S6, S7] Every document as a PDF file, read back as lines with page, size, weight and blocks."""
    lines = pdf.page_marks(_parts(spark, sf_dir)).where("kind = 'line'")
    return lines.select(F.col("doc_id").cast("long").alias("doc_id"), "page", "line_no", "text", F.round("size", 1).alias("size"), "bold", "block_start")


@register(
    "pdf_outline",
    f"WITH {_LINES} SELECT doc_id, CAST(n // {PAGE} AS INT) AS page, CAST(n // {PAGE} AS INT) AS ord, 1 AS level, line[1:60] AS title, 'Document ' || doc_id AS doc_title, 'Leaf (mill)' AS author FROM lines WHERE n % {PAGE} = 0",
)
def pdf_outline(spark, sf_dir: str) -> DataFrame:
    """[S6, J4] Outline, title and author of every PDF file."""
    parts = _parts(spark, sf_dir)
    info = parts.where("kind = 'document'").select("doc_id", F.col("title").alias("doc_title"), "author")
    return parts.where("kind = 'outline'").select("doc_id", "page", "ord", "level", "title").join(info, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))


@register(
    "pdf_drawings",
    f"WITH {_LINES}, b AS (SELECT doc_id, n // {PAGE} AS page, n % {PAGE} AS i, length(line) AS chars FROM lines WHERE n % {PAGE} % {BOXED} = {BOXED - 1}) "
    f"SELECT doc_id, CAST(page AS INT) AS page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY i) - 1 AS INT) AS drawing_no, 10.0::DOUBLE AS x0, CAST(30 + chars % 300 AS DOUBLE) AS x1, "
    f"CAST(842 - 8 - (800 - 14 * i - 14 * (i // {BLOCK})) AS DOUBLE) AS y0, CAST(842 - (800 - 14 * i - 14 * (i // {BLOCK})) AS DOUBLE) AS y1 FROM b",
)
def pdf_drawings(spark, sf_dir: str) -> DataFrame:
    """[S9] Boxes of the painted paths of every page."""
    found = pdf.page_marks(_parts(spark, sf_dir)).where("kind = 'drawing'")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "page", F.col("line_no").alias("drawing_no"), *[F.round(c, 6).alias(c) for c in ("x0", "x1", "y0", "y1")])


@register("pdf_rejects", "SELECT doc_id, CASE WHEN text IS NULL THEN 'null' ELSE 'damaged' END AS what FROM documents")
def pdf_rejects(spark, sf_dir: str) -> DataFrame:
    """[S1, S6] Every file with its head cut off, or null: each becomes a row of the rejects, and none stops the others."""
    docs = table(spark, sf_dir, "documents")
    cut = pdf_files(docs).select("path", F.expr("substring(content, 9, length(content))").alias("content"))
    rejects = pdf.file_parts(cut).where("kind = 'reject'")
    return rejects.join(docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").isNull().alias("none")), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("none"), "null").otherwise("damaged").alias("what"))


_FOLD = """list_reduce(list_prepend(CAST([] AS STRUCT(x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[]), list_transform(r, lambda x: [x])), lambda g, s: CASE WHEN len(list_filter(g, lambda q: near(q, s[1]))) = 0 THEN list_append(g, s[1])
  ELSE list_transform(g, lambda q, i: CASE WHEN i = list_position(list_transform(g, lambda p: near(p, s[1])), true) THEN
    {'x0': least(q.x0, s[1].x0), 'y0': least(q.y0, s[1].y0), 'x1': greatest(q.x1, s[1].x1), 'y1': greatest(q.y1, s[1].y1)} ELSE q END) END)"""
for _q, _r in (("near(q, s[1])", "greatest(0, greatest(q.x0, s[1].x0) - least(q.x1, s[1].x1)) <= 25 AND greatest(0, greatest(q.y0, s[1].y0) - least(q.y1, s[1].y1)) <= 25"), ("near(p, s[1])", "greatest(0, greatest(p.x0, s[1].x0) - least(p.x1, s[1].x1)) <= 25 AND greatest(0, greatest(p.y0, s[1].y0) - least(p.y1, s[1].y1)) <= 25")):
    _FOLD = _FOLD.replace(_q, _r)


@register(
    "drawing_groups",
    f"WITH {_LINES}, b AS (SELECT doc_id, list({{'x0': CAST(length(line) * 37 % 300 AS DOUBLE), 'y0': CAST(n * 53 % 420 AS DOUBLE), 'x1': CAST(length(line) * 37 % 300 + 3 + n % 19 AS DOUBLE), 'y1': CAST(n * 53 % 420 + 5 + n % 11 AS DOUBLE)}} "
    "ORDER BY n * 53 % 420, length(line) * 37 % 300, length(line) * 37 % 300 + 3 + n % 19, n % 11) AS r FROM lines GROUP BY doc_id), "
    f"g AS (SELECT doc_id, {_FOLD} AS g FROM b) SELECT doc_id, CAST(k - 1 AS INT) AS group_no, g[k].x0 AS x0, g[k].y0 AS y0, g[k].x1 AS x1, g[k].y1 AS y1 FROM (SELECT *, unnest(range(1, len(g) + 1)) AS k FROM g)",
)
def drawing_groups(spark, sf_dir: str) -> DataFrame:
    """[W7, S9, X30] Drawings that stand close together form one figure; a box for each line of a document, placed by its length and number."""
    lines = F.filter(F.transform(F.split("text", "\n"), text.strip), lambda x: x != "")
    boxes = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines).alias("n", "line")).select(
        "doc_id", (F.length("line") * 37 % 300).cast("double").alias("x0"), (F.col("n") * 53 % 420).cast("double").alias("y0"), (F.length("line") * 37 % 300 + 3 + F.col("n") % 19).cast("double").alias("x1"), (F.col("n") * 53 % 420 + 5 + F.col("n") % 11).cast("double").alias("y1")
    )
    return figures.drawing_groups(boxes, ["doc_id"])
