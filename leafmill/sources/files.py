"""Documents from files: one branch a format, all into one table of chapters."""

from __future__ import annotations

import json
import posixpath
import tomllib
from collections.abc import Iterator
from dataclasses import asdict, dataclass, fields

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import pipelines, structure
from leafmill.scratch import written
from leafmill.sources import markup, pdf

TEXT_FORMATS, PACKED_FORMATS, PAGE_FORMATS = ("txt", "md", "markdown", "text"), ("docx", "epub"), ("pdf",)
CHAPTERS = "doc_id string, number int, title string, paragraphs array<string>, doc_title string, stem string"


class SourceError(ValueError):
    """[H6] A document that cannot be read."""


def decode(raw: bytes) -> str:
    """[S3] Text of a file: UTF-8, UTF-16 with a mark, Central European, else Latin-1."""
    for encoding in ("utf-8-sig", "utf-16", "cp1250", "latin-1"):
        if encoding == "utf-16" and not raw.startswith((b"\xff\xfe", b"\xfe\xff")):
            continue
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", errors="replace")


def file_lines(files: DataFrame) -> DataFrame:
    """[S2, S3] (doc_id, line_no, text, stem, markdown) from (path, content) of text files."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, raw in zip(batch["path"], batch["content"], strict=True):
                lines = decode(bytes(raw)).splitlines() or [""]
                stem, suffix = posixpath.splitext(posixpath.basename(path))
                yield pd.DataFrame({"doc_id": path, "line_no": range(len(lines)), "text": lines, "stem": stem, "markdown": suffix.lower() in (".md", ".markdown")})

    return files.select("path", "content").mapInPandas(parse, "doc_id string, line_no int, text string, stem string, markdown boolean")


def packed_chapters(files: DataFrame) -> DataFrame:
    """[S4, S5] Chapters from (path, content) of word-processor files and e-books; a file that cannot be read is one row with ``error``."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, raw in zip(batch["path"], batch["content"], strict=True):
                stem, suffix = posixpath.splitext(posixpath.basename(path))
                try:
                    if suffix.lower() == ".docx":
                        title, chapters = markup.docx_chapters(bytes(raw), stem)
                    else:
                        title, _, chapters = markup.epub_chapters(bytes(raw), stem)
                    rows = [(path, k, t, p, title, stem, None) for k, (t, p) in enumerate(chapters, 1)]
                except Exception as e:  # whatever a damaged file makes of its parser: the file is rejected, the others are read
                    rows = [(path, None, None, None, None, stem, f"{type(e).__name__}: {e}"[:300])]
                yield pd.DataFrame(rows, columns=["doc_id", "number", "title", "paragraphs", "doc_title", "stem", "error"])

    return files.select("path", "content").mapInPandas(parse, f"{CHAPTERS}, error string")


PICTURES = "doc_id string, author string, number int, position int, file string, caption string, content binary"


def packed_pictures(files: DataFrame) -> DataFrame:
    """[S4, S5, X29, K5] The pictures of word-processor files and e-books with their chapters' numbers and captions; a row without a picture tells the author of each file.

    Files that cannot be read have no rows here; :func:`packed_chapters` says what is wrong with them.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, raw in zip(batch["path"], batch["content"], strict=True):
                stem, suffix = posixpath.splitext(posixpath.basename(path))
                try:
                    read = markup.docx_contents if suffix.lower() == ".docx" else markup.epub_contents
                    _, author, _, pictures = read(bytes(raw), stem)
                except Exception:  # noqa: S112  a damaged file, told of by packed_chapters
                    continue
                rows = [(path, author, None, None, None, None, None), *((path, author, n, k, name, caption, data) for k, (n, name, caption, data) in enumerate(pictures, 1))]
                yield pd.DataFrame(rows, columns=["doc_id", "author", "number", "position", "file", "caption", "content"]).astype({"number": "Int32", "position": "Int32"})

    return files.select("path", "content").mapInPandas(parse, PICTURES)


def page_chapters(files: DataFrame) -> DataFrame:
    """[S6] Chapters from (path, content) of PDF files, by outline or large headings; a file that cannot be read is one row with ``error``."""
    parts = pdf.file_parts(files)
    lines, _ = written(pdf.page_marks(parts).where("kind = 'line'").select("doc_id", "page", "line_no", "text", "size", "bold", "block_start"), "lines")
    outline = parts.where("kind = 'outline'").select("doc_id", "ord", "level", "title", (F.col("page") + 1).alias("page"))
    stem = F.regexp_replace(F.element_at(F.split("doc_id", "/"), -1), r"\.[^.]*$", "")
    titles = parts.where("kind = 'document'").select("doc_id", F.coalesce(F.nullif("title", F.lit("")), F.translate(stem, "_", " ")).alias("doc_title"), stem.alias("stem"))
    found = pipelines.pdf_chapters(lines, outline, titles).select("doc_id", "number", "title", "paragraphs", "doc_title", "stem", F.lit(None).cast("string").alias("error"))
    rejects = parts.where("kind = 'reject'").select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (("number", "int"), ("title", "string"), ("paragraphs", "array<string>"), ("doc_title", "string"))], stem.alias("stem"), "error")
    return found.unionByName(rejects)


def documents_and_rejects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """[S1, F9] Cleaned chapters of all documents below ``path`` (a folder, file or pattern), and (doc_id, error) of those that cannot be read.

    Only the formats that occur are read by their parsers; another suffix raises. A document without
    chapters has no rows. Parsed chapters are written once; a damaged file stops no other.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    known = [r.suffix for r in files.select(suffix.alias("suffix")).distinct().limit(100).collect()]
    if odd := sorted(set(known) - {*TEXT_FORMATS, *PACKED_FORMATS, *PAGE_FORMATS}):
        raise SourceError(f"unsupported formats: {', '.join(odd)}")
    parts = []
    if set(known) & set(TEXT_FORMATS):
        parts.append(structure.text_chapters(file_lines(files.where(suffix.isin(*TEXT_FORMATS)))).withColumn("error", F.lit(None).cast("string")))
    for formats, read in ((PACKED_FORMATS, packed_chapters), (PAGE_FORMATS, page_chapters)):
        if set(known) & set(formats):
            parts.append(read(files.where(suffix.isin(*formats))))
    out = spark.createDataFrame([], f"{CHAPTERS}, error string")
    for part in parts:
        out = out.unionByName(part.withColumn("number", F.col("number").cast("int")).select(*out.columns))
    rows, _ = written(out, "chapters")
    chapters = rows.where("error is null").drop("error")
    keep = structure.strip_licence(chapters.select("doc_id", F.col("number").alias("chapter_no"), "title", F.posexplode("paragraphs").alias("para_no", "text")))
    kept = keep.groupBy("doc_id", F.col("chapter_no").alias("number")).agg(F.transform(F.array_sort(F.collect_list(F.struct("para_no", "text"))), lambda x: x["text"]).alias("paragraphs"))
    return structure.postprocess(chapters.drop("paragraphs").join(kept, ["doc_id", "number"])), rows.where("error is not null").select("doc_id", "error")


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """[S1, F9] The chapters of :func:`documents_and_rejects`; files that cannot be read are left out."""
    return documents_and_rejects(spark, path)[0]


SCRIPT = (
    "title string, language string, sections array<struct<chapter_title:string,number:int,source:string,"
    "scenes:array<struct<title:string,bullets:array<string>,narration:string,illustration:struct<kind:string,placement:string,animation:string,prompt:string,book_image:string>>>>>"
)


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    """[S11, X31] Slide scripts from JSON files; fields that are absent are null."""
    return spark.read.schema(SCRIPT).option("multiLine", "true").json(path)


def write_scripts(scripts: DataFrame, path: str) -> None:
    """[K3, K13] Slide scripts as JSON, a document a line."""
    scripts.write.json(path)


def document_json(chapters: DataFrame) -> DataFrame:
    """[K1] (doc_id, json): title and chapters of each document, with paragraphs."""
    rows = chapters.groupBy("doc_id").agg(F.first("doc_title").alias("title"), F.array_sort(F.collect_list(F.struct("number", "title", "paragraphs"))).alias("c"))
    listed = F.transform("c", lambda c: F.struct(c["title"].alias("title"), c["paragraphs"].alias("paragraphs")))
    return rows.select("doc_id", F.to_json(F.struct("title", listed.alias("chapters"))).alias("json"))


def document_text(chapters: DataFrame) -> DataFrame:
    """[K1] (doc_id, text): chapters as headings and paragraphs."""
    body = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.array_join("paragraphs", "\n\n"))
    rows = chapters.select("doc_id", "number", body.alias("body")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("number", "body"))).alias("c"))
    return rows.select("doc_id", F.array_join(F.transform("c", lambda c: c["body"]), "\n\n").alias("text"))


@dataclass
class Settings:
    """[S10, K10] Options of the pipelines, kept as TOML; values of a wrong type are ignored."""

    max_minutes: float = 10.0
    rate: float = 1.0
    engine: str = "piper"
    voice: str = ""
    language: str = ""
    ocr: bool = True

    @classmethod
    def load(cls, text: str) -> Settings:
        try:
            found = tomllib.loads(text.replace("= True", "= true").replace("= False", "= false"))
        except tomllib.TOMLDecodeError:
            found = {}
        out = cls()
        for f in fields(cls):
            value, kind = found.get(f.name), type(getattr(out, f.name))
            if kind is float and type(value) is int:
                value = float(value)
            if type(value) is kind:
                setattr(out, f.name, value)
        return out

    def dump(self) -> str:
        return "".join(f"{k} = {json.dumps(v, ensure_ascii=False)}\n" for k, v in asdict(self).items())
