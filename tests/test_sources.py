"""Readers on files made here, settings, streaming and ports."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from leafmill.functions import ports
from leafmill.operators import structure
from leafmill.sources import files, markup
from leafmill.streaming import documents as stream

PROSE = "It was a plain day and nothing of note came to pass in the long street by the river where the old mill stood. " * 4


def book(path, name, body):
    with open(os.path.join(path, name), "wb") as f:
        f.write(body if isinstance(body, bytes) else body.encode())


def docx(paras, title):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    ps = "".join(f"<w:p>{f'<w:pPr><w:pStyle w:val="{s}"/></w:pPr>' if s else ''}<w:r><w:t>{t}</w:t></w:r></w:p>" for s, t in paras)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{ps}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{w}"><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="H2"><w:name w:val="Nadpis 2"/></w:style></w:styles>')
        z.writestr("docProps/core.xml", f'<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{title}</dc:title></c>')
    return out.getvalue()


def epub():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>')
        z.writestr("OEBPS/c.opf", '<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>The Title</dc:title><dc:creator>A. Writer</dc:creator></metadata><manifest><item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("OEBPS/toc.ncx", '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>One</text></navLabel><content src="a.xhtml"/></navPoint><navPoint><navLabel><text>Two</text></navLabel><content src="b.xhtml#second"/></navPoint></navMap></ncx>')
        z.writestr("OEBPS/a.xhtml", f"<html><body><h1>One</h1><p>{PROSE}</p></body></html>")
        z.writestr("OEBPS/b.xhtml", f"<html><body><p>Still one.</p><h2 id='second'>Two</h2><p>{PROSE}</p></body></html>")
    return out.getvalue()


def test_load_documents(spark, tmp_path):
    book(tmp_path, "my_book.md", f"# My Book\n\n## First\n\nSome **bold** and [a link](x).\n{PROSE}\n\n### Sub\n\n- item\n\n## Second\n\n```\ncode\n```\n{PROSE}\n")
    book(tmp_path, "novel.txt", f"CHAPTER I\n\n{PROSE}\n\nCHAPTER II\n\n{PROSE}\n")
    book(tmp_path, "word.docx", docx([("H1", "Alpha"), ("", PROSE), ("H2", "Part"), ("", "x"), ("H1", "Beta"), ("", PROSE)], "Core"))
    book(tmp_path, "e.epub", epub())
    rows = files.load_documents(spark, f"file://{tmp_path}").collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.number)):
        found.setdefault(os.path.basename(r.doc_id), []).append(r)
    assert [r.title for r in found["my_book.md"]] == ["First", "Second"] and found["my_book.md"][0].doc_title == "My Book"
    assert found["my_book.md"][0].paragraphs[0].startswith("Some bold and a link.") and "Sub" in found["my_book.md"][0].paragraphs
    assert not any("code" == p for p in found["my_book.md"][1].paragraphs)
    assert [r.title for r in found["novel.txt"]] == ["CHAPTER I", "CHAPTER II"]
    assert [r.title for r in found["word.docx"]] == ["Alpha", "Beta"] and "Part" in found["word.docx"][0].paragraphs
    assert [(r.title, len(r.paragraphs)) for r in found["e.epub"]] == [("One", 2), ("Two", 1)] and found["e.epub"][0].doc_title == "The Title"


def test_unsupported_format(spark, tmp_path):
    book(tmp_path, "x.xyz", "a")
    with pytest.raises(files.SourceError, match="xyz"):
        files.load_documents(spark, f"file://{tmp_path}")


@pytest.mark.parametrize(("raw", "want"), [("﻿é".encode(), "é"), ("é".encode("utf-16"), "é"), ("ž".encode("cp1250"), "ž"), (b"plain", "plain")])
def test_decode(raw, want):
    assert files.decode(raw) == want


def test_html_blocks_close_tag_soup():
    found = markup.parse_blocks("<body><p>one<p>two <b>bold<ul><li>item<p>inner</p><li>next</ul><figure><img src=a.png alt=alt><figcaption>Cap</figcaption></figure><script>no</script>")
    assert [(b["tag"], b["text"]) for b in found] == [("p", "one"), ("p", "two bold"), ("li", "item inner"), ("li", "next"), ("img", "Cap")]
    assert markup.parse_blocks(None) == [] and markup.parse_blocks("<p>") == []


def test_docx_levels():
    title, chapters = markup.docx_chapters(docx([("", "intro"), ("H2", "only"), ("", "x")], ""), "stem")
    assert title == "stem" and [t for t, _ in chapters] == ["stem", "only"]


def test_settings_round_trip():
    s = files.Settings(max_minutes=1.5, voice='a "quoted" voice', ocr=False)
    assert files.Settings.load(s.dump()) == s
    assert files.Settings.load("rate = 2\nocr = False\nengine = 5\nunknown = 1\n") == files.Settings(rate=2.0, ocr=False)
    assert files.Settings.load("not toml [") == files.Settings()


def test_selection_raises(spark):
    df = spark.createDataFrame([("4", 3)], "s string, n int")
    with pytest.raises(Exception, match="chapters"):
        df.select(structure.chapter_selection(F.col("s"), F.col("n"))).collect()


def test_streams_equal_batches(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    source.repartition(3).write.parquet(f"file://{tmp_path}/in")
    found = stream.read_documents(spark, f"file://{tmp_path}/in", 1)
    stream.write(stream.info(found), f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == {tuple(r) for r in stream.info(source).collect()}
    totals = stream.language_totals(found).writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start()
    totals.awaitTermination()
    assert sum(r.documents for r in spark.table("totals").collect()) == source.count()


def test_ports(spark):
    assert ports.silent_speech("a") == 0.5 and ports.silent_speech("a " * 10) == 4
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError("no")
        return x

    assert ports.with_retry(flaky, "ok", sleep=lambda s: None) == "ok" and len(calls) == 3
    with pytest.raises(ports.PortError):
        ports.with_retry(lambda: "", attempts=2, sleep=lambda s: None)
    df = spark.createDataFrame([(1, "a b"), (2, "")], "i int, t string")
    assert {r.i: r.o for r in ports.apply_port(df, lambda t: t.upper(), ["t"], "o").collect()} == {1: "A B", 2: None}
    assert df.where("i = 1").select(ports.speech_seconds()(F.col("t")).alias("s")).first().s == 0.8


def test_pictures_captions_and_authors(spark):
    """Pictures stand in their chapters with alternative text or caption; linked ones and more than six of a chapter of an e-book do not."""
    out = io.BytesIO()
    w, a, r, wp = (f"http://schemas.openxmlformats.org/{x}" for x in ("wordprocessingml/2006/main", "drawingml/2006/main", "officeDocument/2006/relationships", "drawingml/2006/wordprocessingDrawing"))
    head = lambda t: f'<w:p><w:pPr><w:pStyle w:val="H"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    drawing = lambda i, alt: f'<w:p><w:r><w:drawing><wp:docPr id="1" descr="{alt}"/><a:blip r:embed="{i}"/></w:drawing></w:r></w:p>'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}" xmlns:a="{a}" xmlns:r="{r}" xmlns:wp="{wp}"><w:body>{head("Alpha")}{drawing("x1", "A red  square")}{head("Beta")}<w:p><w:r><w:t>Text.</w:t></w:r></w:p>{drawing("x2", "linked")}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{w}"><w:style w:styleId="H"><w:name w:val="heading 1"/></w:style></w:styles>')
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="x1" Target="media/a.png"/><Relationship Id="x2" Target="http://x/b.png" TargetMode="External"/></Relationships>')
        z.writestr("word/media/a.png", b"PNG")
        z.writestr("docProps/core.xml", '<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator>A. Writer</dc:creator></c>')
    book_out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(epub())) as old, zipfile.ZipFile(book_out, "w") as z:
        for name in old.namelist():
            z.writestr(name, old.read(name))
        z.writestr("OEBPS/i/p 1.png", b"ONE")
    data = book_out.getvalue()
    many = "".join('<img src="i/p%201.png" alt="again"/>' for _ in range(9))
    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(again := io.BytesIO(), "w") as z:
        for name in old.namelist():
            z.writestr(name, old.read(name) if not name.endswith("a.xhtml") else f'<body><p>x</p><figure><img src="i/p%201.png" alt="alt"/><figcaption>The caption</figcaption></figure><img src="gone.png"/>{many}</body>')
    rows = [("d.docx", out.getvalue()), ("e.epub", again.getvalue()), ("bad.docx", b"x")]
    got = files.packed_pictures(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert {(x.doc_id, x.author) for x in got if x.number is None} == {("d.docx", "A. Writer"), ("e.epub", "A. Writer")}
    assert [(x.number, x.file, x.caption, bytes(x.content)) for x in got if x.doc_id == "d.docx" and x.number] == [(1, "a.png", "A red square", b"PNG")]
    shown = [(x.number, x.file, x.caption) for x in got if x.doc_id == "e.epub" and x.number]
    assert shown == [(1, "p 1.png", "The caption")] + [(1, "p 1.png", "again")] * 5
    chapters = files.packed_chapters(spark.createDataFrame(rows, "path string, content binary")).where("error is null").collect()
    assert [(r.title, r.paragraphs) for r in chapters if r.doc_id == "d.docx"] == [("Alpha", []), ("Beta", ["Text."])]
