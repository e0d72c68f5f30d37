import io
import random
import zipfile

import pytest

from leafmill.operators.asof import asof
from leafmill.sources import markup


@pytest.mark.parametrize(("after", "partitions"), [(False, 1), (False, 9), (True, 30)])
def test_equals_a_plain_search(spark, after, partitions):
    """A hot group over many partitions, groups without points, ties, nulls and repeated rows."""
    rng = random.Random(partitions)
    rows = [(rng.choice(["hot"] * 5 + ["a", "", None, "none"]), rng.choice([None, *range(2000)]), k) for k in range(1500)] + [("hot", 5, -1)] * 2
    points = [(rng.choice(["hot", "hot", "a", "", None]), rng.randrange(300, 1500)) for _ in range(60)] + [("hot", 5), ("hot", 5), ("a", None)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for k, v in zip(old, (str(partitions), "false", "41"), strict=True):
            spark.conf.set(k, v)
        got = asof(spark.createDataFrame(rows, "g string, at long, n int"), spark.createDataFrame(points, "g string, at long"), ["g"], "at", "p", after=after).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = []
    for g, at, n in rows:
        near = [p for q, p in points if q == g and p is not None and at is not None and (p >= at if after else p <= at)]
        want.append((g, at, n, (min if after else max)(near, default=None)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_tables(spark):
    rows, none = spark.createDataFrame([(1, 2)], "g int, at int"), spark.createDataFrame([], "g int, at int")
    assert [r.p for r in asof(rows, none, ["g"], "at", "p").collect()] == [None] and asof(none, rows, ["g"], "at", "p").count() == 0


HTML = '<nav><ol><li><a href="c.xhtml#x">Part <b>One</b></a><ol><li><a href="c.xhtml#y">Inner</a></ol><li><a href="d.xhtml">Two</a></ol></nav><div id="x"><span name="s"></span><blockquote><p id="y">quoted<li id="z">item</li></blockquote><p>last <img src="i.png"></p></div><a id="end"></a>'


def test_anchors_meet_the_outermost_block(spark):
    pages = spark.createDataFrame([(1, HTML), (2, None), (3, ""), (4, "<p id='a'>" * 300)], "page_id int, html string")
    elements = markup.html_elements(pages).cache()
    rows = {(r.page_id, r.ord): r for r in elements.collect()}
    anchors = elements.where("anchor is not null").select("page_id", "ord", "anchor")
    got = {r.anchor: r.block if r.block is None else rows[1, r.block].tag for r in markup.anchor_blocks(elements, anchors.where("page_id = 1")).collect()}
    assert got == {"x": "blockquote", "s": "blockquote", "y": "blockquote", "z": "blockquote", "end": None}
    picture = markup.anchor_blocks(elements, elements.where("tag = 'img'").select("page_id", "ord")).collect()
    assert [rows[1, r.block].tag for r in picture] == ["img"]
    many = markup.anchor_blocks(elements, anchors.where("page_id = 4")).collect()
    assert len(many) == 300 and all(r.block == r.ord for r in many)  # a paragraph ends the one before
    assert [(r.depth, r.text, r.href) for r in markup.contents(elements).orderBy("ord").collect()] == [(0, "Part One", "c.xhtml#x"), (1, "Inner", "c.xhtml#y"), (0, "Two", "d.xhtml")]


def test_contents_of_a_newer_book(spark):
    """An e-book whose only contents are a navigation page: its top level begins the chapters."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>T</dc:title></metadata><manifest><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="c" href="c%20d.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="n"/><itemref idref="c"/></spine></package>')
        z.writestr("o/nav.xhtml", '<nav><ol><li><a href="c%20d.xhtml">First</a></li><li><a href="c%20d.xhtml#two">Second</a><ol><li><a href="c%20d.xhtml#deep">Deep</a></li></ol></li></ol></nav>')
        z.writestr("o/c d.xhtml", '<p>one</p><h2 id="two">Head</h2><p>two</p><p id="deep">three</p>')
    assert markup.epub_chapters(out.getvalue(), "s")[2] == [("First", ["one"]), ("Second", ["Head", "two", "three"])]
