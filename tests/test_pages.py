import pytest

from leafmill.sources import markup


@pytest.mark.parametrize(("reader", "parser"), [("html_elements", "parse_elements"), ("html_blocks", "parse_blocks")])
def test_pages_are_given_on_as_they_are_parsed(spark, monkeypatch, reader, parser):
    """A task that gets thousands of pages at once holds the elements of few of them."""
    html = "<nav><ol>" + "<li><a href='#x'>one</a></li>" * 20 + "</ol></nav><p>two</p>"
    pages = spark.createDataFrame([(k, html if k % 7 else None) for k in range(3000)], "page_id long, html string").coalesce(1)
    want = getattr(markup, reader)(pages).collect()
    seen, held, frame, parse = [], [], type(pages), getattr(markup, parser)
    monkeypatch.setattr(frame, "mapInPandas", lambda self, f, schema: f(iter([self.toPandas()])))
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, schema: f(iter(self.toArrow().combine_chunks().to_batches())))
    monkeypatch.setattr(markup, parser, lambda html: seen.append(html) or parse(html))
    got = []
    for batch in getattr(markup, reader)(pages):
        held.append(len(seen))
        seen.clear()
        got += zip(*batch.to_pydict().values(), strict=True) if hasattr(batch, "to_pydict") else batch.itertuples(index=False, name=None)
    assert max(held) < 200
    assert sum(held) == 3000 and got == [tuple(r) for r in want]
