"""HTML blocks, word-processor files and e-books, by the standard library's parsers.

Each reader is one map over binary or text rows: a task parses its own files, nothing is shuffled.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.memory import give_back
from leafmill.operators.asof import asof

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCKS = (*HEADINGS, "p", "li", "blockquote", "pre", "dt", "dd")
#: Blocks inside which others are part of the outer one.
OUTER = ("p", "li", "blockquote", "pre", "dd")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: What ends an open paragraph.
ENDS_P = (*BLOCKS, "ul", "ol", "dl", "div", "table", "section", "article", "header", "footer", "form", "hr", "nav", "figure", "main", "aside", "address", "fieldset")
LONGEST_CAPTION = 300


def squeeze(text: str) -> str:
    return re.sub(r"[ \t ]+", " ", text.replace("\r", "\n").replace("\n", " ")).strip()


class Blocks(HTMLParser):
    """Collects (tag, text, src, ids) in order; tag soup closes paragraphs and items as browsers do."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int | None]] = []
        self.found: list[dict] = []
        self.hidden = 0
        self.figures: list[dict] = []
        self.ids: list[str] = []

    def _inside(self, tags: tuple[str, ...]) -> bool:
        return any(t in tags for t, _ in self.stack)

    def _close(self, tag: str) -> None:
        while self.stack:
            name, _ = self.stack.pop()
            if name == "figure" and self.figures:
                self._end_figure()
            if name == tag:
                return

    def _end_figure(self) -> None:
        figure = self.figures.pop()
        for block in figure["images"]:
            caption = squeeze(" ".join(figure["caption"]))
            block["text"] = (caption or block["text"])[:LONGEST_CAPTION]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        values = dict(attrs)
        if tag in ("script", "style", "template", "head") or tag == "title":
            self.hidden += tag != "head"
            return
        if tag in ENDS_P and any(t == "p" for t, _ in self.stack):
            self._close("p")
        if tag in ("li", "dt", "dd"):
            for t, _ in reversed(self.stack):
                if t in ("ul", "ol", "dl"):
                    break
                if t == tag or {t, tag} == {"dt", "dd"}:
                    self._close(t)
                    break
        anchor = values.get("id") or values.get("name")
        if anchor:
            self.ids.append(anchor)
        if tag == "img":
            block = {"tag": "img", "text": squeeze(values.get("alt") or values.get("title") or "")[:LONGEST_CAPTION], "src": values.get("src") or "", "ids": self._taken(), "parts": None}
            self.found.append(block)
            if self.figures:
                self.figures[-1]["images"].append(block)
            return
        if tag in VOID:
            if tag == "br":
                self.handle_data(" ")
            return
        if tag == "figure":
            self.figures.append({"caption": [], "images": []})
        at = None
        if tag in BLOCKS and not self._inside(OUTER):
            at = len(self.found)
            self.found.append({"tag": tag, "text": "", "src": "", "ids": self._taken(), "parts": []})
        self.stack.append((tag, at))

    def _taken(self) -> list[str]:
        ids, self.ids = self.ids, []
        return ids

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "template", "title"):
            self.hidden = max(0, self.hidden - 1)
        elif any(t == tag for t, _ in self.stack):
            self._close(tag)

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        if self.figures and any(t == "figcaption" for t, _ in self.stack):
            self.figures[-1]["caption"].append(data)
        for _, at in reversed(self.stack):
            if at is not None:
                self.found[at]["parts"].append(data)
                return

    def blocks(self) -> list[dict]:
        while self.figures:
            self._end_figure()
        for b in self.found:
            if b["parts"] is not None:
                b["text"] = squeeze(" ".join(b["parts"]))
        return [b for b in self.found if b["text"] or b["tag"] == "img" or b["ids"]]


class Elements(Blocks):
    """Collects every element that is shown, in order, with the number of the last one inside it."""

    def __init__(self):
        super().__init__()
        self.rows: list[dict] = []
        self.open: list[tuple[int, int, tuple]] = []  # row, place on the stack, what stands there

    def _settle(self) -> None:
        while self.open and (len(self.stack) <= self.open[-1][1] or self.stack[self.open[-1][1]] is not self.open[-1][2]):
            self.rows[self.open.pop()[0]]["stop"] = len(self.rows) - 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        super().handle_starttag(tag, attrs)
        if tag in ("script", "style", "template", "head", "title"):
            return
        self._settle()
        values, within = dict(attrs), [t for t, _ in self.stack]
        nav = within.index("nav") if "nav" in within else None
        depth = None if nav is None or tag != "a" else sum(t in ("ol", "ul") for t in within[nav:]) - 1
        self.rows.append({"tag": tag, "stop": len(self.rows), "anchor": values.get("id") or values.get("name"), "href": values.get("href"), "depth": depth, "text": ""})
        if tag not in VOID:
            self.open.append((len(self.rows) - 1, len(self.stack) - 1, self.stack[-1]))

    def handle_endtag(self, tag: str) -> None:
        super().handle_endtag(tag)
        self._settle()

    def handle_data(self, data: str) -> None:
        super().handle_data(data)
        if not self.hidden:
            for k, _, _ in self.open:
                if self.rows[k]["tag"] == "a":
                    self.rows[k]["text"] += data


def parse_elements(html: str | None) -> list[dict]:
    parser = Elements()
    parser.feed(html or "")
    parser.close()
    parser.stack = []
    parser._settle()
    return parser.rows


#: Rows, and characters of their pages, that a task holds before it gives them on.
HELD_ROWS, HELD_CHARS = 2000, 1 << 21


def _of_pages(pages: DataFrame, id_col: str, html_col: str, parsed: Callable[[str | None], Iterable[tuple]], columns: dict[str, str]) -> DataFrame:
    """(page_id, ...) of what is found in each page; pages are parsed one at a time and rows given on, so that a task holds few, however many pages Spark sends it at once."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    types = [{"int": pa.int32(), "string": pa.string()}[kind] for kind in columns.values()]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            chars = 0

            def given(kind: pa.DataType = batch.column(0).type) -> pa.RecordBatch:
                values = zip(*held, strict=True) if held else [()] * (1 + len(types))  # noqa: B023
                return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, [kind, *types], strict=True)], ["page_id", *columns])

            for page, html in zip(batch.column(0), batch.column(1), strict=True):
                page, html = page.as_py(), html.as_py()
                held += [(page, *row) for row in parsed(html)]
                chars += len(html or "")
                if len(held) >= HELD_ROWS or chars >= HELD_CHARS:
                    yield given()
                    held.clear()
                    chars = 0
            yield given()
            give_back()

    return rows.mapInArrow(parse, ", ".join(f"{name} {kind}" for name, kind in {"page_id": rows.schema["page_id"].dataType.simpleString(), **columns}.items()))


def html_elements(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """[J11, P12] (page_id, ord, stop, tag, anchor, href, depth, text): all shown elements of each page, with the last one inside each.

    An element ``a`` within a ``nav`` has its text and its depth in lists, from 0; other texts are empty.
    """
    parsed = lambda html: ((k, e["stop"], e["tag"], e["anchor"], e["href"], e["depth"], squeeze(e["text"])) for k, e in enumerate(parse_elements(html)))
    return _of_pages(pages, id_col, html_col, parsed, {"ord": "int", "stop": "int", "tag": "string", "anchor": "string", "href": "string", "depth": "int", "text": "string"})


def anchor_blocks(elements: DataFrame, anchors: DataFrame) -> DataFrame:
    """[J11] ``anchors`` (page_id, ord, ...) with ``block``: the number of the block that stands at or behind each.

    The first listed element (a heading, paragraph, item, quote or picture) at or behind the anchor, or the outermost
    paragraph, item or quote around that. As-of joins: once for the element, once for what is around it, where the intervals from an
    element to the last one inside it tell nesting. Null where none follows.
    """
    listed = elements.where(F.col("tag").isin(*BLOCKS, "img"))
    first = asof(anchors, listed.select("page_id", "ord"), ["page_id"], "ord", "__first", after=True)
    of_page = Window.partitionBy("page_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    outer = elements.where(F.col("tag").isin(*OUTER)).withColumn("__upto", F.max("stop").over(of_page)).where(F.col("__upto").isNull() | (F.col("__upto") < F.col("ord")))
    around = asof(first.withColumnRenamed("ord", "__ord").withColumnRenamed("__first", "ord"), outer.select("page_id", "ord"), ["page_id"], "ord", "__outer")
    ends = outer.select(F.col("page_id").alias("__page"), F.col("ord").cast("long").alias("__o"), F.col("stop").alias("__stop"))
    pictures = elements.where("tag = 'img'").select(F.col("page_id").alias("__page_i"), F.col("ord").cast("long").alias("__i"))
    joined = around.join(ends, (F.col("page_id") == F.col("__page")) & (F.col("__outer") == F.col("__o")), "left").join(pictures, (F.col("page_id") == F.col("__page_i")) & (F.col("ord") == F.col("__i")), "left")
    block = F.when((F.col("__stop") >= F.col("ord")) & F.col("__i").isNull(), F.col("__outer")).otherwise(F.col("ord")).cast("int")
    return joined.select(*[F.col("__ord").alias("ord") if c == "ord" else F.col(c) for c in anchors.columns], block.alias("block"))


def contents(elements: DataFrame) -> DataFrame:
    """[P12] (page_id, ord, depth, text, href): the entries of nested lists of contents, parents first."""
    return elements.where("depth >= 0 and href is not null").select("page_id", "ord", "depth", "text", "href")


def parse_blocks(html: str | None) -> list[dict]:
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    return parser.blocks()


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """[P10, X29] (page_id, block_no, tag, text, src): headings, paragraphs, items and images in order.

    Blocks inside an item, quote or paragraph are part of it, images excepted; an image's text is its figure's
    caption, else its alternative text.
    """
    parsed = lambda html: ((k, b["tag"], b["text"], b["src"]) for k, b in enumerate(b for b in parse_blocks(html) if b["text"] or b["tag"] == "img"))
    return _of_pages(pages, id_col, html_col, parsed, {"block_no": "int", "tag": "string", "text": "string", "src": "string"})


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Heading styles of word processors in several languages, with their level.
HEADING_STYLE = re.compile(r"^(?:heading|nadpis|überschrift|berschrift|titre|título|titulo)\s*(\d)", re.IGNORECASE)


_A, _R, _WP = "{http://schemas.openxmlformats.org/drawingml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}", "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
#: Pictures of a chapter of an e-book that are kept.
MOST_PICTURES = 6
Picture = tuple[int, str, str, bytes]


def docx_paragraphs(data: bytes) -> tuple[str, str, list[tuple[int | None, str, list[tuple[str, str, bytes]]]]]:
    """[S4, X29] Core title, author, and (level or null, text, pictures) of a word-processor file's paragraphs; 0 is the title style.

    A picture has its name, its alternative text and its bytes; one that is only linked is left out.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        title = author = ""
        if "docProps/core.xml" in names:
            core = ElementTree.fromstring(z.read("docProps/core.xml"))
            title, author = ((x.text or "").strip() if (x := core.find(f"{{http://purl.org/dc/elements/1.1/}}{tag}")) is not None else "" for tag in ("title", "creator"))
        targets: dict[str, str] = {}
        if "word/_rels/document.xml.rels" in names:
            for x in ElementTree.fromstring(z.read("word/_rels/document.xml.rels")).iter():
                if x.get("Id") and x.get("TargetMode") != "External":
                    targets[x.get("Id")] = posixpath.normpath(posixpath.join("word", x.get("Target", "")) if not x.get("Target", "").startswith("/") else x.get("Target")[1:])
        styles: dict[str, str] = {}
        if "word/styles.xml" in names:
            for style in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = style.find(f"{_W}name")
                styles[style.get(f"{_W}styleId", "")] = name.get(f"{_W}val", "") if name is not None else ""
        out = []
        for p in ElementTree.fromstring(z.read("word/document.xml")).iter(f"{_W}p"):
            text = "".join("\t" if x.tag == f"{_W}tab" else "\n" if x.tag == f"{_W}br" else x.text or "" for x in p.iter() if x.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))
            style, outline = p.find(f"{_W}pPr/{_W}pStyle"), p.find(f"{_W}pPr/{_W}outlineLvl")
            name = styles.get(style.get(f"{_W}val", ""), style.get(f"{_W}val", "")) if style is not None else ""
            match = HEADING_STYLE.match(name)
            level = int(match[1]) if match else 0 if name.lower() == "title" else int(outline.get(f"{_W}val", "9")) + 1 if outline is not None else None
            pictures = []
            for drawing in p.iter(f"{_W}drawing"):
                blip, said = next(drawing.iter(f"{_A}blip"), None), next(drawing.iter(f"{_WP}docPr"), None)
                name = targets.get(blip.get(f"{_R}embed", "")) if blip is not None else None
                if name in names:
                    pictures.append((posixpath.basename(name), squeeze(said.get("descr", "") if said is not None else ""), z.read(name)))
            out.append((level, squeeze(text), pictures))
    return title, author, out


def docx_contents(data: bytes, stem: str) -> tuple[str, str | None, list[tuple[str, list[str]]], list[Picture]]:
    """[S4, A7, X29] Title, author, (title, paragraphs) chapters and their pictures: the smallest level used twice, else the smallest, begins chapters.

    A picture has the number of its chapter, its name, caption and bytes.
    """
    title, author, paras = docx_paragraphs(data)
    levels = [lv for lv, t, _ in paras if lv and t]
    chapter = next((x for x in sorted(set(levels)) if levels.count(x) >= 2), min(levels, default=None))
    title = title or next((t for lv, t, _ in paras if lv == 0 and t), "") or stem
    chapters: list[tuple[str, list[str]]] = []
    pictures: list[Picture] = []
    for level, text, shown in paras:
        if not shown and (not text or (level == 0 and text == title)):
            continue
        if chapter is not None and level == chapter and text:
            chapters.append((text, []))
            text = ""
        if not chapters:
            chapters.append((title, []))
        if text and not (level == 0 and text == title):
            chapters[-1][1].append(text)
        pictures += [(len(chapters), *x) for x in shown]
    return title, author or None, chapters, pictures


def docx_chapters(data: bytes, stem: str) -> tuple[str, list[tuple[str, list[str]]]]:
    """[S4] Title and chapters of :func:`docx_contents`."""
    title, _, chapters, _ = docx_contents(data, stem)
    return title, chapters


_OPF, _DC, _NCX = "{http://www.idpf.org/2007/opf}", "{http://purl.org/dc/elements/1.1/}", "{http://www.daisy.org/z3986/2005/ncx/}"


def flatten_toc(node, depth: int = 0) -> list[tuple[int, str, str]]:
    """[P12] (depth, title, target) of nested navigation points, parents first."""
    out = []
    for point in node.findall(f"{_NCX}navPoint"):
        label, content = point.find(f"{_NCX}navLabel/{_NCX}text"), point.find(f"{_NCX}content")
        if content is not None:
            out.append((depth, (label.text or "").strip() if label is not None else "", content.get("src", "")))
        out += flatten_toc(point, depth + 1)
    return out


def epub_contents(data: bytes, stem: str) -> tuple[str, str | None, list[tuple[str, list[str]]], list[Picture]]:
    """[S5, J11, X29] Title, author, (title, paragraphs) chapters and their pictures, of an e-book in the order of its spine.

    Chapters begin where entries of the contents' chapter level point, at a file or at the first block at or after
    a fragment; without contents each file that has a first or second heading begins one.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(x.get("full-path") for x in container.iter() if x.tag.endswith("rootfile"))
        package, base = ElementTree.fromstring(z.read(opf)), posixpath.dirname(opf)
        text = lambda tag: next(((x.text or "").strip() for x in package.iter(f"{_DC}{tag}")), "")
        title, author = text("title") or stem.replace("_", " "), text("creator") or None
        items = {x.get("id"): x for x in package.iter(f"{_OPF}item")}
        where = lambda href: posixpath.normpath(posixpath.join(base, unquote(href)))
        toc: list[tuple[int, str, str]] = []
        for item in items.values():
            if item.get("media-type") == "application/x-dtbncx+xml":
                path = where(item.get("href"))
                root = ElementTree.fromstring(z.read(path)).find(f"{_NCX}navMap")
                toc = toc if root is None else [(d, t, posixpath.join(posixpath.dirname(path), unquote(h))) for d, t, h in flatten_toc(root)]
            elif not toc and "nav" in (item.get("properties") or "").split():
                path = where(item.get("href"))
                entries = [e for e in parse_elements(z.read(path).decode("utf-8", "replace")) if e["depth"] is not None and e["depth"] >= 0 and e["href"]]
                toc = [(e["depth"], squeeze(e["text"]), posixpath.join(posixpath.dirname(path), unquote(e["href"]))) for e in entries]
        depths = sorted({d for d, _, _ in toc})
        level = depths[1] if len(depths) > 1 and sum(d == depths[0] for d, _, _ in toc) == 1 else depths[0] if depths else 0
        starts: dict[str, dict[str | None, str]] = {}
        for depth, name, href in toc:
            if depth == level:
                file, _, fragment = href.partition("#")
                starts.setdefault(posixpath.normpath(file), {}).setdefault(fragment or None, name)
        chapters: list[tuple[str, list[str]]] = []
        pictures: list[Picture] = []
        inside = set(z.namelist())
        for ref in package.iter(f"{_OPF}itemref"):
            item = items.get(ref.get("idref"))
            if item is None or "html" not in (item.get("media-type") or "") or "nav" in (item.get("properties") or "").split():
                continue
            path = where(item.get("href"))
            blocks, own = parse_blocks(z.read(path).decode("utf-8", "replace")), starts.get(path, {})
            if None in own:
                chapters.append((own[None], []))
            elif not starts and (first := next((b["text"] for b in blocks if b["tag"] in ("h1", "h2") and b["text"]), "")):
                chapters.append((first, []))
            for b in blocks:
                for name in (own[i] for i in b["ids"] if i in own):
                    chapters.append((name, []))
                if not chapters and (b["tag"] == "img" or b["text"]):
                    chapters.append((title, []))
                if b["tag"] == "img":
                    name = posixpath.normpath(posixpath.join(posixpath.dirname(path), unquote(b["src"])))
                    if b["src"] and name in inside and sum(n == len(chapters) for n, *_ in pictures) < MOST_PICTURES:
                        pictures.append((len(chapters), posixpath.basename(name), b["text"], z.read(name)))
                elif b["text"]:
                    chapters[-1][1].append(b["text"])
    return title, author, chapters, pictures


def epub_chapters(data: bytes, stem: str) -> tuple[str, str | None, list[tuple[str, list[str]]]]:
    """[S5] Title, author and chapters of :func:`epub_contents`."""
    return epub_contents(data, stem)[:3]
