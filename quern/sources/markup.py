"""HTML, DOCX, XLSX and URLs: what a page or a file holds, as rows; standard library only."""

from __future__ import annotations

import html.parser
import io
import re
import xml.etree.ElementTree as ET
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCKS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li")
FURNITURE = ("script", "style", "nav", "footer", "header")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: Pages whose blocks are held at once.
_PAGES = 64
#: Extensions of direct files.
FILES = ("csv", "tsv", "json", "jsonl", "parquet", "xlsx", "xls", "txt", "md", "pdf", "html", "docx", "zip")


class Node:
    __slots__ = ("attrs", "kids", "tag", "up")

    def __init__(self, tag, attrs=(), up=None):
        self.tag, self.attrs, self.kids, self.up = tag, dict(attrs), [], up

    def text(self, joint: str = "") -> str:
        return joint.join(self.strings())

    def strings(self):
        for k in self.kids:
            if isinstance(k, str):
                yield k
            else:
                yield from k.strings()

    def every(self):
        for k in self.kids:
            if isinstance(k, Node):
                yield k
                yield from k.every()


class _Tree(html.parser.HTMLParser):
    def __init__(self, without):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("")
        self.without, self.skip = without, []

    def handle_starttag(self, tag, attrs):
        if self.skip or tag in self.without:
            if tag not in VOID:
                self.skip.append(tag)
            return
        node = Node(tag, attrs, self.now)
        self.now.kids.append(node)
        if tag not in VOID:
            self.now = node

    def handle_startendtag(self, tag, attrs):
        if not self.skip and tag not in self.without:
            self.now.kids.append(Node(tag, attrs, self.now))

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.skip:
                while self.skip.pop() != tag:
                    pass
            return
        node = self.now
        while node is not None and node.tag != tag:
            node = node.up
        if node is not None and node.up is not None:
            self.now = node.up

    def handle_data(self, data):
        if not self.skip:
            self.now.kids.append(data)


def tree(markup: str, without=FURNITURE) -> Node:
    parser = _Tree(without)
    parser.feed(markup or "")
    parser.close()
    return parser.root


def blocks(markup: str) -> list[tuple[str, str]]:
    """(element, text) of paragraphs, headings and list items that have text."""
    return [(n.tag, t) for n in tree(markup).every() if n.tag in BLOCKS and (t := n.text().strip())]


def first_table(markup: str) -> list[list[str]] | None:
    for n in tree(markup).every():
        if n.tag == "table":
            return [[c.text().strip() for c in r.every() if c.tag in ("td", "th")] for r in n.every() if r.tag == "tr"]
    return None


def main_content(markup: str) -> tuple[str, str]:
    """Title, and the text of main, else article, else role=main, else body, a line for each string."""
    root = tree(markup, (*FURNITURE, "aside", "iframe"))
    nodes = list(root.every())
    title = next((n.text().strip() for n in nodes if n.tag == "title"), "")
    picks = (lambda n: n.tag == "main", lambda n: n.tag == "article", lambda n: n.attrs.get("role") == "main", lambda n: n.tag == "body")
    body = next((n for p in picks for n in nodes if p(n)), root)
    return title, "\n".join(s.strip() for s in body.strings() if s.strip())


def html_blocks(df: DataFrame, markup: str, *keep: str) -> DataFrame:
    """A row for each block, after the columns named. A task holds the blocks of some pages at a time."""
    rows = df.select(*keep, F.col(markup).alias("markup"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("place", T.IntegerType()), T.StructField("element", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches):
        for batch in batches:
            for some in (batch.slice(k, _PAGES) for k in range(0, batch.num_rows, _PAGES)):
                found = [(row, place, e, t) for row, m in enumerate(some.column(some.num_columns - 1)) for place, (e, t) in enumerate(blocks(m.as_py()))]
                row, *new = (pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.string(), pa.string())))
                yield pa.RecordBatch.from_arrays([*(c.take(row) for c in some.columns[:-1]), *new], names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)


def scrape(df: DataFrame, markup: str, url: str, scraped_at: Column | None = None) -> DataFrame:
    """url, title, content, scraped_at of each page."""
    found = F.udf(lambda m: dict(zip(("title", "content"), main_content(m), strict=True)), "struct<title:string,content:string>", useArrow=True)
    at = F.date_format(scraped_at if scraped_at is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    page = F.array(F.struct(F.col(url).alias("url"), found(F.col(markup)).alias("p"), at.alias("scraped_at")))
    return df.select(F.inline(page)).select("url", "p.title", "p.content", "scraped_at")


def is_direct_file(url: Column, content_type: Column | None = None) -> Column:
    """By the path's extension; else by a content type other than HTML, where one is given."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    named = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*FILES)
    return named if content_type is None else named | (F.coalesce(content_type, F.lit("")) != "") & ~F.coalesce(content_type, F.lit("")).contains("text/html")


def docx_paragraphs(content: bytes) -> list[tuple[int, str, str]]:
    """(number, style, text) of paragraphs that have text; numbers count empty ones."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{w}body")
    out = []
    for k, p in enumerate(body.findall(f"{w}p"), 1):
        style = p.find(f"{w}pPr/{w}pStyle")
        if t := "".join(x.text or "" for x in p.iter(f"{w}t")).strip():
            out.append((k, style.get(f"{w}val") if style is not None else "Normal", t))
    return out


def xlsx_rows(content: bytes, sheet: str | None = None) -> list[list[str | None]]:
    """Cells of a sheet, the first if none is named, as text."""
    s, r = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in si.iter(f"{s}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        sheets = [(x.get("name"), x.get(f"{r}id")) for x in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{s}sheet")]
        wanted = next(i for n, i in sheets if sheet in (None, n))
        target = next(x.get("Target") for x in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")) if x.get("Id") == wanted)
        root = ET.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    rows = []
    for row in root.iter(f"{s}row"):
        cells: dict[int, str | None] = {}
        for c in row.findall(f"{s}c"):
            letters = re.match(r"[A-Z]+", c.get("r", "A"))[0]
            at = 0
            for ch in letters:
                at = at * 26 + ord(ch) - 64
            v, kind = c.find(f"{s}v"), c.get("t")
            cells[at - 1] = "".join(t.text or "" for t in c.iter(f"{s}t")) if kind == "inlineStr" else None if v is None else shared[int(v.text)] if kind == "s" else v.text
        rows.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
    return rows
