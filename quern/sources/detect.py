"""File formats by name, first bytes and content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions and the formats they stand for.
EXTENSIONS = {
    "csv": "csv", "tsv": "tsv", "tab": "tsv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "parquet": "parquet", "pq": "parquet",
    "xlsx": "xlsx", "xls": "xlsx", "txt": "txt", "text": "txt", "md": "md", "pdf": "pdf", "html": "html", "htm": "html", "docx": "docx",
}


def detect(path: str, head: bytes) -> str:
    """By extension, then magic bytes, then the first kilobyte."""
    ext = path.rsplit("/", 1)[-1].rpartition(".")[2].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if ext in EXTENSIONS:
        return EXTENSIONS[ext]
    for magic, name in ((b"%PDF", "pdf"), (b"PK\x03\x04", "xlsx"), (b"PAR1", "parquet")):
        if head.startswith(magic):
            return name
    text = head[:1024].decode("utf-8", "replace").strip()
    lines = text.split("\n")
    if not text:
        return "txt"
    if text[0] in "[{":
        return "jsonl" if sum(line.lstrip().startswith("{") for line in lines) > 1 else "json"
    if "<html" in text.lower() or "<!doctype" in text.lower():
        return "html"
    tabs, commas = text.count("\t"), text.count(",")
    return "tsv" if tabs > commas and tabs > 3 else "csv" if commas > 3 else "txt"


def detect_column(path: Column, content: Column) -> Column:
    """The same for many files at once, over Spark's binaryFile rows."""
    head = F.substring(content, 1, 1024)
    text = F.trim(F.translate(F.decode(head, "ISO-8859-1"), "\t\r", "\t "))
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    known = F.element_at(F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv)), F.when(ext.isin(*EXTENSIONS), ext).otherwise("txt"))
    body = F.regexp_replace(text, r"\A\s+|\s+\z", "")
    objects = F.regexp_count(body, F.lit(r"(?m)^\s*\{"))
    tabs, commas = F.regexp_count(body, F.lit("\t")), F.regexp_count(body, F.lit(","))
    return (
        F.when(ext.isin(*EXTENSIONS), known)
        .when(F.hex(F.substring(content, 1, 4)) == "25504446", "pdf")
        .when(F.hex(F.substring(content, 1, 4)) == "504B0304", "xlsx")
        .when(F.hex(F.substring(content, 1, 4)) == "50415231", "parquet")
        .when(body == "", "txt")
        .when(F.substring(body, 1, 1).isin("[", "{"), F.when(objects > 1, "jsonl").otherwise("json"))
        .when(F.lower(body).contains("<html") | F.lower(body).contains("<!doctype"), "html")
        .when((tabs > commas) & (tabs > 3), "tsv")
        .when(commas > 3, "csv")
        .otherwise("txt")
    )


def encoding(head: bytes) -> str:
    """By byte order mark, then strict UTF-8 (a character cut at the end aside), else Latin-1."""
    for mark, name in ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE")):
        if head.startswith(mark):
            return name
    try:
        head.decode("utf-8")
    except UnicodeDecodeError as e:
        return "UTF-8" if e.reason == "unexpected end of data" else "ISO-8859-1"
    return "UTF-8"
