"""Readers by format. A file that can't be read gives no rows and a warning."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.names import col, cols, fresh
from quern.operators.tables import written
from quern.sources import detect, markup, scan

Reader = Callable[..., DataFrame]
READERS: dict[str, Reader] = {}
#: Codes of ingestion errors.
ERRORS = ("UNSUPPORTED_FORMAT", "FILE_TOO_LARGE", "EMPTY_FILE", "PARSE_ERROR", "CONNECTOR_ERROR", "STORAGE_ERROR", "NOT_FOUND", "INVALID_REQUEST")


class IngestionError(Exception):
    def __init__(self, code: str, message: str, status: int = 400):
        super().__init__(message)
        self.code, self.status = code if code in ERRORS else "INVALID_REQUEST", status


def reader(name: str) -> Callable[[Reader], Reader]:
    """Registers a reader, also for users' own formats."""

    def put(f: Reader) -> Reader:
        READERS[name] = f
        return f

    return put


def read(spark: SparkSession, path: str, fmt: str, **options) -> DataFrame:
    try:
        if fmt not in READERS:
            raise IngestionError("UNSUPPORTED_FORMAT", f"no reader for {fmt!r}")
        return READERS[fmt](spark, path, **options)
    except Exception as e:  # noqa: BLE001
        warnings.warn(f"{path}: {e}", stacklevel=2)
        return spark.createDataFrame([], T.StructType([]))


def preview(df: DataFrame, n: int = 50, order_by: str | None = None) -> DataFrame:
    """The first rows, nulls of text empty."""
    return (df.orderBy(col(order_by)) if order_by else df).limit(n).na.fill("")


def _head(spark: SparkSession, path: str, n: int) -> bytes:
    """The first bytes of a file, or of a folder's first file, without reading the rest."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in store.globStatus(where) or []:
        files = [found] if found.isFile() else sorted((f for f in store.listStatus(found.getPath()) if f.isFile() and not f.getPath().getName().startswith(("_", "."))), key=lambda f: f.getPath().toString())
        if files:
            stream = store.open(files[0].getPath())
            try:
                return bytes(stream.readNBytes(n))
            finally:
                stream.close()
    return b""


def validate(spark: SparkSession, path: str) -> dict:
    """Format, and whether the file is there, not empty and of a known format."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(where):
        return {"format": None, "is_valid": False, "error_message": "file not found"}
    size = store.getFileStatus(where).getLen()
    fmt = detect.detect(path, _head(spark, path, 1024) if size else b"")
    problem = "file is empty" if not size else None if fmt in READERS else f"format {fmt} isn't supported"
    return {"format": fmt, "is_valid": problem is None, "error_message": problem}


#: Encodings in which Spark can decode a column.
_DECODED = ("UTF-8", "UTF8", "US-ASCII", "ASCII", "ISO-8859-1", "LATIN-1", "LATIN1")


def _strings(spark: SparkSession, lines: DataFrame):
    """One string column as the JVM's readers take it."""
    return getattr(lines._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())


def _csv(spark: SparkSession, path: str, sep: str, encoding: str | None) -> DataFrame:
    """Files are read in blocks also where fields have line ends in them: records are then put together by the scanner. Only in encodings of more bytes a character than one (but UTF-8), and in those that Spark can't decode, such files are read whole by a task each. A quote opens a field only at the field's start; the rest of a file after a quote that is never closed is left out."""
    if encoding is None:
        encoding = detect.encoding(_head(spark, path, 100_000)) or "UTF-8"
    options = {"inferSchema": True, "mode": "DROPMALFORMED", "escape": '"', "sep": sep}
    wide = encoding.upper().startswith(("UTF-16", "UTF-32", "UTF16", "UTF32"))
    lines = scan.pieces(spark, path, "\n")
    if encoding.upper() in _DECODED[2:]:
        lines = lines.withColumn("value", F.decode(F.col("value").cast("binary"), "ISO-8859-1" if "1" in encoding else "US-ASCII"))
    open0, open1 = scan.quoted_after(F.regexp_replace("value", r"\r\z", ""), sep)
    # where no line ends in quotes, lines are records
    if wide or lines.filter(open0).isEmpty():
        return spark.read.csv(path, header=True, multiLine=wide, encoding=encoding, **options)
    if encoding.upper() not in _DECODED:
        return spark.read.csv(path, header=True, multiLine=True, encoding=encoding, **options)
    none = F.lit(0)
    found = scan.records(lines.withColumns({"t0": open0, "t1": open1, "d0": none, "d1": none}), 0, "\n")
    found = written(found.select("file", "first", F.regexp_replace("value", r"\r\z", "").alias("value")), "csv")
    head = found.filter("first").orderBy("file").select(F.regexp_replace("value", "^\ufeff", "").alias("value")).limit(1)
    # the names as Spark makes them; the lines are read under others, of which no line can be a copy
    names = spark._jsparkSession.read().option("header", True).option("sep", sep).option("escape", '"').csv(_strings(spark, head)).columns()
    stand_in = spark.createDataFrame([(sep.join(f"{uuid.uuid4().hex}" for _ in names),)], "value string").coalesce(1)
    reader = spark._jsparkSession.read().option("header", True)
    for k, v in options.items():
        reader = reader.option(k, v)
    rows = DataFrame(reader.csv(_strings(spark, stand_in.union(found.filter("not first").select("value")))), spark)
    return rows.toDF(*names)


@reader("csv")
def read_csv(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    return _csv(spark, path, ",", encoding)


@reader("tsv")
def read_tsv(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    return _csv(spark, path, "\t", encoding)


def flat(df: DataFrame) -> DataFrame:
    """Structs to columns with dotted names."""

    def leaves(schema: T.StructType, path: tuple[str, ...]):
        for f in schema.fields:
            here = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, here)
            else:
                yield F.col(".".join(f"`{p}`" for p in here)).alias(".".join(here))

    return df.select(*leaves(df.schema, ()))


def _array(spark: SparkSession, path: str) -> DataFrame | None:
    """The objects of an array, read in blocks; None if it holds something else or is broken."""
    parts = scan.pieces(spark, path, "}")
    found = scan.records(parts.withColumns(dict(zip(("t0", "d0", "t1", "d1"), scan.brackets_after(F.col("value")), strict=True))), 1, "}", "}")
    objects = written(found.select(F.regexp_replace("value", r"\A[\s,\[\ufeff]+", "").alias("value")), "objects")
    df = DataFrame(spark._jsparkSession.read().option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(_strings(spark, objects)), spark)
    return None if "_corrupt" in df.columns or not df.columns else df


@reader("json")
def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects: rows, read in blocks. One object: one row, flattened. A scalar: column value. Text that isn't one JSON value is read by lines."""
    mark = _head(spark, path, 4096).decode("utf-8", "replace").lstrip("\ufeff \t\r\n")
    if mark[:1] == "[" and mark[1:].lstrip()[:1] == "{" and (df := _array(spark, path)) is not None:
        return df
    if mark[:1] in ("[", "{"):
        df = spark.read.json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
        if "_corrupt" not in df.columns:
            return flat(df) if mark[:1] == "{" else df
        return read_jsonl(spark, path)
    return spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r'\A\s*"?|"?\s*\z', "").alias("value"))


@reader("jsonl")
def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, mode="DROPMALFORMED")


def malformed_lines(spark: SparkSession, path: str) -> int:
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.filter(F.expr("try_parse_json(value)").isNull()).count()


@reader("parquet")
def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@reader("txt")
def read_text(spark: SparkSession, path: str) -> DataFrame:
    """line_number from 1 in each file, and text without its line end; one row a line, and none after a last line end. Files are read in blocks; a block's lines are numbered from the counts of those before it."""
    file, start = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    lines = spark.read.text(path, lineSep="\n").select("value", file, start, F.monotonically_increasing_id().alias("at"))
    counts = lines.groupBy("file", "start").agg(F.count("*").alias("n"))
    before = counts.select("file", "start", (F.sum("n").over(Window.partitionBy("file").orderBy("start")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("file", "start").orderBy("at"))
    placed = lines.withColumn("inside", inside).join(before, ["file", "start"])
    return placed.select((F.col("before") + F.col("inside")).cast("int").alias("line_number"), F.regexp_replace("value", r"\r+\z", "").alias("text"))


READERS["md"] = read_text


def _files(spark: SparkSession, path: str, find, schema: str, names: list[str]) -> DataFrame:
    rows = F.udf(lambda b: [dict(zip(names, r, strict=True)) for r in find(bytes(b))], f"array<struct<{schema}>>")
    return spark.read.format("binaryFile").load(path).select(F.explode(rows("content")).alias("r")).select("r.*")


def _sheets(spark: SparkSession, path: str, find) -> DataFrame:
    """(file, head, rows) of every file: ``find`` gives names of columns and rows of text. A table, so that each file is parsed once."""

    @F.udf("struct<head:array<string>,rows:array<array<string>>>", useArrow=True)
    def parsed(content):
        head, rows = find(bytes(content))
        return {"head": head, "rows": [[*(r + [None] * len(head))[: len(head)]] for r in rows]}

    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), parsed("content").alias("p"))
    return written(files.select("file", "p.head", "p.rows"), "sheets")


def _united(sheets: DataFrame) -> DataFrame:
    """The rows of all files under all their columns, those of the first file first. Heads, not rows, come to the driver: one of each kind."""
    heads = [r["head"] for r in sheets.groupBy("head").agg(F.min("file").alias("f")).orderBy("f").collect()]
    names = list(dict.fromkeys(n for h in heads for n in h))
    rows = sheets.select("head", F.explode("rows").alias("r"))
    return rows.select(*(F.when(F.array_contains("head", n), F.get("r", F.array_position("head", n).cast("int") - 1)).alias(n) for n in names))


@reader("html")
def read_html(spark: SparkSession, path: str) -> DataFrame:
    """Of each file the first table if there is one, else blocks, else lines. Of a folder all files, their columns by name."""

    def find(content: bytes):
        text = content.decode("utf-8", "replace")
        if table := markup.first_table(text):
            head, *body = table
            return [h or f"column_{k}" for k, h in enumerate(head)], body
        if found := markup.blocks(text):
            return ["element", "text"], [list(r) for r in found]
        return ["line_number", "text"], [[str(k), t.strip()] for k, t in enumerate(markup.tree(text).text("\n").split("\n"), 1) if t.strip()]

    df = _united(_sheets(spark, path, find))
    return df.withColumn("line_number", F.col("line_number").cast("int")) if df.columns == ["line_number", "text"] else df


@reader("docx")
def read_docx(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path, markup.docx_paragraphs, "paragraph_number:int,style:string,text:string", ["paragraph_number", "style", "text"])


@reader("xlsx")
def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """The named sheet of each file, or its first. Of a folder all files, their columns by name."""

    def find(content: bytes):
        head, *body = markup.xlsx_rows(content, sheet) or [[]]
        return [h or f"column_{k}" for k, h in enumerate(head)], body

    return _united(_sheets(spark, path, find))


@reader("pdf")
def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """page_number and text; needs pypdf. Without it, or for a broken file, one row that says so."""

    def pages(content: bytes):
        try:
            import io

            from pypdf import PdfReader

            return [(k, p.extract_text() or "") for k, p in enumerate(PdfReader(io.BytesIO(content)).pages, 1)]
        except Exception as e:  # noqa: BLE001
            return [(1, f"[Parse error: {e}]")]

    return _files(spark, path, pages, "page_number:int,text:string", ["page_number", "text"])


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def join_chunks(spark: SparkSession, folder: str, total: int, target: str | None = None) -> bytes | int:
    """The chunks chunk_00000 to the last, in order; a missing one is a storage error. With ``target`` they are streamed into that file, in any store, and its size is returned; without it their bytes are."""
    parts = [_place(spark, f"{folder}/chunk_{k:05d}") for k in range(total)]
    if missing := [k for k, (store, at) in enumerate(parts) if not store.exists(at)]:
        raise IngestionError("STORAGE_ERROR", f"chunk {missing[0]} is missing", 500)
    if target is None:
        return b"".join(_bytes(store, at) for store, at in parts)
    store, where = _place(spark, target)
    out = store.create(where, True)
    try:
        for source, at in parts:
            stream = source.open(at)
            try:
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
            finally:
                stream.close()
    finally:
        out.close()
    return store.getFileStatus(where).getLen()


def _bytes(store, at) -> bytes:
    stream = store.open(at)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def copy(spark: SparkSession, source: str, target: str) -> None:
    """A file or folder, from any store to any, streamed; what is there is replaced."""
    (a, x), (b, y) = _place(spark, source), _place(spark, target)
    if not a.exists(x):
        raise IngestionError("NOT_FOUND", f"{source} isn't there", 404)
    b.delete(y, True)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a, x, b, y, False, True, spark._jsparkSession.sessionState().newHadoopConf())


#: Sources that a table can be read from.
CONNECTORS = ("upload", "s3", "url", "huggingface", "google_drive")


def object_store(bucket: str, key: str = "", scheme: str = "s3a") -> str:
    """A path for any reader; listing is binaryFile's, credentials are the session's."""
    return f"{scheme}://{bucket}/{key}"


def list_objects(spark: SparkSession, path: str) -> DataFrame:
    """key, size and last_modified of the files under a path; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))


def hub_path(dataset: str, split: str = "train", config: str | None = None) -> str:
    """Parquet files of a public dataset hub, for sessions with its file system."""
    return f"hf://datasets/{dataset}/{config + '/' if config else ''}{split}/*.parquet"


FETCHED = ("kind", "title", "content", "error")


def fetch(urls: DataFrame, fetcher: Callable[[str], tuple[str, bytes]], mode: str = "auto", url_column: str = "url") -> DataFrame:
    """All rows and columns, with kind, title, content and error of each URL (columns of these names are replaced); ``fetcher`` gives content type and bytes. Errors are rows, not exceptions."""

    def get(url: str):
        try:
            kind, body = fetcher(url)
            direct = mode == "download" or mode == "auto" and (url.split("?")[0].rsplit(".", 1)[-1].lower() in markup.FILES or "text/html" not in (kind or ""))
            title, text = ("", body.decode("utf-8", "replace")) if direct else markup.main_content(body.decode("utf-8", "replace"))
            return {"kind": "file" if direct else "page", "title": title, "content": text, "error": None}
        except Exception as e:  # noqa: BLE001
            return {"kind": None, "title": None, "content": None, "error": str(e)}

    urls = urls.drop(*FETCHED)
    (name,) = fresh(urls, "fetched")
    got = F.udf(get, ", ".join(f"{c} string" for c in FETCHED), useArrow=True)
    return urls.withColumn(name, got(col(url_column))).select(*cols(urls.columns), f"{name}.*")
