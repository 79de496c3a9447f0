import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quern.sources import catalog, detect, markup, readers, sinks
from quern.streaming import rowwise


def put(folder, name, data):
    p = folder / name
    p.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(p)


@pytest.mark.parametrize(
    ("name", "head", "fmt"),
    [("a.CSV", b"", "csv"), ("a.ndjson", b"", "jsonl"), ("x", b"%PDF-1", "pdf"), ("x", b"PK\x03\x04..", "xlsx"), ("x", b"PAR1", "parquet"), ("x", b"", "txt"), ("x", b'{"a":1}\n{"a":2}', "jsonl"), ("x", b'{"a":1}', "json"), ("x", b"[1]", "json"), ("x", b"<!DOCTYPE html>", "html"), ("x", b"a\tb\tc\td\te", "tsv"), ("x", b"a,b,c,d,e", "csv"), ("x", b"plain", "txt")],
)
def test_detect(spark, name, head, fmt):
    assert detect.detect(name, head) == fmt
    df = spark.createDataFrame([(f"file:/d/{name}", bytearray(head))], "path string, content binary")
    assert df.select(detect.detect_column(F.col("path"), F.col("content")).alias("f")).first()["f"] == fmt


def test_encoding():
    assert detect.encoding("é".encode()) == "UTF-8"
    assert detect.encoding("é".encode("latin-1") + b" x  ") == "ISO-8859-1"
    assert detect.encoding("é".encode()[:1]) == "UTF-8"


def test_text_formats(spark, tmp_path):
    csv = put(tmp_path, "a.csv", 'id,text\n1,"a, ""b"""\n2,é\n')
    assert [tuple(r) for r in readers.read(spark, csv, "csv").orderBy("id").collect()] == [(1, 'a, "b"'), (2, "é")]
    assert readers.read(spark, put(tmp_path, "l.csv", "t\né\n".encode("latin-1")), "csv").first()["t"] == "é"
    assert readers.read(spark, put(tmp_path, "a.tsv", "a\tb\n1\t2\n"), "tsv").first()["b"] == 2
    assert readers.read(spark, put(tmp_path, "a.json", '[{"a":1},{"a":2}]'), "json").count() == 2
    assert readers.read(spark, put(tmp_path, "o.json", '{"a":{"b":1},"c":2}'), "json").columns == ["a.b", "c"]
    assert readers.read(spark, put(tmp_path, "s.json", '"x"'), "json").first()["value"] == "x"
    lines = put(tmp_path, "a.jsonl", '{"a":1}\n\nnope\n{"a":2}\n')
    assert readers.read(spark, lines, "jsonl").count() == 2
    assert readers.malformed_lines(spark, lines) == 1
    got = readers.read(spark, put(tmp_path, "a.txt", "x\r\n\ny\n"), "txt").collect()
    assert [(r["line_number"], r["text"]) for r in got] == [(1, "x"), (2, ""), (3, "y")]


def test_failures_give_no_rows(spark, tmp_path):
    with pytest.warns(UserWarning):
        assert readers.read(spark, "/nowhere/at/all", "csv").count() == 0
    with pytest.warns(UserWarning):
        assert readers.read(spark, "x", "odd").count() == 0
    assert not readers.validate(spark, "/nowhere.csv")["is_valid"]
    assert readers.validate(spark, put(tmp_path, "e.csv", ""))["error_message"] == "file is empty"
    assert readers.validate(spark, put(tmp_path, "g.csv", "a\n1"))["is_valid"]


HTML = '<html><head><title> T </title><style>p{}</style></head><body><nav><li>no</li></nav><main><h1>Head</h1><p>One <b>bold</b> &amp; more</p><ul><li>item</li></ul><p> </p></main><aside>no</aside><script>x("</p>")</script></body></html>'


def test_html(spark, tmp_path):
    assert markup.blocks(HTML) == [("h1", "Head"), ("p", "One bold & more"), ("li", "item")]
    assert markup.main_content(HTML) == ("T", "Head\nOne\nbold\n& more\nitem")
    assert readers.read(spark, put(tmp_path, "a.html", HTML), "html").count() == 3
    table = "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table><p>x</p>"
    assert readers.read(spark, put(tmp_path, "t.html", table), "html").first()["b"] == "2"
    assert markup.main_content("<div>plain <!-- c --></div>") == ("", "plain")
    df = spark.createDataFrame([("http://a/b.csv?x",), ("http://a/b",), ("http://a.csv",)], "url string")
    assert [r[0] for r in df.select(markup.is_direct_file(F.col("url"))).collect()] == [True, False, False]


def test_zip_formats(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Hi</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>you</w:t></w:r></w:p></w:body></w:document>')
    rows = readers.read(spark, put(tmp_path, "a.docx", b.getvalue()), "docx").orderBy("paragraph_number").collect()
    assert [tuple(r) for r in rows] == [(1, "Heading1", "Hi"), (3, "Normal", "you")]
    s, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {s} {r}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {s}><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="B2"><v>7</v></c></row></sheetData></worksheet>')
    assert tuple(readers.read(spark, put(tmp_path, "a.xlsx", b.getvalue()), "xlsx").first()) == (None, "7")


def test_chunks_fetch_catalog(spark, tmp_path):
    for k, part in enumerate((b"ab", b"c")):
        put(tmp_path, f"chunk_{k:05d}", part)
    assert readers.join_chunks(spark, str(tmp_path), 2) == b"abc"
    with pytest.raises(readers.IngestionError):
        readers.join_chunks(spark, str(tmp_path), 3)
    urls = spark.createDataFrame([("http://a/x.csv",), ("http://a/p",), ("http://bad",)], "url string")

    def fetcher(url):
        if "bad" in url:
            raise OSError("down")
        return ("text/csv", b"1") if url.endswith("csv") else ("text/html", HTML.encode())

    assert [r["kind"] for r in readers.fetch(urls, fetcher).collect()] == ["file", "page", None]
    jobs = spark.createDataFrame([(1, 1, 5, False), (1, 2, 6, False), (2, 1, None, False), (3, 1, 9, True)], "id long, version long, at long, deleted boolean")
    now = catalog.latest(jobs)
    assert [r["id"] for r in catalog.page(now, order_by="at", descending=True).collect()] == [1, 2]
    assert catalog.page(now, order_by="id", skip=1, limit=1).first()["id"] == 2


def test_tables_and_stream(spark, tmp_path):
    df = spark.createDataFrame([("a   b",), ("c",)], "text string")
    for fmt in ("parquet", "csv", "jsonl"):
        sinks.write_table(df, str(tmp_path / fmt), fmt)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 2
    got = []
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "parquet"))
    q = rowwise.apply(stream, [{"step": "noise_removal"}], lambda rows, k: got.extend(r["text"] for r in rows.collect()), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted(got) == ["a b", "c"]
    with pytest.raises(ValueError, match="not for streams"):
        rowwise.apply(stream, [{"step": "deduplication"}], print, str(tmp_path / "cp2"))
    sinks.write_config({"a": 1}, str(tmp_path / "c.json"))
    assert json.load(open(tmp_path / "c.json")) == {"a": 1}


def test_ingest(spark, tmp_path):
    from quern.plans.ingest import ingest

    file = tmp_path / "a.csv"
    file.write_text('id,text\n1,"one, two"\n2,three\n')
    found = ingest(spark, str(file), str(tmp_path / "raw"), name="a_table")
    assert (found.format, found.row_count(), found.columns) == ("csv", 2, {"id": "int", "text": "string"})
    assert spark.table("a_table").count() == 2
    assert {r["column"]: r["unique_count"] for r in found.statistics().collect()} == {"id": 2, "text": 2}
    assert found.tokens().first()[0] == 9 and found.preview(1).count() == 1
    for name, text, code in (("none.csv", None, "NOT_FOUND"), ("empty.csv", "", "EMPTY_FILE"), ("a.parquet", "x", "PARSE_ERROR")):
        if text is not None:
            (tmp_path / name).write_text(text)
        with pytest.raises(readers.IngestionError) as e:
            ingest(spark, str(tmp_path / name), str(tmp_path / "raw2"), name="b")
        assert e.value.code == code


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.txt").write_text("".join(f"{k} {n}\r\n" for n in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows = readers.read(spark, str(tmp_path), "txt").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["text"].split()[0], r["line_number"], r["text"]) for r in rows) == sorted((str(k), n + 1, f"{k} {n}") for k in range(2) for n in range(3000))


def test_csv_with_line_ends_in_fields(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"one\ntwo ""three"""\n2,four\n')
    assert [tuple(r) for r in readers.read(spark, str(tmp_path / "a.csv"), "csv").orderBy("id").collect()] == [(1, 'one\ntwo "three"'), (2, "four")]
