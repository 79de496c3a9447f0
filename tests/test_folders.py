"""Folders of files that have tables in them: no file is left out."""

import io
import zipfile

from quern.plans import ingest
from quern.sources import readers


def book(rows):
    s, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cell = lambda c, k, v: f'<c r="{chr(65 + c)}{k}" t="inlineStr"><is><t>{v}</t></is></c>'
    body = "".join(f'<row r="{k}">' + "".join(cell(c, k, v) for c, v in enumerate(x)) + "</row>" for k, x in enumerate(rows, 1))
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {s} {r}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f"<worksheet {s}><sheetData>{body}</sheetData></worksheet>")
    return b.getvalue()


def test_html_folder(spark, tmp_path):
    table = "<table><tr><th>{}</th><th>b.c</th></tr><tr><td>1</td><td>{}</td></tr></table>"
    for k, head in enumerate("aax"):
        (tmp_path / f"{k}.html").write_text(table.format(head, k))
    df = readers.read(spark, str(tmp_path), "html")
    assert df.columns == ["a", "b.c", "x"]
    assert sorted(tuple(r) for r in df.fillna("-").collect()) == [("-", "2", "1"), ("1", "0", "-"), ("1", "1", "-")]
    (tmp_path / "3.html").write_text("<p>One</p><li>two</li>")
    assert readers.read(spark, str(tmp_path), "html").count() == 5
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "a.html").write_text("plain\n\ntext")
    (lines / "b.html").write_text("more")
    got = readers.read(spark, str(lines), "html")
    assert dict(got.dtypes)["line_number"] == "int" and sorted(r["text"] for r in got.collect()) == ["more", "plain", "text"]


def test_xlsx_folder(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(book([["n", "m"], ["1", "2"], ["3", "4"]]))
    (tmp_path / "b.xlsx").write_bytes(book([["m", "o"], ["5", "6"]]))
    df = readers.read(spark, str(tmp_path), "xlsx")
    assert df.columns == ["n", "m", "o"] and sorted(str(tuple(r)) for r in df.collect()) == ["('1', '2', None)", "('3', '4', None)", "(None, '5', '6')"]


def test_statistics_are_as_chosen(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(f'{{"k": {k % 7}}}' for k in range(100)))
    found = ingest.ingest(spark, str(tmp_path / "a.jsonl"), str(tmp_path / "raw"), name="chosen")
    assert [(r["unique_count"], r["unique_count_is"]) for r in found.statistics().collect()] == [(7, "exact")]
    assert [(r["unique_count"], r["unique_count_is"]) for r in found.statistics(approximate=True).collect()] == [(7, "an estimate")]
