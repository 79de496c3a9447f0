"""Steps whose work or memory grew faster than their input."""

import json
import time
import unicodedata

from pyspark.sql import functions as F

from quern.functions import pii, quality, text
from quern.operators import profile, steps
from quern.sources import markup, readers, sinks


def test_each_task_writes_an_array(spark, tmp_path):
    rows = spark.createDataFrame([(k, 'a "}" ]') for k in range(50)], "k long, t string").repartition(3)
    sinks.as_array(rows.select(F.concat(F.to_json(F.struct("k", "t")), F.lit(",")).alias("value"))).write.text(str(tmp_path / "a"))
    files = sorted((tmp_path / "a").glob("part-*"))
    assert len(files) == 3 and sum(len(json.loads(f.read_text())) for f in files) == 53
    got = readers.read(spark, f"{tmp_path}/a/part-*", "json").filter("k is not null")
    assert sorted((r["k"], r["t"]) for r in got.collect()) == [(k, 'a "}" ]') for k in range(50)]


def test_blocks_of_many_pages(spark, monkeypatch):
    monkeypatch.setattr(markup, "_PAGES", 7)
    pages = [(k, None if k % 9 == 0 else f"<h1>t{k}</h1><p> </p><ul>" + "<li>é</li>" * (k % 4) + "</ul>") for k in range(60)]
    got = markup.html_blocks(spark.createDataFrame(pages, "page long, html string").repartition(2), "html", "page")
    assert got.columns == ["page", "place", "element", "text"]
    want = [(k, j, e, t) for k, m in pages for j, (e, t) in enumerate(markup.blocks(m))]
    assert sorted(tuple(r) for r in got.collect()) == want


def test_settled_characters():
    """What isn't sent to Python stays as it is in the normal form C, whatever stands before it."""
    ends = [int(h.split("}")[0], 16) for h in text.SETTLED.split(r"\x{")[1:]]
    spans = list(zip(ends[::2], ends[1::2], strict=True))
    seconds = set()
    for c in range(0x110000):
        d = unicodedata.decomposition(chr(c)).split()
        if len(d) == 2 and not d[0].startswith("<"):
            seconds.add(int(d[1], 16))
    assert len(spans) > 5
    for a, b in spans:
        for c in range(a, b + 1):
            assert unicodedata.normalize("NFC", chr(c)) == chr(c) and not unicodedata.combining(chr(c)) and c not in seconds, hex(c)


def test_nfc_asks_python_only_where_needed(spark, monkeypatch):
    cells = [None, "", "abc", "“é” – ñ", "é x", "각", "각", "Å", "日本語 が", "ё й", "😀"]
    out = spark.createDataFrame(list(enumerate(cells)), "k long, t string").select("k", text.nfc(F.col("t")).alias("t"))
    assert {r["k"]: r["t"] for r in out.collect()} == {k: t and unicodedata.normalize("NFC", t) for k, t in enumerate(cells)}
    asked = spark.createDataFrame([("“é” – ñ",), ("é",)], "t string")
    monkeypatch.setattr(text, "_nfc", F.udf(lambda t: t and "asked"))
    assert sorted(r[0] for r in asked.select(text.nfc(F.col("t"))).collect()) == ["asked", "“é” – ñ"]


def test_personal_data_where_none_can_stand(spark):
    """Patterns aren't tried at each place of texts that can't hold them: these boundaries took the one for mail minutes."""
    long = "a-" * 100_000
    start = time.time()
    row = steps.scrub_pii(spark.createDataFrame([(long,)], "t string"), {"columns": ["t"]})
    assert row.df.first()["t"] == long and row.metrics.first()["total_pii_instances"] == 0
    assert time.time() - start < 15


def test_personal_data_equals_the_patterns(spark):
    bits = ["a.B@Example.COM", "(212) 555-1234", "٢١٢-٤٥-٦٧٨٩", "123-45-6789", "4111 1111 1111 1111", "10.0.0.1", "HTTPſ://x.y", "hTTps://x/y?z=1", "WwW.x.org", "www", "12 34", "x@y", "+1 212 555 12345"]
    cells = [None, "", *bits, *(f"{a} {b}" for a in bits for b in bits)]
    df = spark.createDataFrame(list(enumerate(cells)), "k long, t string")
    c, counts, names = F.col("t"), [], list(pii.PATTERNS)
    for e in names:
        counts.append(F.coalesce(F.regexp_count(c, F.lit(pii.java(e))), F.lit(0)).cast("long"))
        c = F.regexp_replace(c, pii.java(e), "[REDACTED]")
    done, per = pii.redacted(F.col("t"), names)
    every = [F.coalesce(F.regexp_count("t", F.lit(pii.java(e))), F.lit(0)).cast("long") for e in names]
    wrong = df.filter(~(done.eqNullSafe(c) & (per == F.array(*counts)) & (pii.counts(F.col("t"), names) == F.array(*every))))
    assert wrong.count() == 0


def test_analysis_counts_once(spark, monkeypatch):
    seen, issues = [], profile.issues
    monkeypatch.setattr(profile, "issues", lambda found, texts: seen.append(found) or issues(found, texts))
    got = profile.analyze(spark.createDataFrame([("mail a@b.com please, it is urgent",)] * 3, "text string"))
    assert got.row_count == 3 and {i["type"] for i in got.issues} == {"duplicates", "pii_detected"}
    assert "Aggregate" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_spaces_and_letters(spark):
    """Equal to the plain patterns."""
    cells = ["", " ", "a b", "a  b", "a\tb", "\t a \t\t b ", "a \t", "Éa1 ß 日本 😀 Ǆ", "x\n\n\n\n y  "]
    df = spark.createDataFrame(list(enumerate(cells)), "k long, t string")
    plain = text.strip(F.regexp_replace(F.regexp_replace("t", r"[ \t]+", " "), r"\n{3,}", "\n\n"))
    m = quality.measures(F.col("t"))
    same = (text.normal_spaces(F.col("t")) == plain) & (m["letters"] == F.regexp_count("t", F.lit(r"\p{L}"))) & (m["capitals"] == F.regexp_count("t", F.lit(r"\p{Lu}")))
    assert df.filter(~same).count() == 0
