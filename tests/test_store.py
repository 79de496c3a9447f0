"""Files in a store, through Hadoop's own interface."""

import pytest
from pyspark.sql import functions as F

from quern.sources import readers


def test_chunks_are_streamed(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"chunk_{k:05d}").write_bytes(bytes([65 + k]) * 1000)
    target = tmp_path / "out" / "whole.bin"
    assert readers.join_chunks(spark, str(tmp_path), 3, str(target)) == 3000
    assert target.read_bytes() == b"A" * 1000 + b"B" * 1000 + b"C" * 1000 == readers.join_chunks(spark, str(tmp_path), 3)
    with pytest.raises(readers.IngestionError, match="chunk 3"):
        readers.join_chunks(spark, str(tmp_path), 4, str(target))


def test_copies(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("one")
    readers.copy(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert (tmp_path / "b" / "x.txt").read_text() == "one"
    (tmp_path / "a" / "x.txt").write_text("two")
    readers.copy(spark, str(tmp_path / "a" / "x.txt"), str(tmp_path / "b" / "x.txt"))
    assert (tmp_path / "b" / "x.txt").read_text() == "two"
    with pytest.raises(readers.IngestionError):
        readers.copy(spark, str(tmp_path / "no"), str(tmp_path / "b"))


def test_fetch_keeps_columns(spark):
    df = spark.createDataFrame([(1, "http://a/x.csv"), (2, "http://b"), (3, None)], "id long, url string").withColumns({"title": F.lit("old"), "a.b": F.lit(4), "_fetched_0": F.lit(5)})

    def get(url):
        return ("text/csv", b"1,2") if url.endswith("csv") else ("text/html", b"<title>T</title><main>body</main>")

    got = {r["id"]: r for r in readers.fetch(df, get).collect()}
    assert (got[1]["kind"], got[1]["content"], got[2]["title"], got[2]["content"]) == ("file", "1,2", "T", "body") and got[3]["error"]
    assert all(r["a.b"] == 4 and r["_fetched_0"] == 5 for r in got.values())
