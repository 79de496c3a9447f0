"""The stages one by one on their own inputs, and the SQL of the queries that have it."""

from numbers import Number

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import queries, sql

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k + 1 < len(corpus_pipeline.STAGES):
            out = corpus_pipeline.cut(out, "test")
            assert out.columns == names, name
            before, after = docs.count(), out.count()
            assert 0.8 * before <= after <= before, name
            assert out.select("doc_id").distinct().count() == after
        docs = out
    assert docs.select("doc_id").distinct().count() == after


def awkward(spark):
    from .fixtures import frame, prose
    import random

    rng = random.Random(3)
    rows = [(k, f"The {prose(rng, 60)} and of the text. " * (1 + k % 2), "en", "s", k) for k in range(30)]
    rows += [rows[3], (40, rows[4][1], None, None, None), (None, None, None, None, None), (None, rows[5][1], "en", "s", 1), (41, None, "en", "s", 0), (42, "", "en", "s", 0), (43, " \n ", None, "s", 3), (44, "123 !", None, "s", 5), (45, "word " * 200_000, "en", "s", 1)]
    return frame(spark, rows).withColumns({c: F.lit(7) for c in ("_r", "key", "residue_0", "gone_0", "language_0", "lang_pred", "removed_lines", "said_0", "a.b", "a`c")})


@pytest.mark.parametrize(("k", "gone"), [(0, {41, 42, 43, 44}), (1, {40, 5}), (2, {40}), (3, set())])
def test_stages_on_awkward_rows(spark, k, gone):
    docs = awkward(spark)
    out = corpus_pipeline.STAGES[k][1](spark, docs, SF)
    assert out.columns == docs.columns
    rows = out.collect()
    ids = {r["doc_id"] for r in rows}
    assert not gone & ids and set(range(30)) - gone <= ids and 45 in ids
    assert all(r[c] == 7 for r in rows for c in ("_r", "key", "residue_0", "gone_0", "language_0", "lang_pred", "removed_lines", "said_0", "a.b", "a`c"))
    assert corpus_pipeline.STAGES[k][1](spark, docs.limit(0), SF).count() == 0


def test_packing_stage_on_awkward_rows(spark):
    docs = awkward(spark)
    out = corpus_pipeline.pack_windows(spark, docs, SF).toPandas()
    assert set(out.doc_id.dropna()) == {*range(30), *range(40, 46)} and out.doc_id.isna().sum() == 2
    assert corpus_pipeline.pack_windows(spark, docs.limit(0), SF).count() == 0


def test_run_is_its_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


@pytest.mark.parametrize("name", sorted(sql.ORACLE))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "clicks", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), c.execute(sql.ORACLE[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    one = lambda v: None if pd.isna(v) else int(v) if isinstance(v, Number) else str(v)
    clean = lambda f: sorted([[one(v) for v in r] for r in f[columns].itertuples(index=False)], key=str)
    assert clean(ours) == clean(theirs)


def test_queries_cover_all():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == [*range(1, 14)]
