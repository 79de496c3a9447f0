"""Every step and operator on tables whose columns have dots, backticks and names of the kind that steps make for themselves."""

import pytest
from pyspark.sql import functions as F

from quern.operators import finetune, profile, sampling
from quern.operators import steps as core
from quern.plans import runner
from quern.sources import catalog, readers

EXTRA = ["a.b", "a`c", "_r", "_n", "_c", "_k", "_d", "_v", "_t", "_s", "_p", "_rank_0", "_place_0", "_guess_0", "_measures_0", "_was0_0", "split"]
TEXT = "Mail me at bob@example.com or see http://example.org/x, the end of it all is near and that is fine."


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, f"{TEXT} {k % 7}", f"note.{k % 3} <b>x</b>", ("A", "B", "B")[k % 3]) for k in range(30)]
    df = spark.createDataFrame(rows, "`doc.id` long, `meta.text` string, `x.y` string, `c.at` string")
    return df.withColumns({c: F.lit(f"kept {c}") if k % 2 else F.lit(k) for k, c in enumerate(EXTRA)})


CONFIGS = [
    ("deduplication", {"columns": ["meta.text"], "order_by": "doc.id"}, 7),
    ("deduplication", {"order_by": "doc.id"}, 30),
    ("deduplication", {"columns": ["meta.text", "x.y"], "compat": True, "order_by": "doc.id", "keep": "last"}, 21),
    ("noise_removal", {}, 30),
    ("noise_removal", {"columns": ["meta.text"], "min_text_length": 5}, 30),
    ("pii_scrubbing", {}, 30),
    ("pii_scrubbing", {"action": "flag"}, 30),
    ("pii_scrubbing", {"action": "remove_row"}, 0),
    ("language_filter", {"action": "filter_keep", "tag_column_name": "the.tag"}, 30),
    ("quality_scorer", {"score_column_name": "q.score", "reason_column_name": "q.why", "action": "filter", "threshold": 1.0}, 30),
]


@pytest.mark.parametrize(("name", "conf", "rows"), CONFIGS)
def test_steps(odd, name, conf, rows):
    result = runner.run(odd, [{"step": name, "config": conf}])
    assert result.stats["steps_skipped"] == 0 and not result.warnings
    found = result.df.collect()
    assert len(found) == rows and set(odd.columns) <= set(result.df.columns)
    cleaned = name in ("noise_removal", "pii_scrubbing")
    assert all(r[c] == (f"kept {c}" if k % 2 else k) for r in found for k, c in enumerate(EXTRA) if not (cleaned and k % 2))
    result.metrics()


def test_redaction_of_a_nested_object(spark, tmp_path):
    file = tmp_path / "one.json"
    file.write_text('{"text": "mail me at bob@example.com please", "meta": {"x": "abc", "mail": "eve@example.com"}}')
    df = readers.read(spark, str(file), "json")
    assert "meta.x" in df.columns
    row = runner.run(df, [{"step": "pii_scrubbing"}]).df.first()
    assert row["text"] == "mail me at [REDACTED] please" and row["meta.mail"] == "[REDACTED]" and row["meta.x"] == "abc"


@pytest.mark.parametrize("method", ["undersample", "oversample"])
def test_balance(odd, method):
    out = sampling.balance(odd, {"target_column": "c.at", "id_column": "doc.id", "method": method})
    assert {r[0]: r[1] for r in out.metrics.collect()} == dict.fromkeys("AB", 10 if method == "undersample" else 20)
    assert out.df.columns == odd.columns and all(r["_r"] == 2 and r["_n"] == "kept _n" and r["a.b"] == 0 for r in out.df.collect())


@pytest.mark.parametrize("stratify", [None, "c.at"])
def test_split(odd, stratify):
    out = sampling.split(odd, id_column="doc.id", stratify=stratify)
    rows = out.collect()
    assert sorted(r["split"] for r in rows) == ["train"] * 27 + ["val"] * 3
    assert set(out.columns) == set(odd.columns) and all(r["_r"] == 2 and r["_k"] == "kept _k" and r["_v"] == "kept _v" for r in rows)


def test_profiles(odd):
    assert {r["column"] for r in profile.column_stats(odd).collect()} == set(odd.columns)
    assert profile.analyze(odd).row_count == 30
    assert profile.token_total(odd).first()[0] > 0
    assert profile.sample_values(odd, "meta.text", 2, "doc.id") == [f"{TEXT} 0", f"{TEXT} 1"]
    assert sampling.category_column(odd.select("`c.at`", "`a.b`")) == "c.at"
    assert profile.table_language(odd.select("`meta.text`", "`doc.id`"), "doc.id")
    assert readers.preview(odd, 3, "doc.id").count() == 3
    assert catalog.page(odd, order_by="doc.id", limit=2).count() == 2


def test_tuning_steps(odd):
    out = finetune.format_examples(odd, {"input_format": "raw_pairs"})
    assert out.df.count() == 30 and set(odd.columns) <= set(out.df.columns)
    scored = finetune.response_quality(odd.select("`meta.text`", "`x.y`", "`a.b`"), {"action": "score"}).df
    assert scored.count() == 30
