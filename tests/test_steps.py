import unicodedata

import pytest
from pyspark.sql import functions as F

from quern.functions import language, pii, quality, text
from quern.operators import semantic, steps
from quern.plans import runner


def texts(spark, *values, name="text"):
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"rid long, {name} string")


def cell(df, c="text"):
    return [r[c] for r in df.orderBy("rid").collect()]


@pytest.mark.parametrize(("conf", "kept"), [({}, [0, 1, 3]), ({"keep": "last"}, [2, 3, 4]), ({"columns": ["text"]}, [0, 1]), ({"columns": ["nope"]}, [0, 1, 3])])
def test_exact_dedup(spark, conf, kept):
    df = spark.createDataFrame([(0, "a", "x"), (1, None, "x"), (2, "a", "x"), (3, "a", None), (4, None, "x")], "rid long, text string, label string")
    conf = {"columns": ["text", "label"], "order_by": "rid", **conf}
    out = steps.deduplicate(df if conf["columns"] != ["nope"] else df.select("text", "label", "rid"), conf)
    got = sorted(r["rid"] for r in out.df.collect())
    assert got == (kept if conf["columns"] != ["nope"] else [0, 1, 2, 3, 4])
    assert bool(out.warnings) == (conf["columns"] == ["nope"])


def test_dedup_compat_joins_text(spark):
    df = spark.createDataFrame([(0, "a|b", "c"), (1, "a", "b|c"), (2, None, "c"), (3, "None", "c")], "rid long, a string, b string")
    conf = {"columns": ["a", "b"], "order_by": "rid"}
    assert steps.deduplicate(df, conf).df.count() == 4
    assert sorted(r["rid"] for r in steps.deduplicate(df, conf | {"compat": True}).df.collect()) == [0, 2]


def test_bad_choice_and_empty_table(spark):
    with pytest.raises(ValueError, match="method"):
        steps.deduplicate(texts(spark, "a"), {"method": "magic"})
    assert steps.deduplicate(texts(spark, "a").limit(0), {"order_by": "rid"}).df.count() == 0


def test_noise_sub_steps(spark):
    odd = ["a b", " x \t y\n\n\n\nz  ", "a\x01b\rc\x7f", "zero​wid­th", unicodedata.normalize("NFD", "é"), "cafÃ©", "<p>Hi <b>you</b></p><script>x()</script>", None, ""]
    got = cell(steps.remove_noise(texts(spark, *odd), {"html_parser": True}).df)
    assert got == ["a b", "x y\n\nz", "ab\rc", "zerowidth", "é", "café", "Hi you", None, ""]


def test_noise_urls_patterns_length(spark):
    df = texts(spark, "see https://a.b/c?d now", "www.x.org [1] ok", "tiny", None)
    out = steps.remove_noise(df, {"strip_urls": True, "custom_patterns": [r"\[\d\]", "("], "min_text_length": 5})
    assert cell(out.df) == ["see  now"]
    assert len(out.warnings) == 1
    assert out.metrics.first()["rows_removed_by_length"] == 3


def test_pii_redaction_is_sequential_and_literal(spark):
    df = texts(spark, "mail a.b@example.com card 4111111111111111 ip 10.0.0.1", "ssn 123-45-6789 http://x.y/z", None, "")
    assert cell(steps.scrub_pii(df, {}).df)[0] == "mail [REDACTED] card [REDACTED]111111 ip [REDACTED]"
    assert cell(steps.scrub_pii(df, {"redact_with": "<ENTITY_TYPE>", "entities": ["SSN", "URL"]}).df)[1] == "ssn <SSN> <URL>"
    assert cell(steps.scrub_pii(df, {"redact_with": r"$1\x", "entities": ["SSN"]}).df)[1] == r"ssn $1\x http://x.y/z"
    assert cell(steps.scrub_pii(df, {"entities": ["REGEX_ONLY"]}).df) == cell(df)
    row = steps.scrub_pii(df, {}).metrics.first()
    assert (row["rows_with_pii"], row["email_count"], row["url_count"]) == (2, 1, 1)


def test_pii_flag_and_remove(spark):
    df = spark.createDataFrame([(0, "1.2.3.4", "a@b.co"), (1, "x", "é123-45-6789"), (2, None, None)], "rid long, a string, b string")
    flagged = steps.scrub_pii(df, {"action": "flag"}).df
    assert cell(flagged, "pii_entities") == ["IP_ADDRESS,EMAIL", "", ""]
    removed = steps.scrub_pii(df, {"action": "remove_row"}).df
    assert cell(removed, "rid") == [1, 2]
    assert removed.columns == df.columns


@pytest.mark.parametrize(
    ("value", "score", "reason"),
    [("", 0.0, "Empty text"), (" \n", 0.0, "Empty text"), ("12345 !!", 4.79, None), ("Go. Go. Go. Then we went away home and slept well.", None, "Repeated sentences (3x)"), ("THIS IS LOUD TEXT WITH ALL LETTERS IN UPPER CASE NOW, READ IT", None, "Excessive caps")],
)
def test_quality_parts(spark, value, score, reason):
    row = steps.score_quality(texts(spark, value), {}).df.first()
    assert 0 <= row["quality_score"] <= 10
    if score == 0.0:
        assert row["quality_score"] == 0.0
    if reason:
        assert reason in row["quality_reason"]


def test_quality_actions_and_summary(spark):
    df = texts(spark, "A normal sentence about things, with words enough to be of a fair length.", "bad", "x" * 21000, "")
    assert steps.score_quality(df, {"action": "filter", "threshold": 8.0}).df.count() == 1
    assert steps.score_quality(df, {"action": "flag", "threshold": 5.0}).df.filter("quality_flag").count() >= 1
    m = steps.score_quality(df, {}).metrics.first()
    assert sum(m[k] for k in m.asDict() if k.startswith("bin")) == 4
    scores = sorted(r["quality_score"] for r in steps.score_quality(df, {}).df.collect())
    assert m["median_quality_score"] == scores[2]
    assert steps.score_quality(df.select("rid"), {}).df.first()["quality_reason"] == "No text columns"


def test_quality_with_a_scorer(spark):
    df = texts(spark, "A normal sentence about things.")
    conf = {"method": "ai", "scorer": lambda part: [(7.0, "fine")] * len(part)}
    assert steps.score_quality(df, conf).df.first()["quality_score"] == 7.0

    def broken(part):
        raise RuntimeError

    assert "(fallback)" in steps.score_quality(df, {"method": "ai", "scorer": broken}).df.first()["quality_reason"]


def test_language(spark):
    df = texts(spark, "the cat and the dog of that house", "le chat et les chiens dans une maison", "short", None)
    assert cell(steps.filter_language(df, {}).df, "language") == ["en", "fr", "unknown", "unknown"]
    assert cell(steps.filter_language(df, {"action": "filter_remove", "languages": ["unknown"]}).df, "rid") == [0, 1]
    assert set(language.FUNCTION_WORDS) == {"de", "en", "es", "fr"}


@pytest.mark.parametrize(
    ("asked", "said", "score"),
    [("Tell me more", "one two three four five six seven eight nine ten.", 10.0), ("Two words", "one two three four five six seven eight nine ten.", 5.0), ("Tell me more", "Short.", 5.0), ("Tell me more", "w " * 2000 + "end.", 8.0), ("Tell me more", "I CANNOT do this as it would be far too much work now.", 2.0), ("Tell me more", "one two three four five six seven eight nine ten", 7.0), ("a", "   ", 0.0), ("a", "", 0.0)],
)
def test_response_quality(spark, asked, said, score):
    s, _ = quality.response(F.lit(asked), F.lit(said))
    assert spark.range(1).select(s.alias("s")).first()["s"] == score


def test_runner_skips_and_reports(spark):
    df = texts(spark, "hello   world", "hello   world", name="text")
    seen = []
    result = runner.run(df, [{"step": "nope"}, {"step": "deduplication", "config": {"columns": ["text"], "order_by": "rid"}}, {"step": "quality_scorer", "config": {"action": "bad"}}, {"step": "noise_removal"}], lambda p, s, m: seen.append((p, s, m)))
    assert cell(result.df) == ["hello world"]
    assert result.stats == {"steps_executed": 4, "steps_skipped": 2}
    assert len(result.warnings) == 2
    assert seen[0] == (0, "nope", "started")
    assert seen[-1][0] == 100
    assert result.counts() == {"rows_before": 2, "rows_after": 1, "rows_removed": 1}
    assert runner.run(df, []).df.count() == 2


def test_semantic_greedy_in_row_order(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 6)], "a long, b long")
    assert sorted(r["id"] for r in semantic.removed(links).collect()) == [2, 4, 6]
    assert sorted(r["id"] for r in semantic.removed(links, "last").collect()) == [1, 2, 3, 5]


def test_idempotent_clean_up(spark):
    df = texts(spark, "a \t b\n\n\n\nc ​ x\x01")
    once = steps.remove_noise(df, {}).df
    assert cell(steps.remove_noise(once, {}).df) == cell(once)
    assert pii.selected(["URL", "EMAIL"]) == ["EMAIL", "URL"]
    assert text.html_text("<p>a<br>b") == "a b"


def test_clashing_inner_names_come_back(spark):
    from quern.operators import sampling, semantic

    names = ["_n", "_g", "_m", "_h", "_p", "_i", "_gone", "_place_0", "_guess_0", "_measures_0", "_was_text_0", "_part_0"]
    df = spark.createDataFrame([(k, f"a text of number {k % 3} < b >", [1.0, float(k)]) for k in range(9)], "id long, text string, v array<double>").withColumns({c: F.lit(k) for k, c in enumerate(names)})
    outs = [
        steps.deduplicate(df, {"columns": ["text"], "order_by": "id"}).df,
        steps.remove_noise(df, {"columns": ["text"]}).df,
        steps.filter_language(df, {"text_column": "text"}).df,
        steps.score_quality(df, {"text_columns": ["text"]}).df,
        sampling.ranked(df, 1, "id", "rank", ["text"]),
        semantic.deduplicate(df, id_column="id", vector_column="v", threshold=0.99),
    ]
    for out in outs:
        assert out.count() > 0 and all([r[c] for c in names] == list(range(len(names))) for r in out.collect())


def test_markup_is_counted_where_it_changes_a_cell(spark):
    df = spark.createDataFrame([("a < b > c",), ("a <b>c</b>",), ("none",), (None,), ("x < &amp; >",)], "text string")
    assert steps.remove_noise(df, {"columns": ["text"]}).metrics.first()["html_stripped"] == 2


def test_scorer_is_asked_again(spark, tmp_path):
    def scorer(texts, folder=str(tmp_path)):
        import os

        n = len(os.listdir(folder))
        open(f"{folder}/{n}", "w").close()
        if n < 2:
            raise RuntimeError("busy")
        return [(9.0, "good")] * len(texts)

    df = spark.createDataFrame([("some text here",)], "text string").coalesce(1)
    out = steps.score_quality(df, {"text_columns": ["text"], "method": "ai", "scorer": scorer, "ai_batch_delay": 0.01}).df
    assert out.select("quality_score").toPandas().quality_score[0] == 9.0
