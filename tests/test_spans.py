"""Merged spans against brute force, and the step with a recogniser."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quern.functions import spans
from quern.operators import steps
from quern.plans import runner

NAMES = {"Ann Lee": "PERSON", "Berlin": "LOCATION", "Müller 😀": "PERSON"}


def recogniser(texts):
    return [[(e, t.find(n), t.find(n) + len(n), 0.9) for n, e in NAMES.items() if n in t] + [("PERSON", 5, 1, 1.0), ("PERSON", 0, 10_000, 1.0)] for t in texts]


def worth(found):
    return sum(p * (b - a) for _, a, b, p in found)


def test_best_equals_all_subsets():
    rng = random.Random(1)
    for _ in range(300):
        some = [(rng.choice("ABC"), a, a + rng.randrange(1, 9), rng.choice([0.2, 0.5, 0.5, 0.9])) for a in (rng.randrange(20) for _ in range(rng.randrange(9)))]
        got = spans.best(some)
        free = lambda x: all(p[2] <= q[1] for p, q in itertools.pairwise(sorted(x, key=lambda s: s[1])))
        most = max((worth(c) for k in range(len(some) + 1) for c in itertools.combinations(some, k) if free(c)), default=0)
        assert free(got) and set(got) <= set(some) and abs(worth(got) - most) < 1e-9
        assert got == sorted(got, key=lambda s: s[1])
    assert spans.best([]) == [] and spans.best([("A", 3, 3, 1.0), ("A", 1, 2, 0.0)]) == []


def rows(spark):
    texts = ["Ann Lee lives in Berlin, ann@example.com.", "😀 Müller 😀 called 212-555-0123", "nothing here", "", None, "see http://Berlin.example.org/Ann Lee"]
    return spark.createDataFrame(list(enumerate(texts)), "rid long, text string").withColumns({"a.b": F.lit(1), "_spans0_0": F.lit(2)})


def test_redact(spark):
    conf = {"recogniser": recogniser, "columns": ["text"], "redact_with": "<ENTITY_TYPE>"}
    out = runner.run(rows(spark), [{"step": "pii_scrubbing", "config": conf}])
    got = [r["text"] for r in out.df.orderBy("rid").collect()]
    assert got == ["<PERSON> lives in <LOCATION>, <EMAIL>.", "😀 <PERSON> called <PHONE>", "nothing here", "", None, "see <URL> Lee"]
    assert out.df.columns == ["rid", "text", "a.b", "_spans0_0"]
    assert out.metrics()[0] == [{"rows_with_pii": 3, "total_pii_instances": 6}]
    assert {r["entity"]: r["instances"] for r in out.steps[0]["details"]["entities_found"].collect()} == {"PERSON": 2, "LOCATION": 1, "EMAIL": 1, "PHONE": 1, "URL": 1}


@pytest.mark.parametrize(("conf", "want"), [({"action": "flag"}, ["PERSON,LOCATION,EMAIL", "PERSON,PHONE", "", "", "", "URL"]), ({"action": "flag", "entities": ["LOCATION", "PHONE"]}, ["LOCATION", "PHONE", "", "", "", "LOCATION"]), ({"action": "flag", "min_score": 0.95}, ["EMAIL", "PHONE", "", "", "", "URL"])])
def test_flag(spark, conf, want):
    out = steps.scrub_pii(rows(spark), {"recogniser": recogniser, **conf}).df.orderBy("rid").collect()
    assert [r["pii_entities"] for r in out] == want and [r["pii_detected"] for r in out] == [bool(w) for w in want]


def test_remove_rows_and_empty(spark):
    out = steps.scrub_pii(rows(spark), {"recogniser": recogniser, "action": "remove_row"}).df
    assert sorted(r["rid"] for r in out.collect()) == [2, 3, 4] and out.columns == ["rid", "text", "a.b", "_spans0_0"]
    assert steps.scrub_pii(rows(spark).limit(0), {"recogniser": recogniser}).df.count() == 0
