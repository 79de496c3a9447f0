"""The inverted file against brute force: links, nearest rows, recall of approximate search, groups of equal vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import semantic


def cloud(n=400, d=24, seed=3):
    """Clusters of several widths, some vectors twice and thrice."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, d))
    v = centres[rng.integers(0, 20, n)] + rng.standard_normal((n, d)) * rng.choice([0.05, 0.2, 0.5], (n, 1))
    v[50:60], v[60:70] = v[:10], v[:10]
    return v


def frame(spark, v, first=0):
    rows = [(first + k, [float(x) for x in r]) for k, r in enumerate(v)]
    odd = [(10_000, None), (10_001, []), (10_002, [0.0] * v.shape[1]), (10_003, [float("nan")] * v.shape[1]), (10_004, [None] * v.shape[1]), (None, rows[0][1])]
    return spark.createDataFrame(rows + odd, "id long, v array<double>").repartition(3)


def cosines(v):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    return u @ u.T


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(semantic, "BLOCK", 40)


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.95])
def test_links_are_whole(spark, small_blocks, threshold):
    v = cloud()
    c = cosines(v)
    _, rep = np.unique(v, axis=0, return_inverse=True)
    least = {k: int(np.flatnonzero(rep == k)[0]) for k in set(rep)}
    reps = sorted(least.values())
    want = {(a, b) for i, a in enumerate(reps) for b in reps[i + 1 :] if c[a, b] >= threshold}
    want |= {(least[r], k) for k, r in enumerate(rep) if least[r] != k}
    got = semantic.edges(frame(spark, v), id_column="id", vector_column="v", threshold=threshold).collect()
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)
    assert all(abs(r["similarity"] - c[r["a"], r["b"]]) < 1e-9 for r in got)


@pytest.mark.parametrize("threshold", [0.8, 0.9, 0.95])
def test_recall_with_few_lists(spark, threshold):
    v = cloud(1500)
    df = frame(spark, v)
    all_of = lambda **o: {(r["a"], r["b"]) for r in semantic.edges(df, id_column="id", vector_column="v", threshold=threshold, **o).collect()}
    whole, some = all_of(), all_of(probes=4)
    assert some <= whole and len(some) >= 0.9 * len(whole) > 0


def brute_nearest(v, asks, k):
    c = np.round(cosines(v), 12)
    return {q: [(int(j), float(c[q, j])) for j in sorted(range(len(v)), key=lambda j: (-c[q, j], j)) if j != q][:k] for q in asks}


def by_row(found):
    out = {}
    for r in found.orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append((r["neighbour"], r["similarity"]))
        assert r["rank"] == len(out[r["id"]])
    return out


@pytest.mark.parametrize("k", [1, 10])
def test_nearest_equal_brute_force(spark, small_blocks, k):
    v = cloud()
    df = frame(spark, v)
    for queries, asks in ((None, range(len(v))), (df.filter("id % 20 = 0"), range(0, len(v), 20))):
        got = by_row(semantic.nearest(df, queries, id_column="id", vector_column="v", k=k, probes=2))
        want = brute_nearest(v, asks, k)
        asked = {q: got[q] for q in asks} if queries is None else {q: x for q, x in got.items() if q < 10_000}
        assert {q: [j for j, _ in x] for q, x in asked.items()} == {q: [j for j, _ in x] for q, x in want.items()}
        assert all(abs(a[1] - b[1]) < 1e-9 for q in asks for a, b in zip(asked[q], want[q], strict=True))


def test_recall_of_approximate_nearest(spark):
    v = cloud(1500, seed=9)
    got = by_row(semantic.nearest(frame(spark, v), frame(spark, v).filter("id % 20 = 0"), id_column="id", vector_column="v", probes=8, exact=False))
    want = brute_nearest(v, range(0, len(v), 20), 10)
    found = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert found >= 0.9 * sum(map(len, want.values()))


def test_equal_vectors_cost_a_row_each(spark):
    n = 3000
    df = spark.createDataFrame([(k, [1.0, 2.0, 3.0]) for k in range(n)] + [(n + k, [float(k), 1.0, -1.0]) for k in range(50)], "id long, v array<double>")
    assert semantic.edges(df.filter(f"id < {n}"), id_column="id", vector_column="v").count() == n - 1
    assert sorted(r["id"] for r in semantic.deduplicate(df, id_column="id", vector_column="v", threshold=0.99999).collect())[:2] == [0, n]
    near = by_row(semantic.nearest(df, id_column="id", vector_column="v", k=3))
    assert [j for j, _ in near[0]] == [1, 2, 3] and [j for j, _ in near[2]] == [0, 1, 3] and len(near) == n + 50


def greedy(v, threshold, keep):
    c, gone = cosines(v) >= threshold, set()
    order = range(len(v)) if keep == "first" else range(len(v) - 1, -1, -1)
    for i in range(len(v)):
        if keep == "last":
            if c[i, i + 1 :].any():
                gone.add(i)
        elif i not in gone:
            gone |= {int(j) for j in np.flatnonzero(c[i, i + 1 :]) + i + 1}
    return [i for i in sorted(order) if i not in gone]


@pytest.mark.parametrize("keep", ["first", "last"])
def test_greedy_removal(spark, keep):
    v = cloud(300, d=8, seed=4)
    v[100], v[1] = v[1] * 1.0, v[1]
    out = semantic.deduplicate(frame(spark, v).withColumns({"a.b": F.lit(1), "gone": F.lit(2)}), id_column="id", vector_column="v", threshold=0.9, keep=keep)
    assert sorted(r["id"] for r in out.collect() if r["id"] is not None and r["id"] < 10_000) == greedy(v, 0.9, keep)
    assert out.filter("id is null or id >= 10000").count() == 6 and out.columns == ["id", "v", "a.b", "gone"]


def test_only_the_nearest_are_linked(spark):
    v = np.tile([1.0, 0.0], (60, 1)) + np.arange(60)[:, None] * np.array([[0.0, 1e-4]])
    stay = semantic.deduplicate(frame(spark, v), id_column="id", vector_column="v", threshold=0.95, neighbours=10).filter("id < 1000").count()
    assert 6 <= stay <= 20
    assert semantic.deduplicate(frame(spark, v), id_column="id", vector_column="v", threshold=0.95).filter("id < 1000").count() == 1


def test_no_vectors_and_other_lengths(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id long, v array<double>")
    with pytest.raises(ValueError, match="1 to 2"):
        semantic.edges(df, id_column="id", vector_column="v")
    assert semantic.edges(df.limit(0), id_column="id", vector_column="v").count() == 0
    assert semantic.nearest(df.limit(0), id_column="id", vector_column="v").count() == 0
    assert semantic.deduplicate(df.filter("id = 1"), id_column="id", vector_column="v").count() == 1


def test_vectors_go_to_few_groups(spark, monkeypatch):
    """Unclustered vectors ask nearly every list; they are sent to groups of lists, whose number doesn't grow with the lists'."""
    monkeypatch.setattr(semantic, "LEAST", 40)
    v = np.random.default_rng(7).standard_normal((900, 16))
    rows = semantic.vectors(frame(spark, v), "id", "v")
    index = semantic.build(rows)
    lists = index.lists
    assert len(lists.centroids) == 30 and len(lists.blocks) <= 2 * semantic.GROUPS and (lists.blocks >= 1).all()
    sizes = index.table.groupBy("list").count().collect()
    held = np.bincount([lists.group[r["list"]] for r in sizes], [r["count"] for r in sizes])
    assert (held <= lists.blocks * lists.block).all() and held.sum() == index.table.count()
    index.discard()
    c = cosines(v)
    got = semantic.edges(frame(spark, v), id_column="id", vector_column="v", threshold=0.7).filter("b < 10000").collect()
    assert {(r["a"], r["b"]) for r in got} == {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(c >= 0.7, 1)), strict=True)}
