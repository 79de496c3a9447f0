"""Exact counts by class and exact splits, in a seeded order that doesn't depend on partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.names import col, cols, fresh
from quern.operators.steps import StepOutput

#: Parts of the hash range that ranks are counted in.
PARTS = 4096


def seeded(seed: int, *keys: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *(col(k).cast("string") for k in keys)), 256)


def ranked(df: DataFrame, seed: int, id_column: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Adds each row's rank, from 1, in the seeded order (within groups ``by``). Rows are ranked in parts of the hash range and offset by the counts of the parts before, so a group of any size is spread."""
    by = by or []
    h, p, n, q, b, i, *k = fresh(df, "hash", "part", "n", "of", "before", "inside", *(f"by{j}" for j in range(len(by))))
    rows = df.withColumn(h, seeded(seed, id_column)).withColumn(p, F.conv(F.substring(h, 1, 3), 16, 10).cast("int"))
    counts = rows.groupBy(*cols(by), p).agg(F.count("*").alias(n))
    before = counts.withColumn(b, F.sum(n).over(Window.partitionBy(*cols(by)).orderBy(p)) - F.col(n))
    inside = F.row_number().over(Window.partitionBy(*cols(by), p).orderBy(h, col(id_column)))
    named = before.select(*(col(c).alias(name) for c, name in zip(by, k, strict=True)), F.col(p).alias(q), b)
    same = F.col(p) == F.col(q)
    for c, name in zip(by, k, strict=True):
        same &= col(c).eqNullSafe(F.col(name))
    placed = rows.withColumn(i, inside).join(named, same)
    return placed.withColumn(out, F.col(b) + F.col(i)).select(*cols(df.columns), out)


def category_column(df: DataFrame) -> str | None:
    """The string column with the fewest values, 2 to 50; the first of equals. Sketches tell which columns may have that few; only these are counted exactly."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and not f.name.startswith("_")]
    if not names:
        return None
    about = df.agg(*(F.approx_count_distinct(col(c)) for c in names)).first()
    names = [c for c, n in zip(names, about, strict=True) if n <= 100]
    if not names:
        return None
    n = dict(zip(names, df.agg(*(F.count_distinct(col(c)) for c in names)).first(), strict=True))
    fit = [c for c in names if 1 < n[c] <= 50]
    return min(fit, key=lambda c: n[c]) if fit else None


def balance(df: DataFrame, conf: dict) -> StepOutput:
    """Under- or oversampling to exact counts; rows without a category go. ``augment`` is oversampling, and says so."""
    method, warnings = conf.get("method", "undersample"), []
    if method == "augment":
        method = "oversample"
        warnings.append("Augmentation needs a generator; oversampling instead.")
    if method not in ("undersample", "oversample"):
        raise ValueError(f"unknown method {method!r}")
    column, key, seed = conf.get("target_column", "auto"), conf["id_column"], conf.get("seed", 42)
    column = category_column(df) if column == "auto" else column
    if column not in df.columns:
        return StepOutput(df, None, [*warnings, "No category column; nothing is balanced."], {"status": "skipped"})
    n, rank, slot, name, draw = fresh(df, "n", "rank", "slot", "name", "draw")
    known = df.filter(col(column).isNotNull())
    counts = known.groupBy(col(column)).agg(F.count("*").alias(n))
    ends = counts.agg(F.min(n).alias("a"), F.max(n).alias("b")).first()
    if ends["a"] is None:
        return StepOutput(df, None, [*warnings, "The category column is empty; nothing is balanced."], {"status": "skipped"})
    most, least = conf.get("max_per_category"), conf.get("min_per_category")
    if method == "undersample":
        target = max(1, int((min(most, ends["a"]) if most else ends["a"]) / conf.get("balance_ratio", 1.0)))
    else:
        target = max(ends["b"], least or 0)
        target = min(target, most) if most else target
    numbered = ranked(known, seed, key, rank, [column])
    out = numbered.filter(F.col(rank) <= target)
    if method == "oversample":
        # a draw with replacement for each missing row: the slot's hash names the rank that is taken again
        slots = counts.filter(F.col(n) < target).withColumn(slot, F.explode(F.sequence(F.lit(1), F.lit(target) - F.col(n))))
        drawn = F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), col(column), F.col(slot).cast("string")), 256), 1, 15), 16, 10).cast("long"), F.col(n)) + 1
        slots = slots.select(col(column).alias(name), drawn.alias(draw))
        out = out.unionByName(numbered.join(slots, (col(column) == F.col(name)) & (F.col(rank) == F.col(draw))).select(*cols(numbered.columns)))
    return StepOutput(out.drop(rank), out.groupBy(col(column)).agg(F.count("*").alias("rows")), warnings, {"category_column": column, "method": method, "target": target})


def split(df: DataFrame, *, id_column: str, train: float = 0.9, val: float = 0.1, seed: int = 42, stratify: str | None = None) -> DataFrame:
    """Adds ``split``: train or val, with ceil(val * n) and floor(train * n) rows; others go. Fewer than two rows are all train. Strata get shares by the largest remainder, the first by name of equals; a stratum of one row turns stratification off. A column of that name is replaced."""
    rank, name, v, t = fresh(df, "rank", "name", "val", "train")
    n, others = df.count(), [c for c in df.columns if c.lower() != "split"]
    if n < 2:
        return df.withColumn("split", F.lit("train"))
    n_val, n_train = math.ceil(val * n - 1e-9), math.floor(train * n + 1e-9)
    if stratify:
        sizes = {r[0]: r[1] for r in df.groupBy(col(stratify)).count().collect()}  # one row for each class
        if len(sizes) > 1 and min(sizes.values()) > 1 and None not in sizes:
            give = _shares(sizes, n_val, n)
            rest = _shares({k: v - give[k] for k, v in sizes.items()}, n_train, n - n_val)
            plan = df.sparkSession.createDataFrame([(k, give[k], rest[k]) for k in sizes], f"{name} {dict(df.dtypes)[stratify]}, {v} long, {t} long")
            placed = ranked(df, seed, id_column, rank, [stratify]).join(F.broadcast(plan), col(stratify) == F.col(name))
            named = placed.withColumn("split", F.when(F.col(rank) <= F.col(v), "val").when(F.col(rank) <= F.col(v) + F.col(t), "train"))
            return named.filter("split is not null").select(*cols(others), "split")
    placed = ranked(df, seed, id_column, rank)
    named = placed.withColumn("split", F.when(F.col(rank) <= n_val, "val").when(F.col(rank) <= n_val + n_train, "train"))
    return named.filter("split is not null").select(*cols(others), "split")


def _shares(sizes: dict, total: int, n: int) -> dict:
    exact = {k: total * v / n for k, v in sizes.items()} if n else dict.fromkeys(sizes, 0)
    out = {k: math.floor(x) for k, x in exact.items()}
    for k in sorted(sizes, key=lambda k: (-(exact[k] - out[k]), str(k)))[: total - sum(out.values())]:
        out[k] += 1
    return out
