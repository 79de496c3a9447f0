"""Ordered funnels over a reusable table of successor edges.

An edge leads from a row to the client's earliest later row of a given kind. ``edges`` makes them
once for all pairs of kinds that some funnel has in succession, each with one flag for every
excluded kind that lies on the way; funnels are then composed from edges. Attempts that have come to
the same row go on together: they are one row with a weight, so each step is a join of two tables by
client and time, and what a step keeps for its percentile is a weighted histogram of times.

A client's rows are dealt by slices of time, with the rows of the next slice that an edge may still
reach, so a client with a third of all rows is spread like the others. Percentiles are selected in
two steps, first the range of 2^15 microseconds that holds the rank and then the time in it, so no
task gathers a client's times either.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.names import quoted

from .common import cut, discard

MINUTE = 60_000_000
#: Times in a range of a histogram.
_RANGE = 1 << 15


@dataclass(frozen=True)
class Funnel:
    """Kinds in their order, and kinds of which no row may lie between two steps."""

    name: str
    steps: tuple[str, ...]
    excluding: tuple[str, ...] = ()


def micros(ts: Column, kind: str) -> Column:
    """Microseconds since 1970: of a timestamp without a zone by its own fields, whatever the session's zone."""
    if kind == "timestamp_ntz":
        clock = (F.hour(ts) * 60 + F.minute(ts)).cast("long") * MINUTE + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")
        return F.unix_date(ts.cast("date")).cast("long") * (1440 * MINUTE) + clock
    return F.unix_micros(ts.cast("timestamp"))


def pairs_of(funnels: list[Funnel]) -> tuple[list[tuple[str, str]], list[str]]:
    """The distinct pairs of kinds in succession, and the excluded kinds."""
    pairs = {p: None for f in funnels for p in zip(f.steps, f.steps[1:], strict=False)}
    return list(pairs), sorted({x for f in funnels for x in f.excluding})


def _check(funnels: list[Funnel]) -> None:
    if len({f.name for f in funnels}) != len(funnels) or any(len(f.steps) < 2 for f in funnels):
        raise ValueError("funnels need different names and two steps at least")
    if len(pairs_of(funnels)[1]) > 62:
        raise ValueError("at most 62 kinds can be excluded")


def edges(rows: DataFrame, funnels: list[Funnel], *, within: int = 15 * MINUTE, part: int = 60 * MINUTE) -> DataFrame:
    """(pair, client, since, until, over) of distinct ``rows`` (client, kind, at): ``until`` is the time of the earliest later row of the pair's second kind, if that is at most ``within`` later; bit k of ``over`` tells that a row of the k-th excluded kind lies after ``since`` and not after ``until``. Rows without such a successor have an edge with a null ``until`` only in pairs that open a funnel."""
    _check(funnels)
    pairs, excluded = pairs_of(funnels)
    opening = {f.steps[:2] for f in funnels}
    part = max(part, within)
    kinds = sorted({k for p in pairs for k in p} | set(excluded))
    into = F.pmod(F.col("at"), F.lit(part))
    own = F.col("at") - into
    # a row is also looked at in the slice before, from whose end an edge may reach it
    dealt = rows.filter(F.col("kind").isin(kinds)).select("client", "kind", "at", F.explode(F.when(into < within, F.array(own, own - part)).otherwise(F.array(own))).alias("part"))
    dealt = dealt.repartition("client", "part").dropDuplicates(["client", "part", "kind", "at"])
    # from the last row to the first, so that the earliest later row is a running minimum
    later = Window.partitionBy("client", "part").orderBy(F.col("at").desc()).rangeBetween(Window.unboundedPreceding, -1)
    after = {k: f"after{i}" for i, k in enumerate(kinds)}
    found = dealt.select("*", *(F.min(F.when(F.col("kind") == k, F.col("at"))).over(later).alias(a) for k, a in after.items())).filter(F.col("part") == own)

    def edge(n: int, to: str) -> Column:
        until = F.when(F.col(after[to]) - F.col("at") <= within, F.col(after[to]))
        over = F.lit(0).cast("long")
        for bit, x in enumerate(excluded):
            over = over + F.when(F.col(after[x]) <= until, F.lit(1 << bit)).otherwise(0).cast("long")
        return F.struct(F.lit(n).alias("pair"), F.col("client"), F.col("at").alias("since"), until.alias("until"), over.alias("over"))

    made = F.lit(None)
    for k in {p[0] for p in pairs}:
        made = F.when(F.col("kind") == k, F.array(*(edge(n, p[1]) for n, p in enumerate(pairs) if p[0] == k))).otherwise(made)
    opens = [n for n, p in enumerate(pairs) if p in opening]
    return found.select(F.explode(made).alias("e")).select("e.*").filter(F.col("until").isNotNull() | F.col("pair").isin(opens))


def _hop(table: DataFrame, funnels: list[Funnel], step: int) -> DataFrame:
    """(funnel, client, since, until) the edges that lead on from a step of each funnel; ``until`` is null where an excluded row ends the attempt."""
    pairs, excluded = pairs_of(funnels)
    used: dict[int, list[tuple[int, int]]] = {}
    for n, f in enumerate(funnels):
        if len(f.steps) > step + 1:
            used.setdefault(pairs.index(f.steps[step : step + 2]), []).append((n, sum(1 << excluded.index(x) for x in set(f.excluding))))
    each = F.lit(None)
    for p, by in used.items():
        each = F.when(F.col("pair") == p, F.array(*(F.struct(F.lit(n).alias("funnel"), F.lit(mask).cast("long").alias("mask")) for n, mask in by))).otherwise(each)
    rows = table.filter(F.col("pair").isin(list(used))).withColumn("f", F.explode(each))
    return rows.select("f.funnel", "client", "since", F.when(F.col("over").bitwiseAND(F.col("f.mask")) == 0, F.col("until")).alias("until"))


def selected(histogram: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """(keys, n, t) of a histogram (keys, time, weight): the sum of weights and the ceil(percent n / 100)-th smallest time."""
    ranged = F.col("time").bitwiseAND(F.lit(-_RANGE)).alias("range")
    place = lambda by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    coarse = histogram.groupBy(*keys, ranged).agg(F.sum("weight").alias("w"))
    coarse = coarse.select("*", F.sum("w").over(place("range")).alias("upto"), F.sum("w").over(Window.partitionBy(*keys)).alias("n"))
    picked = coarse.withColumn("rank", F.expr(f"(n * {int(percent)} + 99) div 100")).filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("w") < F.col("rank")))
    picked = picked.select(*keys, "range", "n", (F.col("rank") - F.col("upto") + F.col("w")).alias("rank"))
    fine = histogram.select(*keys, ranged, "time", "weight").join(picked, [*keys, "range"])
    fine = fine.withColumn("upto", F.sum("weight").over(place("time")))
    return fine.filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("weight") < F.col("rank"))).select(*keys, "n", F.col("time").alias("t"))


def count(table: DataFrame, funnels: list[Funnel], *, percent: int = 50) -> DataFrame:
    """(funnel, client, n1 .., deepest, t2 .., same_depth) from a table of edges, for each funnel and client with attempts. A funnel with fewer steps than the longest has 0 and null in the others."""
    steps = max(len(f.steps) for f in funnels)
    hops = [_hop(table, funnels, 0).withColumn("weight", F.lit(1).cast("long"))]
    for step in range(1, steps - 1):
        # attempts that have come to the same row are one from here on
        front = hops[-1].filter("until is not null").groupBy("funnel", "client", F.col("until").alias("since")).agg(F.sum("weight").alias("weight"))
        hops.append(cut(_hop(table, funnels, step).filter("until is not null").join(front, ["funnel", "client", "since"]), f"hop{step}"))
    times = [h.filter("until is not null").select("funnel", "client", F.lit(k).alias("step"), (F.col("until") - F.col("since")).alias("time"), "weight") for k, h in enumerate(hops, 2)]
    histogram = times[0]
    for t in times[1:]:
        histogram = histogram.union(t)
    keys = ["funnel", "client", "step"]
    histogram = cut(histogram.groupBy(*keys, "time").agg(F.sum("weight").alias("weight")), "histogram")
    reached = selected(histogram, keys, percent)
    starts = hops[0].groupBy("funnel", "client").agg(F.count("*").alias("n")).select("funnel", "client", F.lit(1).alias("step"), "n", F.lit(None).cast("long").alias("t"))
    at = lambda c, k: F.max(F.when(F.col("step") == k, F.col(c)))
    by_client = starts.union(reached).groupBy("funnel", "client").agg(
        *(F.coalesce(at("n", k), F.lit(0).cast("long")).alias(f"n{k}") for k in range(1, steps + 1)),
        F.max("step").cast("int").alias("deepest"),
        *(at("t", k).alias(f"t{k}") for k in range(2, steps + 1)),
    )
    by_client = cut(by_client, "funnels")
    for h in (*hops[1:], histogram):
        discard(h)
    # a row for each funnel and depth: a bound that doesn't hang on the input
    depths = F.broadcast(by_client.groupBy("funnel", "deepest").agg(F.count("*").alias("same_depth")))
    name = F.lit(None)
    for n, f in enumerate(funnels):
        name = F.when(F.col("funnel") == n, F.lit(f.name)).otherwise(name)
    out = by_client.join(depths, ["funnel", "deepest"])
    return out.select(name.alias("funnel"), "client", *(f"n{k}" for k in range(1, steps + 1)), "deepest", *(f"t{k}" for k in range(2, steps + 1)), "same_depth")


def funnels(events: DataFrame, funnels: list[Funnel], *, within: int = 15 * MINUTE, part: int = 60 * MINUTE, percent: int = 50, client_column: str = "client_id", kind_column: str = "kind", time_column: str = "ts") -> DataFrame:
    """funnel, the client's column, n1 .. (attempts that reach each step), deepest, t2 .. (percentile of the microseconds from the step before) and same_depth, of each funnel and client with attempts.

    Every row of a funnel's first kind starts an attempt. The next step is the client's earliest row
    of its kind that is later; the attempt ends if that is more than ``within`` microseconds later or
    if a row of an excluded kind lies after the step before and not after it. Rows that repeat
    client, kind and time count once; rows with a null among these don't count. Rows of different
    kinds at the same time don't follow one another. An empty table gives no rows. Other columns are
    ignored, whatever their names.
    """
    at = micros(events[quoted(time_column)], dict(events.dtypes)[time_column])
    rows = events.select(events[quoted(client_column)].alias("client"), events[quoted(kind_column)].alias("kind"), at.alias("at")).na.drop()
    table = cut(edges(rows, funnels, within=within, part=part), "edges")
    found = count(table, funnels, percent=percent)
    discard(table)
    return found.withColumnRenamed("client", client_column)
