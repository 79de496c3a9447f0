"""URL filters: an as-of join of captures with dated lists.

A list entry names a host, a domain (any host under it) or a host with a path's beginning, and is
added or removed at a time. Entries become validity intervals. A capture has one key for each entry
that could name it; it meets the intervals of its keys that hold at its fetch time, and the most
specific one decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.names import col, cols

from .common import cut, fresh

#: Seconds of the slices of time that interval joins are keyed by, so one host's captures don't meet in one task.
SLICE = 30 * 86_400
#: No bound of labels or segments.
MOST = (1 << 31) - 1
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+(/[^?#]*)"


def host_of(url: Column) -> Column:
    """Lower case; empty if the URL has none."""
    return F.regexp_extract(F.lower(F.trim(url)), HOST, 1)


def keys_of(url: Column, most_labels: int = MOST, most_segments: int = MOST) -> Column:
    """array of (key, rank): domains of two labels or more, the host, and the host with the path's first segments; higher ranks are more specific. Domains of more labels and paths of more segments than given, which no entry may have, are left out."""
    host, path = host_of(url), F.regexp_extract(F.trim(url), PATH, 1)
    labels, parts = F.split(host, r"\."), F.filter(F.split(path, "/"), lambda x: x != "")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.greatest(F.lit(0), n - max(2, most_labels)), F.greatest(F.lit(0), n - 2)), lambda i: F.struct(F.array_join(F.slice(labels, i + 1, n), ".").alias("key"), (n - i).alias("rank")))
    paths = F.transform(F.slice(parts, 1, most_segments), lambda _, i: F.struct(F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i + 1), "/")).alias("key"), (n + i + 1).alias("rank")))
    return F.when(host != "", F.concat(domains, paths))


def host_part() -> Column:
    """Of an entry's key."""
    return F.substring_index("key", "/", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, since, until) from (list, key, action, at), action ``add`` or ``remove``. An entry holds from each time it is added until the next change; null ``until``: still. Of changes at one time the removal comes first. Rows with a null key, action or time have no effect. Hosts are compared in lower case, paths as they are."""
    order = Window.partitionBy("list", "key").orderBy("at", F.when(F.col("action") == "remove", 0).otherwise(1))
    named = entries.filter("key is not null and at is not null and action in ('add', 'remove')").withColumn("key", F.concat(F.lower(host_part()), F.expr("substring(key, length(substring_index(key, '/', 1)) + 1)")))
    return named.withColumn("until", F.lead("at").over(order)).filter("action = 'add' and (until is null or until > at)").select("list", "key", F.col("at").alias("since"), "until")


def as_of(captures: DataFrame, entries: DataFrame, *, url_column: str = "url", time_column: str = "fetched_at") -> DataFrame:
    """All rows and columns of ``captures``, with blocked, matched_key, matched_list and listed_since (columns of these names are replaced): the entry in force at fetch time whose key is most specific; of equal ones the latest, then the first list by name (a list without a name is before all).

    A null URL or time, or a URL without a host, is never blocked. Rows that repeat get the same
    answer. Empty tables are allowed on both sides. Joins are by key and slice of time, on both
    sides of any size.
    """
    own = ["blocked", "matched_key", "matched_list", "listed_since"]
    captures = captures.drop(*own)
    url, time = col(url_column), col(time_column)
    named = host_of(url) != ""
    # what is asked is named by 128 bits of URL and time, from two differently seeded hashes: of 10^11 captures two have one name with probability 10^-17
    ask = [F.xxhash64(url, time), F.xxhash64(F.lit("again"), time, url)]
    able = captures.filter(named & time.isNotNull())
    asked = able.select(url.alias("_u"), time.cast("timestamp").alias("_t"), *(c.alias(f"_row{k}") for k, c in enumerate(ask))).distinct()
    # an entry's key has the labels of its host and the segments of its path: no capture needs longer keys than the longest entry
    longest = entries.agg(F.max(F.size(F.split(host_part(), r"\."))).alias("labels"), F.max(F.size(F.split("key", "/")) - 1).alias("segments")).first()
    part = lambda c: F.floor(F.unix_timestamp(c) / SLICE)
    each = asked.select("_row0", "_row1", "_t", part("_t").alias("_p"), F.explode(keys_of(F.col("_u"), longest["labels"] or 0, longest["segments"] or 0)).alias("k")).select("_row0", "_row1", "_t", "_p", "k.key", "k.rank")
    # of all rows: no shuffle, unlike that of the distinct ones
    span = able.agg(F.min(time.cast("timestamp")).alias("a"), F.max(time.cast("timestamp")).alias("b")).first()
    a, b = (F.lit(span[k]).cast("timestamp") for k in ("a", "b"))
    held = intervals(entries).filter((F.col("since") <= b) & (F.col("until").isNull() | (F.col("until") > a)))
    held = held.withColumn("_p", F.explode(F.sequence(part(F.greatest("since", a)), part(F.least(F.coalesce("until", b), b)))))
    met = each.join(held, ["key", "_p"]).filter("_t >= since and (until is null or _t < until)")
    best = met.groupBy("_row0", "_row1").agg(F.min(F.struct((-F.col("rank")).alias("r"), (-F.unix_micros("since")).alias("s"), "list", "key", "since")).alias("m"))
    rows = fresh(captures, "row0", "row1")
    # cut off, so that Spark can split a URL that very many captures have
    best = cut(best.select(F.col("_row0").alias(rows[0]), F.col("_row1").alias(rows[1]), F.col("m.key").alias(own[1]), F.col("m.list").alias(own[2]), F.col("m.since").alias(own[3])), "answers")
    can = F.coalesce(named & time.isNotNull(), F.lit(False))
    keyed = captures.filter(can).withColumns(dict(zip(rows, ask, strict=True)))
    out = keyed.join(best, rows, "left").select(*cols(captures.columns), F.col(own[1]).isNotNull().alias(own[0]), *own[1:])
    rest = captures.filter(~can).select(*cols(captures.columns), F.lit(False).alias(own[0]), *(F.lit(None).cast(best.schema[c].dataType).alias(c) for c in own[1:]))
    return out.unionByName(rest)
