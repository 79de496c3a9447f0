"""Threshold-scaled sketches as document fingerprints, with DataFrame functions only.

A sketch retains every distinct shingle hash below a fixed fraction of the hash range; of texts that
have fewer than ``floor`` such hashes it retains the ``floor`` smallest, or all. It carries the bound
up to which it is complete, so two sketches are compared, merged and searched for containment up to
the smaller bound, however unequal the texts are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.names import quoted

#: Hashes are 48-bit; bounds are inclusive.
RANGE = 1 << 48
#: Cuts of the ids' order, for finding each id's successor.
_CUTS = 512


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def words(text: Column) -> Column:
    """Lower-case words between white space U+0020 and U+0009 to U+000D."""
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingles(w: Column, width: int) -> Column:
    """48-bit hashes of all runs of ``width`` words; of all words together if there are fewer, of none if there are none."""
    n = F.size(w)
    runs = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)]))
    few = F.when(n > 0, F.array(F.xxhash64(F.array_join(w, " "), n))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(F.when(n >= width, runs).otherwise(few), lambda h: F.shiftrightunsigned(h, 16))


def sketch(text: Column, *, width: int = 5, scale: int = 16, floor: int = 64) -> Column:
    """struct(bound, hashes ascending). Null: as an empty text."""
    limit = RANGE // scale

    def rest(every: Column) -> Column:
        some = let(F.sort_array(F.array_distinct(every)), lambda s: F.when(F.size(s) <= floor, _struct(F.lit(RANGE - 1), s)).otherwise(_struct(F.get(s, F.lit(floor - 1)), F.slice(s, 1, floor))))
        return let(F.array_distinct(F.filter(every, lambda h: h < limit)), lambda low: F.when(F.size(low) >= floor, _struct(F.lit(limit - 1), F.sort_array(low))).otherwise(some))

    return let(words(F.coalesce(text, F.lit(""))), lambda w: let(shingles(w, width), rest))


def _struct(bound: Column, hashes: Column) -> Column:
    return F.struct(bound.cast("long").alias("bound"), hashes.alias("hashes"))


def _upto(s: Column, bound: Column) -> Column:
    return F.filter(s["hashes"], lambda h: h <= bound)


def _shares(a: Column, b: Column, result: Callable[[Column, Column, Column], Column]) -> Column:
    return let(F.least(a["bound"], b["bound"]), lambda t: let(_upto(a, t), lambda x: let(_upto(b, t), lambda y: result(x, y, F.size(F.array_intersect(x, y))))))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets; 1 for two empty sets."""
    return _shares(a, b, lambda x, y, both: F.coalesce(F.try_divide(both.cast("double"), (F.size(x) + F.size(y) - both).cast("double")), F.lit(1.0)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    return _shares(a, b, lambda x, y, both: F.coalesce(F.try_divide(both.cast("double"), F.size(x).cast("double")), F.lit(1.0)))


def merge(a: Column, b: Column) -> Column:
    """The sketch of both texts' shingles together, complete up to the smaller bound."""
    return let(F.least(a["bound"], b["bound"]), lambda t: _struct(t, F.sort_array(F.array_union(_upto(a, t), _upto(b, t)))))


def encode(s: Column) -> Column:
    """Twelve hex digits of the bound, a colon, and the hashes, 6 bytes each, in base64."""
    digits = lambda h: F.lpad(F.hex(h), 12, "0")
    return F.concat(digits(s["bound"]), F.lit(":"), F.base64(F.unhex(F.array_join(F.transform(s["hashes"], digits), ""))))


def neighbours(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id, prev_id, need): each distinct id's successor, after the last the first; its predecessor; and the most that a row of the predecessor takes from its front. Ids are sorted within ranges; one row a range goes through the small window over ranges."""
    ids = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.floor(F.length("text") / 4)).alias("take"))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / _CUTS for k in range(1, _CUTS)], 10_000).alias("c")).first()["c"]
    cuts = sorted(set(cuts or []))
    range_of = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("doc_id"))) if cuts else F.lit(0)
    ids = ids.withColumn("range", range_of)
    edge = ids.groupBy("range").agg(F.min(F.struct("doc_id", "take")).alias("low"), F.max(F.struct("doc_id", "take")).alias("high"))
    every, order = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("range")
    after = F.coalesce(F.lead("low.doc_id").over(order), F.min("low.doc_id").over(every))
    before = F.coalesce(F.lag("high").over(order), F.max("high").over(every))
    edge = edge.select("range", after.alias("after"), before.alias("before"))
    inside = Window.partitionBy("range").orderBy("doc_id")
    near = ids.select("doc_id", "range", F.lead("doc_id").over(inside).alias("n"), F.lag(F.struct("doc_id", "take")).over(inside).alias("p"))
    near = near.join(F.broadcast(edge), "range")  # at most _CUTS rows
    return near.select("doc_id", F.coalesce("n", "after").alias("next_id"), F.coalesce("p", "before")["doc_id"].alias("prev_id"), F.coalesce("p", "before")["take"].alias("need"))


def fingerprints(docs: DataFrame, *, width: int = 5, scale: int = 16, floor: int = 64, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row's fingerprint, its edited text (the last quarter replaced by the next document's first as many code points) and that text's fingerprint, and the likeness of both and of the next document's.

    Null text: empty. The next document is the next larger id's (of rows that share an id, the one
    whose text has the smallest hash); after the largest id the smallest. A row with a null id has
    no next document: its edited text loses the last quarter, and ``near_next`` is 0. Repeated rows
    give a row each. A single document follows itself. An empty table gives no rows. Other columns
    are ignored.
    """
    # no cast or alias where none is needed: they would keep Spark from seeing that two exchanges are the same
    name = docs[quoted(id_column)] if (id_column, dict(docs.dtypes)[id_column]) == ("doc_id", "bigint") else docs[quoted(id_column)].cast("long").alias("doc_id")
    docs = docs.select(name, F.coalesce(docs[quoted(text_column)].cast("string"), F.lit("")).alias("text"))
    options = {"width": width, "scale": scale, "floor": floor}
    near = neighbours(docs)
    # both joins read one exchange of the texts by id, so a text is shuffled once; what is sketched afterwards isn't part of it
    known = docs.filter("doc_id is not null")
    first = F.struct(F.xxhash64("text").alias("h"), F.expr("substring(text, 1, cast(need as int))").alias("front"), sketch(F.col("text"), **options).alias("next"))
    fronts = known.join(near, "doc_id").groupBy(F.col("prev_id").alias("doc_id")).agg(F.min(first).alias("f"))
    both = known.join(fronts.select("doc_id", "f.front", "f.next"), "doc_id", "left")
    both = both.unionByName(docs.filter("doc_id is null"), allowMissingColumns=True).withColumn("own", sketch(F.col("text"), **options))
    edited = F.expr("concat(substring(text, 1, length(text) - cast(floor(length(text) / 4) as int)), substring(coalesce(front, ''), 1, cast(floor(length(text) / 4) as int)))")
    both = both.select("doc_id", "text", "own", "next", edited.alias("edited_text")).withColumn("edited", sketch(F.col("edited_text"), **options))
    return both.select(
        "doc_id",
        "text",
        "edited_text",
        F.col("own").alias("sketch"),
        F.col("edited").alias("edited_sketch"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        F.when(F.col("next").isNull(), 0.0).otherwise(likeness(F.col("own"), F.col("next"))).alias("near_next"),
    )


def digest(found: DataFrame) -> DataFrame:
    """Of ``fingerprints``: encoded sketches, lengths and the edited text's SHA-256 instead of texts."""
    return found.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited_text"), 256).alias("edited_sha256"),
        encode(F.col("sketch")).alias("fingerprint"),
        encode(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
