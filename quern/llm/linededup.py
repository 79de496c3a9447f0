"""Line de-duplication by winnowing over line hashes, with DataFrame functions only.

A text is a sequence of lines; lines are also cut after a sentence's end (``.``, ``!`` or ``?`` and a
space), so that a passage set into a paragraph is found. White space behind a line belongs to it and
isn't compared. What is removed are later repeats of runs of lines with ``min_words`` words or more:

1. Each line has an order, its words and then its hash. A line is a fingerprint if it is the highest
   of some stretch of lines around it that has ``min_words`` words; whether it is hangs on that
   stretch alone, so any two places that share such a run select the same line of it. Only
   fingerprints leave the texts, as hash and place.
2. Fingerprints that stand at two places or more are joined with their places.
3. Matches are extended from there, line by line: forward with the shortest runs of ``min_words``
   words that begin at each line, backward with those that end at each line. A run that reaches a
   fingerprint and equals an earlier one, the first occurrence, repeats it; the union of these is all
   of every repeated run, up to its first and last lines. The lines of a match are compared with
   those of the first occurrence, by SHA-256 of their texts, before they go, so a clash of the short
   hashes deletes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.names import col, cols, quoted
from quern.operators.steps import fenced

from .common import cut, fresh, residue, residues_of

#: White space, and a line: up to a line feed, a sentence's end and a space, or the text's end, with the white space behind it (and before the text's first). Possessive, so matching is linear and needs no stack.
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
LINE = r"[\x20\x09-\x0D]*+[^\n.!?]*+(?:[.!?](?! )[^\n.!?]*+)*+(?:\n|[.!?] |\z)[\x20\x09-\x0D]*+"
#: A line's order is its number of words, up to 127, and 56 bits of its hash.
_WORD, _MOST = 1 << 56, 127
_FAR = 1 << 20
#: Lines of a part of a text; by windows, of the smallest in which hits are looked for.
_PART = 1024
#: Runs of so many words at most are found by lines set side by side, in columns; longer ones by windows, which cost more.
_BESIDE = 32


def lines_of(text: Column) -> Column:
    """The lines; joined they are the text. Only the last one may have no words."""
    return F.regexp_extract_all(text, F.lit(LINE), F.lit(0))


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(WHITE))


def _counted(bare: Column) -> Column:
    """How many words a line has."""
    return F.regexp_count(bare, F.lit(r"[^\x20\x09-\x0D]+"))


def _spaced(bare: Column) -> Column:
    """The same of a line whose words have single spaces between them; much quicker."""
    return F.octet_length(bare) - F.octet_length(F.replace(bare, F.lit(" "), F.lit(""))) + (bare != "").cast("int")


def _each_line(text: Column, then: Callable[[Column, Column], Column]) -> Column:
    """``then`` of every bare line and its number of words."""
    odd = reduce(or_, (text.contains(c) for c in ("  ", "\t", "\x0b", "\x0c", "\r")))
    one = lambda count: F.transform(F.transform(lines_of(text), _bare), lambda x: then(x, count(x)))
    return F.when(odd, one(_counted)).otherwise(one(_spaced))


def _digest(lines: Column) -> Column:
    return F.sha2(F.array_join(lines, "\n").cast("binary"), 256)


def _key(doc_id: Column, text: Column) -> Column:
    """With the id it names a document; rows with the same id and text are one."""
    return F.xxhash64(doc_id, text)


def orders(docs: DataFrame) -> DataFrame:
    """(key, doc_id, g): the orders of each document's lines. Any two lines have equal ones if they are equal."""

    def order(bare: Column, n: Column) -> Column:
        return F.shiftleft(F.least(n, F.lit(_MOST)).cast("long"), 56) + F.shiftrightunsigned(F.xxhash64(bare), 8)

    g = F.filter(_each_line(F.col("text"), order), lambda x: x >= _WORD)
    return docs.select(_key(F.col("doc_id"), F.col("text")).alias("key"), "doc_id", g.alias("g"))


def _n(order: Column) -> Column:
    return F.shiftright(order, 56).cast("int")


def fingerprints(placed: DataFrame, min_words: int) -> DataFrame:
    """(key, f, line): the selected lines of each document."""
    # elements are taken by get: inside a lambda slice copies the whole array
    beside = lambda x, near, far: F.when(near <= x, F.when(far <= x, F.lit(_FAR)).otherwise(_n(near))).otherwise(0)

    def selected(x: Column, i: Column) -> Column:
        # words of the lines around that aren't higher; two such lines on a side are taken for enough
        left, right = (beside(x, F.get("g", i + d), F.get("g", i + 2 * d)) for d in (-1, 1))
        return F.when(_n(x) + left + right >= min_words, F.struct(x.alias("f"), i.alias("line")))

    some = F.filter(F.transform("g", selected), lambda s: s.isNotNull())
    return placed.select("key", F.explode(some).alias("s")).select("key", "s.f", "s.line")


def candidates(placed: DataFrame, min_words: int) -> DataFrame:
    """(key, hits): of each document its fingerprints that stand at two places or more."""
    found = cut(fingerprints(placed, min_words), "fingerprints")
    at = F.xxhash64("key", "line")
    # tables are cut off so that the joins read plain exchanges, whose hot partitions Spark can split
    shared = cut(found.groupBy("f").agg(F.min(at).alias("a"), F.max(at).alias("b")).filter("a <> b").select("f"), "shared")
    near = found.withColumn("r", residue(F.col("f"))).join(residues_of(shared, "f", "r"), "r", "left_semi")
    return cut(near.join(shared, "f", "left_semi").groupBy("key").agg(F.collect_set("line").alias("hits")), "hits")


def _ahead(hits: Column, size: Column) -> Column:
    """For each line of a text how many lines ahead its next hit is, in one go over both."""
    gap = lambda i, k: F.sequence(i - F.coalesce(F.get("sorted", k - 1), F.lit(-1)) - 1, F.lit(0), F.lit(-1))
    return F.concat(F.flatten(F.transform("sorted", gap)), F.array_repeat(F.lit(_FAR), size - 1 - F.element_at("sorted", -1)))


def runs(placed: DataFrame, hits: DataFrame, min_words: int) -> DataFrame:
    """(key, doc_id, a, b, content): first and last line, and a hash of all lines, of the shortest runs of ``min_words`` words that begin or that end at each line and hold one of the hits."""
    rows = placed.withColumn("r", residue(F.col("key"))).join(residues_of(hits, "key", "r"), "r", "left_semi").groupBy("key", "doc_id").agg(F.any_value("g").alias("g")).join(hits, "key")
    if min_words > _BESIDE:
        return _runs_by_windows(rows, min_words)
    rows = rows.withColumn("sorted", F.array_sort("hits"))
    # parts of a text, and beside each line those after it: every line has a word, so a run has min_words lines at most
    rows = rows.select("key", "doc_id", "g", _ahead(F.col("sorted"), F.size("g")).alias("ahead"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.size("g") - 1, F.lit(_PART))).alias("p"))
    after = [f"x{k}" for k in range(min_words)]
    part = lambda c, k: F.slice(c, F.col("p") + k + 1, F.lit(_PART))
    beside = F.arrays_zip(part("ahead", 0).alias("ahead"), *(part("g", k).alias(x) for k, x in enumerate(after)))
    # fenced: Spark would repeat what is exploded, and what rows are filtered by, in a filter before it
    rows = fenced(rows.select("key", "doc_id", "p", beside.alias("beside"))).select("key", "doc_id", "p", F.posexplode("beside").alias("line", "s"))
    rows = rows.select("key", "doc_id", (F.col("p") + F.col("line")).alias("a"), "s.*").filter(F.col("ahead") < min_words)

    # words up to each line after, one step for each: Spark takes a sum from the one before, where one expression of all would be their square
    words, first, last = F.col("words"), F.col("first"), F.col("last")
    rows = rows.withColumns({"own": _n(F.col("x0")), "words": _n(F.col("x0")), "first": (_n(F.col("x0")) < min_words).cast("int") + 1, "last": F.lit(1)})
    for x in after[1:]:
        more = words + F.coalesce(_n(F.col(x)), F.lit(0))
        rows = rows.withColumns({"words": more, "first": first + (more < min_words).cast("int"), "last": last + (F.col(x).isNotNull() & (more - F.col("own") < min_words)).cast("int")})
    # first: lines of the shortest run that begins here; last: of the longest that begins here and is the shortest that ends where it ends
    rows = rows.select("key", "doc_id", "a", F.array(*after).alias("g"), F.greatest(first, F.col("ahead") + 1).alias("from"), F.when(first <= min_words, F.greatest(first, last)).alias("to"))
    rows = fenced(rows).filter(F.col("from") <= F.col("to"))
    rows = rows.select("key", "doc_id", "a", "g", F.explode(F.sequence("from", "to")).alias("n"))
    return rows.select("key", "doc_id", "a", (F.col("a") + F.col("n") - 1).alias("b"), F.xxhash64(F.slice("g", 1, F.col("n"))).alias("content"))


def _runs_by_windows(rows: DataFrame, min_words: int) -> DataFrame:
    """The same as ``runs`` of (key, doc_id, g, hits), for any ``min_words``."""
    # a line is looked for among the hits of its part of the text, so that a text of very many lines takes no square of them
    part = F.greatest(F.lit(_PART), (16 * F.sqrt(F.size("g"))).cast("int"))
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.size("g") / part).cast("int")), lambda p: F.filter("hits", lambda i: F.floor(i / part) == p))
    rows = rows.select("key", "doc_id", "g", part.alias("part"), F.when(F.size("g") < _PART, F.array("hits")).otherwise(parts).alias("hits"))
    rows = rows.select("key", "doc_id", "part", "hits", F.posexplode("g").alias("line", "g"))
    rows = rows.select("key", "doc_id", "line", "g", F.array_contains(F.get("hits", F.floor(F.col("line") / F.col("part")).cast("int")), F.col("line")).cast("int").alias("hit"), _n(F.col("g")).alias("n"))

    by_doc = Window.partitionBy("key", "doc_id")
    rows = rows.withColumn("end", F.sum(F.col("n").cast("long")).over(by_doc.orderBy("line").rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.col("n"))

    def run(frame, place: str) -> list[Column]:
        return [F.collect_list("g").over(frame).alias(f"g{place}"), F.sum("n").over(frame).alias(f"n{place}"), F.max("hit").over(frame).alias(f"hit{place}")]

    forward, backward = by_doc.orderBy("start").rangeBetween(0, min_words - 1), by_doc.orderBy("end").rangeBetween(1 - min_words, 0)
    rows = rows.select("key", "doc_id", "line", "n", *run(forward, "x"), *run(backward, "y"))
    span = lambda a, b, g: F.struct(a.alias("a"), b.alias("b"), F.xxhash64(g).alias("content"))
    ahead = F.when((F.col("nx") >= min_words) & (F.col("hitx") == 1), span(F.col("line"), F.col("line") + F.size("gx") - 1, F.col("gx")))
    # those that are also forward ones aren't needed twice
    behind = F.when((F.col("ny") - F.col("n") >= min_words) & (F.col("hity") == 1), span(F.col("line") - F.size("gy") + 1, F.col("line"), F.col("gy")))
    return rows.select("key", "doc_id", F.explode(F.array(ahead, behind)).alias("r")).filter("r is not null").select("key", "doc_id", "r.a", "r.b", "r.content")


def matches(again: DataFrame) -> DataFrame:
    """(key, doc_id, of, doc, ahead, a, b): the lines of a document that repeat lines of another (or of itself), ``ahead`` lines before: its runs that equal an earlier one and overlap or touch at the same distance from the first of those."""
    here = F.struct("doc_id", "key", "a")
    origin = again.groupBy("content").agg(F.min(here).alias("first"), F.max(here).alias("last")).filter("first < last")
    origin = cut(origin.select("content", F.col("first.doc_id").alias("doc"), F.col("first.key").alias("of"), F.col("first.a").alias("at")), "origins")
    later = again.join(origin, "content").filter(here > F.struct("doc", "of", "at")).withColumn("ahead", F.col("a") - F.col("at"))
    order = Window.partitionBy("key", "doc_id", "of", "doc", "ahead").orderBy("a")
    later = later.withColumn("reach", F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    later = later.withColumn("part", F.sum(F.when(F.col("a") <= F.col("reach") + 1, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return later.groupBy("key", "doc_id", "of", "doc", "ahead", "part").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("part")


def repeats(docs: DataFrame, min_words: int) -> DataFrame:
    """(key, doc_id, said): of each document with matches their first and last lines, and a digest of the lines as the origins have them."""
    placed = cut(orders(docs), "orders")
    found = cut(matches(cut(runs(placed, candidates(placed, min_words), min_words), "runs")), "matches")
    origins = cut(found.select("of", "doc").distinct(), "origins")
    keyed = docs.withColumn("of", _key(F.col("doc_id"), F.col("text"))).withColumnRenamed("doc_id", "doc").withColumn("r", residue(F.col("of")))
    texts = keyed.join(residues_of(origins, "of", "r"), "r", "left_semi").groupBy("of", "doc").agg(F.any_value("text").alias("text")).select("of", "doc", F.transform(lines_of(F.col("text")), _bare).alias("lines"))
    texts = cut(texts.join(origins.toDF("of_", "doc_"), (F.col("of") == F.col("of_")) & F.col("doc").eqNullSafe(F.col("doc_")), "left_semi"), "lines")
    met = found.join(texts.toDF("of_", "doc_", "lines"), (F.col("of") == F.col("of_")) & F.col("doc").eqNullSafe(F.col("doc_")))
    # in the join's own compiled code, which takes these lines only; in a lambda or in the aggregation all lines would be copied for each match
    said = cut(met.select("key", "doc_id", "a", "b", _digest(F.slice("lines", F.col("a") - F.col("ahead") + 1, F.col("b") - F.col("a") + 1)).alias("lines")), "said")
    return said.groupBy("key", "doc_id").agg(F.collect_list(F.struct("a", "b", "lines")).alias("said"))


def remove_repeats(docs: DataFrame, *, min_words: int = 15, id_column: str = "doc_id", text_column: str = "text", names: tuple[str, str] = ("removed_lines", "removed_words")) -> DataFrame:
    """All rows and columns, without the later repeats in the text, and how many lines and words were removed, in columns of the given names (columns of these names are replaced).

    Null and empty texts stay as they are. Rows with the same id and text are one document and get
    the same result; of equal texts with different ids the smallest id's stays whole (a null id is
    the smallest). A text all of whose lines go is empty. A line of which only a part repeats stays,
    and so does a run of fewer than ``min_words`` words. Texts may be of any length. An empty table
    gives no rows. Other columns may have any names.

    Hashes and places, not texts, are sorted and joined. Only the texts that share a fingerprint,
    and those whose keys share a residue with one, are shuffled.
    """
    own = list(names)
    docs = docs.drop(*own)
    if not 0 < min_words <= _MOST:
        raise ValueError(f"min_words must be from 1 to {_MOST}")
    key, rest_of, name, said, gone, lines, kept = fresh(docs.withColumns({c: F.lit(0) for c in own}), "key", "residue", "name", "said", "gone", "lines", "kept")
    found = cut(repeats(docs.select(docs[quoted(id_column)].alias("doc_id"), docs[quoted(text_column)].alias("text")), min_words), "repeats")
    keyed = docs.withColumn(key, _key(docs[quoted(id_column)], docs[quoted(text_column)])).withColumn(rest_of, residue(F.col(key)))
    some = residues_of(found, "key", rest_of)
    rest = keyed.join(some, rest_of, "left_anti").select(*cols(docs.columns), *(F.lit(0).cast("long").alias(c) for c in own))
    near = keyed.join(some, rest_of, "left_semi")
    found = found.toDF(f"{key}_", name, said)
    hit = near.join(found, (F.col(key) == F.col(f"{key}_")) & col(id_column).eqNullSafe(F.col(name)), "left")
    hit = hit.withColumn(lines, F.when(F.col(said).isNotNull(), lines_of(col(text_column))))
    # lines go if the origin's are the same, not only their hashes
    same = lambda m: _digest(F.transform(F.sequence(m["a"], m["b"]), lambda k: _bare(F.get(lines, k)))) == m["lines"]
    hit = hit.withColumn(gone, F.array_distinct(F.flatten(F.transform(F.filter(said, same), lambda m: F.sequence(m["a"], m["b"])))))
    hit = hit.withColumn(kept, F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i)))
    words = F.aggregate(gone, F.lit(0).cast("long"), lambda s, i: s + _counted(F.get(lines, i)))
    some = F.size(gone) > 0
    changed = hit.select(
        *(F.when(some, F.array_join(kept, "")).otherwise(col(c)).alias(c) if c == text_column else col(c) for c in docs.columns),
        F.when(some, F.size(gone).cast("long")).otherwise(0).alias(own[0]),
        F.when(some, words).otherwise(0).alias(own[1]),
    )
    # fenced: a filter on the result would be pushed into these expressions, which then cut all lines anew for each of them
    return rest.unionByName(fenced(changed))
