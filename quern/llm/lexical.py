"""Ranked lexical search: document-sharded postings with integer impacts, dense accumulators.

Each task turns blocks of its documents into shards. A shard is one row: its distinct terms, and for
all terms together the documents that hold them and their impacts, term after term (compressed
sparse rows). The impact (1000000000 tf) div (1000 tf + 8 m) is worked out when the index is
built; only the term's weight, which hangs on how many documents of all shards hold it, is
multiplied at search time. Terms are kept as text, so no two are ever taken for one.

A search takes its items in blocks, and each shard meets each block: for every item an accumulator
of one 64-bit sum for each of the shard's documents is filled term by term, and the k best come out.
These are merged by item. Nothing but numbers of terms and documents comes to the driver, and what is
shuffled are k rows for each item and shard.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.names import quoted

from .common import blocks, cut, discard, text_buffers

#: What a term consists of: letters and digits of ASCII, and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_INSIDE = np.zeros(256, bool)
for _first, _last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _INSIDE[_first : _last + 1] = True
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
#: Pairs of item and term in a block of items.
_BLOCK = 1 << 16
SHARD = "ids array<long>, terms array<string>, df array<int>, docs binary, impacts binary"


def _edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes are in terms, and the first and the last byte of each term; terms end with their document."""
    inside = _INSIDE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts], after[cuts - 1] = False, False
    return inside, np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after)


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many terms each document has."""
    return np.diff(np.searchsorted(_edges(data, offsets)[1], offsets))


def _shard(ids: pa.Array, data: np.ndarray, offsets: np.ndarray, n_docs: int, n_terms: int) -> pa.RecordBatch | None:
    inside, first, last = _edges(data, offsets)
    if not len(first):
        return None
    lengths = np.diff(np.searchsorted(first, offsets))
    ends = np.concatenate([[0], np.cumsum(last - first + 1)])
    tokens = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(_FOLDED[data[inside]])))
    coded = tokens.dictionary_encode()
    size = len(lengths)
    both = coded.indices.to_numpy().astype(np.int64) * size + np.repeat(np.arange(size), lengths)
    both, tf = np.unique(both, return_counts=True)
    doc = both % size
    m = 25 + (75 * lengths.astype(np.int64) * n_docs) // n_terms
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
    df = np.bincount(both // size, minlength=len(coded.dictionary)).astype(np.int32)
    one = lambda values, kind: pa.array([values], kind)
    ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    terms = pa.ListArray.from_arrays(pa.array([0, len(df)], pa.int32()), coded.dictionary.cast(pa.string()))
    return pa.RecordBatch.from_arrays([ids, terms, pa.ListArray.from_arrays(pa.array([0, len(df)], pa.int32()), pa.array(df)), one(doc.astype(np.int32).tobytes(), pa.binary()), one(impact.astype(np.int32).tobytes(), pa.binary())], names=["ids", "terms", "df", "docs", "impacts"])


@dataclass
class Index:
    """``shards`` is a table in the shared folder; ``n_docs`` counts the documents with a term, ``n_terms`` all terms with repeats."""

    shards: DataFrame
    n_docs: int
    n_terms: int

    def discard(self) -> None:
        discard(self.shards)


def build(docs: DataFrame, *, shard_bytes: int = 8 << 20, id_column: str = "doc_id", text_column: str = "text") -> Index:
    """Indexes every row, its whole text. A longer text than ``shard_bytes`` is a shard of its own. Null and termless texts are in no shard; rows that share an id are documents of their own, and so are those with a null id."""
    rows = docs.select(docs[quoted(id_column)].cast("long").alias("id"), docs[quoted(text_column)].cast("string").alias("text"))

    def count(batches):
        found, terms = 0, 0
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for d, e in blocks(offsets):
                n = term_counts(data[offsets[d] : offsets[e]], offsets[d : e + 1] - offsets[d])
                found, terms = found + int((n > 0).sum()), terms + int(n.sum())
        yield pa.RecordBatch.from_pydict({"docs": [found], "terms": [terms]})

    all_of = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    n_docs, n_terms = rows.select("text").mapInArrow(count, "docs long, terms long").agg(all_of("docs"), all_of("terms")).first()

    def shards(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for d, e in blocks(offsets, shard_bytes):
                made = _shard(batch.column(0).slice(d, e - d), data[offsets[d] : offsets[e]], offsets[d : e + 1] - offsets[d], n_docs, n_terms)
                if made is not None:
                    yield made

    return Index(cut(rows.mapInArrow(shards, SHARD), "shards"), n_docs, n_terms)


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(TERM), F.lit(0))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0; of equal ones at the border the smallest ids."""
    found = np.flatnonzero(scores)
    if len(found) <= k:
        return found
    border = scores[found[np.argpartition(scores[found], len(found) - k)[-k:]]].min()
    above, tied = np.flatnonzero(scores > border), np.flatnonzero(scores == border)
    return np.concatenate([above, tied[np.argsort(ids[tied], kind="stable")[: k - len(above)]]])


_NO_ID = np.iinfo(np.int64).max


def _searched(row: dict, k: int) -> pa.RecordBatch:
    """(item, doc_id, score) the best of a shard for each item of a block."""
    ids = pc.fill_null(row["ids"].values, _NO_ID).to_numpy()
    starts = np.concatenate([[0], np.cumsum(row["df"].values.to_numpy())])
    docs, impacts = (np.frombuffer(row[c].as_buffer(), np.int32) for c in ("docs", "impacts"))
    pairs = row["pairs"].values
    items, weights = pairs.field("item").to_numpy(), pairs.field("weight").to_numpy()
    at = pc.index_in(pairs.field("term"), value_set=row["terms"].values)
    held = at.is_valid().to_numpy(zero_copy_only=False)
    at, items, weights = pc.fill_null(at, 0).to_numpy()[held], items[held], weights[held]
    order = np.argsort(items, kind="stable")
    at, items, weights = at[order], items[order], weights[order]
    sums, out = np.zeros(len(ids), np.int64), []
    for group in np.split(np.arange(len(items)), np.flatnonzero(np.diff(items)) + 1):
        if not len(group):
            continue
        sums[:] = 0
        for i in group:
            s, e = starts[at[i]], starts[at[i] + 1]
            sums[docs[s:e]] += weights[i] * impacts[s:e]
        top = best(sums, ids, k)
        out.append((np.full(len(top), items[group[0]]), ids[top], sums[top]))
    item, doc, score = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
    return pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, mask=doc == _NO_ID), pa.array(score)], names=["item", "doc_id", "score"])


def search(index: Index, queries: DataFrame, *, k: int = 10, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """The id column of ``queries``, rank, doc_id and score: of each item the k documents with the highest scores above 0, equal scores by ascending id (null last).

    Weights are floor(1000 ln((2 N + 2) / (2 df + 1))); an item's term counts as often as it stands.
    Repeated rows of ``queries`` are one item; rows that share an id but not the text are ranked
    each. An item with no term that any document holds has no rows, and neither has any item of an empty index.
    Other columns are ignored, whatever their names.
    """
    items = queries.select(queries[quoted(id_column)].alias("id"), queries[quoted(text_column)].cast("string").alias("text")).distinct()
    items = cut(items.select(F.monotonically_increasing_id().alias("item"), "id", "text"), "items")
    asked = items.select("item", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("item", "term").agg(F.count("*").alias("times"))
    asked = cut(asked, "asked")
    held = index.shards.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.df").alias("df"))
    held = held.join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * index.n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    # an item stays in one block, and a block has about _BLOCK pairs
    many = max(1, -(-asked.count() // _BLOCK))
    pairs = asked.join(held, "term").select(F.pmod(F.xxhash64("item"), F.lit(many)).alias("block"), F.struct("item", "term", (weight * F.col("times")).alias("weight")).alias("pair"))
    asked_for = cut(pairs.groupBy("block").agg(F.collect_list("pair").alias("pairs")).select("pairs"), "blocks")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield _searched({c: batch.column(c)[i] for c in batch.schema.names}, k)

    met = index.shards.crossJoin(asked_for).mapInArrow(run, "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = cut(met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "ranked")
    out = ranked.join(items.select("item", F.col("id").alias(id_column)), "item")
    for table in (asked, asked_for):
        discard(table)
    return out.select(quoted(id_column), "rank", "doc_id", "score")
