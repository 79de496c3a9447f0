"""Language identification by prediction by partial matching.

One variable-order byte context tree for each language, with the same contexts in all. A symbol is a
class of bytes (A-Z as a-z; bytes that are rare in the learning texts share one class). In a context
with total T and q distinct symbols a symbol seen c times has c / (T + q), and q / (T + q) is left to
escape to the context one byte shorter, without the symbols already seen here; so every context's
probabilities add up to one. The statistics are frozen into a table of code lengths, and a text is
given to the language under which its whole code is shortest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.names import cols, quoted

from .common import blocks, cut, fresh, learn_mod, text_buffers

#: Byte classes (6 bits); 0 also stands before a text's start.
CLASSES = 64
ORDER = 3
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    byte_class: np.ndarray  # 256 -> class
    byte_bits: np.ndarray  # bits that tell a byte within its class
    node: list[np.ndarray]  # of each language: order-3 context -> its longest context in the tree
    bits: list[np.ndarray]  # of each language: context, symbol -> code length


def _codes(data: np.ndarray, offsets: np.ndarray, byte_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every byte, the three classes before it (18 bits) and its class."""
    symbol = byte_class[data]
    context, end = np.zeros(len(data), np.int32), np.repeat(offsets[:-1] - offsets[0], np.diff(offsets))
    place = np.arange(len(data)) - end
    for back in range(1, ORDER + 1):
        before = np.zeros(len(data), np.int32)
        before[back:] = symbol[:-back] if back < len(data) else 0
        before[place < back] = 0
        context |= before << (6 * (back - 1))
    return context, symbol


def learn(docs: DataFrame, *, train: Column, language: str = "lang", id_column: str = "doc_id", text_column: str = "text", per_language: int = 1500, least: int = 24) -> Model:
    """Statistics of whole texts of at most ``per_language`` documents for each language, those with the smallest hashes of the id among the rows that ``train`` admits. That is the documented bound of this classifier's sample. A context of three bytes is in the tree if it was seen ``least`` times.

    Rows with a null text, id or language aren't used; of rows that share id and language the smallest
    text is. Texts are learned from whole. Equal hashes are ranked by id. Without any rows the model has
    no languages. It is as large as its languages are many: 2 MB for each, and 256 bytes for each of its
    three-byte contexts in the tree, of which there are 262,144 at most. Other columns are ignored.
    """
    rows = docs.filter(train & docs[quoted(language)].isNotNull() & docs[quoted(text_column)].isNotNull() & docs[quoted(id_column)].isNotNull())
    order = Window.partitionBy("language").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = rows.select(docs[quoted(language)].alias("language"), docs[quoted(id_column)].alias("doc_id"))
    # hashes are even over their range, so the smallest lie below a cut that follows from the count; the rank among those is exact
    share = F.least(F.lit(1.0), (per_language + 10 * per_language**0.5 + 50) / F.col("_c"))
    # a row for each language, of which the model itself holds a table each; so ids are cut where they are read, before any are dealt by language
    counts = F.broadcast(ids.groupBy("language").agg(F.count("*").alias("_c")))
    low = (F.xxhash64("doc_id") / 2.0**63 + 1) / 2 <= share
    ids = ids.join(counts, "language").filter(low).select("language", "doc_id").distinct().withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_language)
    chosen = ids.select("language", "doc_id")
    sample = rows.select(docs[quoted(language)].alias("language"), docs[quoted(id_column)].alias("doc_id"), docs[quoted(text_column)].cast("string").alias("text")).join(F.broadcast(chosen), ["language", "doc_id"], "left_semi")
    sample = cut(sample.groupBy("language", "doc_id").agg(F.min("text").alias("text")).select("language", "text"), "sample")

    def histogram(batches):
        for batch in batches:
            count = np.bincount(text_buffers(batch.column(1))[0], minlength=256)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(count.astype(np.int64))], names=["byte", "n"])

    count = np.zeros(256, np.int64)
    for byte, n in sample.mapInArrow(histogram, "byte long, n long").groupBy("byte").agg(F.sum("n")).collect():
        count[byte] = n
    count[97:123] += count[65:91]
    count[65:91] = 0
    byte_class = np.full(256, CLASSES - 1, np.int32)
    common = np.argsort(-count, kind="stable")[: CLASSES - 2]
    byte_class[common] = np.arange(1, CLASSES - 1)
    byte_class[65:91] = byte_class[97:123]
    members = np.bincount(byte_class[[b for b in range(256) if not 65 <= b < 91]], minlength=CLASSES)
    byte_bits = np.log2(np.maximum(members, 1))[byte_class]

    def grams(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            names = batch.column(0).to_pylist()
            for d, name in enumerate(names):
                context, symbol = _codes(data[offsets[d] : offsets[d + 1]], offsets[d : d + 2], byte_class)
                gram, n = np.unique(context << 6 | symbol, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], names=["language", "gram", "n"])

    table = sample.mapInArrow(grams, "language string, gram long, n long").groupBy("language", "gram").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(table.column("language").to_pylist()))
    return freeze(languages, np.searchsorted(languages, table.column("language").to_pylist()) if languages else np.zeros(0, int), table.column("gram").to_numpy(), table.column("n").to_numpy(), byte_class, byte_bits, least)


def freeze(languages, which, gram, n, byte_class, byte_bits, least) -> Model:
    """Code lengths of all contexts of up to two bytes in every language, and of the frequent ones of three in the languages that have them: where a language has none of a context's, the context one byte shorter has the same code lengths."""
    seen = np.bincount(gram >> 6, weights=n, minlength=CLASSES**ORDER)
    first, nodes, tables = CLASSES**2, [], []
    for k in range(len(languages)):
        mine, count = gram[which == k], n[which == k].astype(float)
        deep = np.unique(mine >> 6)
        deep = deep[seen[deep] >= least]
        node = (np.arange(CLASSES**ORDER) & (CLASSES**2 - 1)).astype(np.int32)
        node[deep] = first + np.arange(len(deep), dtype=np.int32)
        bits = np.zeros((first + len(deep), CLASSES), np.float32)
        lower = np.full((1, CLASSES), 1 / CLASSES)
        for order in range(ORDER):
            c = np.bincount(mine & (CLASSES ** (order + 1) - 1), weights=count, minlength=CLASSES ** (order + 1)).reshape(-1, CLASSES)
            lower = _mixed(c, np.tile(lower, (len(c) // len(lower), 1)))
        bits[:first] = -np.log2(lower)
        if len(deep):
            place = np.full(CLASSES**ORDER, -1)
            place[deep] = np.arange(len(deep))
            at = place[mine >> 6]
            c = np.bincount(at[at >= 0] * CLASSES + (mine[at >= 0] & (CLASSES - 1)), weights=count[at >= 0], minlength=len(deep) * CLASSES).reshape(-1, CLASSES)
            bits[first:] = -np.log2(_mixed(c, lower[deep & (CLASSES**2 - 1)]))
        nodes.append(node)
        tables.append(bits)
    return Model(list(languages), byte_class, byte_bits, nodes, tables)


def _mixed(count: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities of each context's symbols from its counts and those of the context one byte shorter."""
    seen = count > 0
    total, distinct = count.sum(1, keepdims=True), seen.sum(1, keepdims=True)
    all_seen = distinct == count.shape[1]
    weight = total + np.where(all_seen, 0, distinct)
    left = np.where(seen, 0, lower)
    with np.errstate(invalid="ignore", divide="ignore"):
        escape = distinct / weight * left / left.sum(1, keepdims=True)
        return np.where(total == 0, lower, np.where(seen, count / weight, escape))


def _letters(data: np.ndarray, offsets: np.ndarray, column) -> np.ndarray:
    """Which texts have a letter."""
    found = np.zeros(len(offsets) - 1, bool)
    for d, e in blocks(offsets):
        part = data[offsets[d] : offsets[e]] | 32
        some = np.flatnonzero(np.diff(offsets[d : e + 1]))
        if len(some):
            found[d + some] = np.logical_or.reduceat((part >= 97) & (part <= 122), (offsets[d:e] - offsets[d])[some])
    for d in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[d] = any(c.isalpha() for c in column[int(d)].as_py() or "")
    return found


def score(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, posterior probability under equal priors, and bits a byte of every text."""
    data, offsets = text_buffers(column)
    n, bits = len(column), np.zeros((len(model.languages), len(column)))
    for d, e in blocks(offsets):
        part, at = data[offsets[d] : offsets[e]], offsets[d : e + 1]
        context, symbol = _codes(part, at, model.byte_class)
        some = np.flatnonzero(np.diff(at))
        if len(some):
            starts = (at[:-1] - at[0])[some]
            own = np.add.reduceat(model.byte_bits[part], starts)
            for k, (node, table) in enumerate(zip(model.node, model.bits, strict=True)):
                bits[k, d + some] = np.add.reduceat(table.ravel()[node[context] * CLASSES + symbol], starts, dtype=np.float64) + own
    known = _letters(data, offsets, column) & bool(model.languages)
    if not model.languages:
        return [UNKNOWN] * n, np.zeros(n), np.zeros(n)
    best = bits.argmin(0)
    least = bits.min(0)
    sure = 1 / np.exp2(np.maximum(least - bits, -1000)).sum(0)
    names = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)]
    return names, np.where(known, sure, 0.0), least / np.maximum(np.diff(offsets), 1)


def tag(docs: DataFrame, model: Model, *, text_column: str = "text", names: tuple[str, str, str] = ("lang_pred", "lang_score", "lang_bits")) -> DataFrame:
    """All rows and columns, with the language, its probability and the bits a byte in columns of the given names (columns of these names are replaced). Only the text is read for it.

    ``und`` with score 0: a null text, one without letters, or a model without languages. Texts of
    any length are scored whole. Languages with equal code lengths: the first by name. Repeated rows
    get the same result. An empty table gives no rows.
    """
    own = list(names)
    docs = docs.drop(*own)
    held = docs.sparkSession.sparkContext.broadcast(model)  # its size: see learn
    place = docs.columns.index(text_column)

    def run(batches):
        for batch in batches:
            name, sure, bits = score(held.value, batch.column(place))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(name, pa.string()), pa.array(sure), pa.array(bits)], names=every)

    more = [T.StructField(c, t) for c, t in zip(own, (T.StringType(), T.DoubleType(), T.DoubleType()), strict=True)]
    schema = T.StructType([*docs.schema.fields, *more])
    every = schema.names
    # Spark looks the input's columns up by their bare names, which need not be single parts
    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns)))).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from."""
    return learn_mod(doc_id, 4) == 2


def language_filter(docs: DataFrame, *, keep: list[str] | None = None, least: float = 0.5) -> DataFrame:
    """The rows, with their columns, whose predicted language is known (or in ``keep``) with a probability of at least ``least``. Learns from the rows' own labels; without any, every row is kept. Null, empty and letterless texts go; repeated rows are kept or go together; an empty table gives no rows."""
    model = learn(docs, train=~held_out(docs["doc_id"]))
    if not model.languages:
        return docs
    names = fresh(docs, "language", "sure", "bits")
    tagged = tag(docs, model, names=tuple(names))
    known = F.col(names[0]).isin(keep) if keep else F.col(names[0]) != UNKNOWN
    return tagged.filter(known & (F.col(names[1]) >= least)).select(*cols(docs.columns))
