"""Benchmark decontamination with spaced seeds.

A seed hashes the tokens of a window that its fixed mask has a 1 for; tokens at the mask's zeros may
differ. Seeds of documents that pass a Bloom filter of the benchmark's seeds (of bounded size,
whatever the benchmark's) are joined with those; each hit names a diagonal on which the document and
the item are compared token by token, and every stretch of it that is long enough decides,
substitutions included.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.names import quoted

from .common import _SHINGLE, blocks, cut, drop_ids, mix64, residue, residues_of, text_buffers, word_hashes

#: Fixed masks: one without gaps, and three whose gaps differ.
MASKS = ("11111111", "110110110101", "1011010111001", "111001101011")
#: Bits of the Bloom filter: 128 for each seed, between these bounds. 2^27 bits are 16 MB.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27


def seeds(words: np.ndarray, mask: str, k: int) -> np.ndarray:
    """The seed of every window, documents' ends not regarded."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k + 1, np.uint64)
    for j, c in enumerate(mask):
        if c == "1":
            out += words[j : j + n] * _SHINGLE[j]
    return mix64(out)


def _places(seed: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return seed & mask, (seed >> np.uint64(32)) & mask


def _in_documents(starts: np.ndarray, at: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows lie within one document, and the documents of those."""
    doc = np.searchsorted(starts, at, "right") - 1
    ok = at + span <= starts[doc + 1]
    return ok, doc[ok]


def _seed_rows(table: DataFrame, id_name: str, bloom=None, bits: int = 0) -> DataFrame:
    """(seed, id, at): all seeds of all texts, or those that may be in the filter."""

    def run(batches):
        held = None if bloom is None else np.frombuffer(bloom.value, np.uint8)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for d, e in blocks(offsets):
                words, starts = word_hashes(data[offsets[d] : offsets[e]], offsets[d : e + 1])
                ids = batch.column(0).slice(d, e - d)
                for k, mask in enumerate(MASKS):
                    seed = seeds(words, mask, k)
                    at = np.arange(len(seed))
                    if held is not None:
                        for which in (0, 1):
                            place = _places(seed, bits)[which]
                            ok = (held[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
                            seed, at = seed[ok], at[ok]
                    ok, doc = _in_documents(starts, at, len(mask)) if len(at) else (np.zeros(0, bool), np.zeros(0, np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(seed[ok].view(np.int64)), ids.take(pa.array(doc)), pa.array(at[ok] - starts[doc])], names=["seed", id_name, "at"])

    return table.mapInArrow(run, f"seed long, {id_name} long, at long")


def _bloom(found: DataFrame) -> tuple[bytes, int]:
    """Two bits a seed, built where the seeds are; at most MOST_BITS / 2^15 rows of 4 kB come to the driver."""
    n = found.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (128 * max(n, 1) - 1).bit_length()))
    place = F.explode(F.array(F.col("seed").bitwiseAND(bits - 1), F.shiftrightunsigned("seed", 32).bitwiseAND(bits - 1)))
    part = found.select(place.alias("p")).groupBy(F.shiftright("p", 15).alias("k")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(32767)).alias("b"))
    out = bytearray(bits // 8)
    for k, b in part.collect():
        out[k * 4096 : k * 4096 + 4096] = b
    return bytes(out), bits


def best_stretch(equal: np.ndarray, least: int, share: float) -> tuple[int, int, int] | None:
    """(start, end, equal tokens) of the stretch of at least ``least`` tokens, ``share`` of them equal, that has the most equal ones; of these the shortest, then the first. None if no stretch has that share."""
    n = len(equal)
    if n < least or n == 0:
        return None
    sums = np.concatenate([[0], np.cumsum(equal)])
    # a stretch has the share if the excess at its end isn't below that at its start
    excess = sums - share * np.arange(n + 1)
    highest = np.maximum.accumulate(excess[::-1])
    start = np.arange(n - least + 1)
    # the furthest end of each start: the last place from which on the highest excess is enough
    end = n - np.searchsorted(highest, excess[start] - 1e-9 * (n + 1), "left")
    start = start[ok := end - start >= least]
    if not len(start):
        return None
    end = end[ok]
    # without the unequal tokens at the end, as far as the length allows
    end = np.minimum(end, np.maximum(start + least, np.searchsorted(sums, sums[end], "left")))
    same = sums[end] - sums[start]
    k = int(np.lexsort((start, end - start, -same))[0])
    return int(start[k]), int(end[k]), int(same[k])


def overlaps(docs: DataFrame, tests: DataFrame, *, min_tokens: int = 13, min_share: float = 0.8, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, tokens, matches): the stretch with the most equal tokens that a document shares with a test item, for each pair that has one of ``min_tokens`` tokens (or the whole item, if it is shorter) with at least ``min_share`` of them equal at their places.

    Tokens: A-Z as a-z, split at white space. Every stretch of
    a diagonal with a seed's hit is tested, whatever surrounds it. Null and empty texts, items of fewer than 8 tokens (the shortest mask) and null ids
    have no overlap. Rows that repeat an id are compared each, and the best is kept; of equally good
    stretches the shortest, then the first in the document, then the first in the item. Texts of any
    length are compared whole. Empty tables give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(docs[quoted(id_column)].cast("long").alias("doc_id"), docs[quoted(text_column)].cast("string").alias("text")).filter("doc_id is not null")
    tests = tests.select(tests[quoted(item_column)].cast("long").alias("item_id"), tests[quoted(item_text)].cast("string").alias("item")).filter("item_id is not null")
    known = cut(_seed_rows(tests, "item_id"), "seeds")
    bloom, bits = _bloom(known)
    hits = _seed_rows(docs, "doc_id", spark.sparkContext.broadcast(bloom), bits)
    known = known.toDF("seed", "item_id", "item_at")
    found = hits.join(known, "seed").select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal"))
    # one row, and so one copy of the texts, for each pair, whatever the number of its hits
    found = cut(found.groupBy("doc_id", "item_id").agg(F.sort_array(F.collect_set("diagonal")).alias("diagonals")), "diagonals")

    some = residues_of(found, "doc_id", "_r")
    texts = docs.withColumn("_r", residue(F.col("doc_id"))).join(some, "_r", "left_semi").select("doc_id", "text")
    rows = found.join(tests, "item_id").join(texts, "doc_id").select("doc_id", "item_id", "diagonals", "item", "text")

    def run(batches):
        for batch in batches:
            ids = [batch.column(c).to_pylist() for c in ("doc_id", "item_id", "diagonals")]
            (doc_bytes, doc_at), (item_bytes, item_at) = (text_buffers(batch.column(c)) for c in ("text", "item"))
            out, last, words = [], None, None
            for i, (doc_id, item_id, diagonals) in enumerate(zip(*ids, strict=True)):
                body = doc_bytes[doc_at[i] : doc_at[i + 1]]
                if last is None or len(last) != len(body) or not np.array_equal(last, body):
                    last, words = body, word_hashes(body, doc_at[i : i + 2])[0]
                item = word_hashes(item_bytes[item_at[i] : item_at[i + 1]], item_at[i : i + 2])[0]
                for diagonal in diagonals:
                    a, b = max(0, -diagonal), min(len(item), len(words) - diagonal)
                    equal = words[a + diagonal : b + diagonal] == item[a:b]
                    best = best_stretch(equal, min(min_tokens, len(item)), min_share)
                    if best is not None:
                        start, end, same = best
                        out.append((doc_id, item_id, a + diagonal + start, a + start, end - start, same))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(6)], names=names)

    names = ["doc_id", "item_id", "doc_start", "item_start", "tokens", "matches"]
    each = rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))
    best = each.groupBy("doc_id", "item_id").agg(F.max(F.struct("matches", (-F.col("tokens")).alias("n"), (-F.col("doc_start")).alias("d"), (-F.col("item_start")).alias("i"))).alias("m"))
    return best.select("doc_id", "item_id", (-F.col("m.d")).alias("doc_start"), (-F.col("m.i")).alias("item_start"), (-F.col("m.n")).alias("tokens"), "m.matches")


def drop_contaminated(docs: DataFrame, tests: DataFrame, **options) -> DataFrame:
    """The rows, with their columns, of documents that share no stretch with a test item."""
    return drop_ids(docs, options.get("id_column", "doc_id"), overlaps(docs, tests, **options).select("doc_id"))
