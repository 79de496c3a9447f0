"""Training-order materialisation: token sequences of one length in a keyed global order.

All documents' ids, in the order of the input's partitions and rows, are one stream; sequence k is its
k-th run of ``length`` ids. A keyed Feistel permutation of the sequence numbers, walked along its cycles until it
is in range, gives each sequence its slot. Slots are dealt to partitions in ranges, so each partition
writes whole shards, in which the record of a slot is at a fixed place: a reader can start at any slot
and needs no index.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.names import quoted

from . import bpe
from .common import _BASE, cut, mix64, shuffles_removed

ROUNDS = 6
#: Pieces, of one sequence at most each, that are packed together for the shuffle: 1 MB of ids of two bytes at the usual length.
BLOCK = 256


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slots of sequences x, among 0 to n - 1: a bijection, for any n below 2^62."""
    half = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = mix64((np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(key & 0xFFFFFFFFFFFFFFFF)) * np.uint64(_BASE))

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> half, v & mask
        for k in keys:
            left, right = right, left ^ (mix64(right ^ k) & mask)
        return left << half | right

    out = once(np.asarray(x).astype(np.uint64))
    while len(far := np.flatnonzero(out >= np.uint64(n))):
        out[far] = once(out[far])
    return out.astype(np.int64)


def tokens(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(part, at, n, ids): the input's partition, the ids that stand before in it, and each row's ids and the end id, little-endian unsigned 16-bit if all fit."""

    def run(batches):
        coder, part, at = bpe.load(tokenizer), TaskContext.get().partitionId(), 0
        kind = np.dtype("<u2" if coder.exact.get_vocab_size() <= 1 << 16 else "<u4")
        end = np.array([end_id], kind).tobytes()
        for batch in batches:
            ids = [np.frombuffer(coder.encode(t.as_py()), "<u4").astype(kind).tobytes() + end for t in batch.column(0)]
            n = np.array([len(i) // kind.itemsize for i in ids], np.int64)
            before = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int64)), pa.array(before), pa.array(n), pa.array(ids, pa.binary())], names=["part", "at", "n", "ids"])

    return docs.mapInArrow(run, "part long, at long, n long, ids binary")


def _squeezed(data: bytes) -> bytes:
    # level 3 finds repeated words that the default, 1, doesn't: 0.56 instead of 0.65 of the ids' bytes
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(data, asbytes=True)


def _opened(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def materialise(docs: DataFrame, *, key: int, length: int = 2048, shard: int = 4096, tokenizer: str | None = None, end_id: int = bpe.END_ID, most_partitions: int = 20_000, text_column: str = "text") -> DataFrame:
    """One row for each sequence: slot, shard, byte_offset (in the file of its shard, as ``write_shards`` writes it), sequence_id, n_tokens, ids_crc32 and record, the ids with the end id as padding. Each partition holds a range of whole shards in the order of slots.

    Null and empty texts: the end id alone. Repeated rows and ids are rows like others. Only the
    last sequence is padded. The stream is pinned by a table of ids, so lost executors change
    nothing; another split of the input gives another stream. An empty table gives no rows. Other
    columns are ignored. Each task makes one shard, or more where there are over ``most_partitions``
    shards (of 16 MB by default); it sorts packed blocks by shard with spills and holds the ids of one shard at a
    time, so its memory stays bounded.
    """
    path = tokenizer or bpe.default_path()
    coded = cut(tokens(docs.select(docs[quoted(text_column)].cast("string").alias("text")), path, end_id), "tokens")
    sums = coded.groupBy("part").agg(F.sum("n").alias("n"), F.max(F.length("ids") / F.col("n")).cast("int").alias("width"))
    sums = cut(sums, "parts")  # a row for each partition of the input
    size = sums.agg(F.sum("n").alias("n"), F.max("width").alias("width")).first()
    total, width = size["n"] or 0, size["width"] or 2
    count = -(-total // length)
    starts = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    n_shards = max(1, -(-count // shard))
    parts = min(n_shards, most_partitions)
    kind = f"<u{width}"
    placed = coded.join(F.broadcast(starts), "part").select((F.col("base") + F.col("at")).alias("at"), "n", "ids")

    def pieces(batches):
        for batch in batches:
            out = [], [], [], []
            at, n = (batch.column(k).to_numpy() for k in (0, 1))
            first, last = at // length, (at + n - 1) // length
            each = (last - first + 1).astype(np.int64)
            row = np.repeat(np.arange(len(at)), each)
            sequence = first[row] + (np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each))
            a, b = np.maximum(sequence * length, at[row]), np.minimum((sequence + 1) * length, at[row] + n[row])
            ids = batch.column(2).to_pylist()
            slot = permute(sequence, count, key)
            number = slot // shard
            head = np.stack([slot, sequence, a - sequence * length, b - a])
            # pieces for one shard are packed together: the shuffle keeps them on disk, and together they take less
            order = np.argsort(number, kind="stable")
            starts = np.flatnonzero(np.diff(number[order], prepend=-1))
            for i, j in zip(starts, [*starts[1:], len(order)], strict=True):
                for k in range(i, j, BLOCK):
                    some = order[k : min(k + BLOCK, j)]
                    body = b"".join(ids[row[p]][(a[p] - at[row[p]]) * width : (b[p] - at[row[p]]) * width] for p in some)
                    for c, v in zip(out, (number[some[0]] * parts // n_shards, number[some[0]], _squeezed(head[:, some].tobytes()), _squeezed(body)), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["part", "shard", "head", "ids"])

    dealt = placed.mapInArrow(pieces, "part long, shard long, head binary, ids binary")
    dealt = dealt.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("shard").select("shard", "head", "ids")
    pad = np.array([end_id], kind).tobytes()

    def records(batches):
        def full(rows):
            return pa.RecordBatch.from_arrays([*(pa.array([r[c] for r in rows], pa.int64()) for c in range(6)), pa.array([r[6] for r in rows], pa.binary())], names=names)

        def written(number, blocks):
            """The records of one shard, from its blocks, in the order of slots."""
            slot, sequence, offset, n = np.concatenate([np.frombuffer(_opened(h), np.int64).reshape(4, -1) for h, _ in blocks], axis=1)
            body, ends = b"".join(_opened(i) for _, i in blocks), np.cumsum(n) * width
            order = np.lexsort((offset, slot))
            starts, out = np.flatnonzero(np.diff(slot[order], prepend=-1)), []
            for i, j in zip(starts, [*starts[1:], len(order)], strict=True):
                one, first = b"".join(body[ends[p] - n[p] * width : ends[p]] for p in order[i:j]), order[i]
                out.append((slot[first], number, slot[first] % shard * (length * width + len(MARK)), sequence[first], len(one) // width, zlib.crc32(one), one + pad * (length - len(one) // width)))
                if len(out) == 1024:
                    yield full(out)
                    out = []
            yield full(out)

        now, held = None, []
        for batch in batches:
            for number, *block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != now and held:
                    yield from written(now, held)
                    held = []
                now = number
                held.append(block)
        if held:
            yield from written(now, held)

    names = ["slot", "shard", "byte_offset", "sequence_id", "n_tokens", "ids_crc32", "record"]
    return dealt.mapInArrow(records, ", ".join(f"{c} long" for c in names[:6]) + ", record binary")


#: One byte stands behind each record, as Spark's writer needs a separator.
MARK = "\n"


def write_shards(rows: DataFrame, path: str) -> None:
    """Writes ``materialise``'s rows as binary files, one folder ``shard=K`` each, through Spark's own committing writer, so to any store it knows and safe against lost executors. Slot s is in shard s // shard, at (s % shard) * (bytes of a record + 1)."""
    # sorted by slot here: no order is known of rows that come from Python, so the writer would sort by shard alone, which loses the slots' order when it spills
    sorted_rows = rows.sortWithinPartitions("shard", "slot").select("shard", F.col("record").cast("string").alias("value"))
    with shuffles_removed(rows.sparkSession):
        sorted_rows.write.partitionBy("shard").option("lineSep", MARK).text(path)


def read_back(spark: SparkSession, path: str, *, length: int = 2048, shard: int = 4096, width: int = 2) -> DataFrame:
    """(slot, shard, byte_offset, n_bytes, record_crc32) of all records that stand in the files that ``write_shards`` wrote, as read from them. Raises if a file isn't whole records with separators, or holds more than a shard."""
    step = length * width + len(MARK)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    files = files.select(F.regexp_extract("path", r"/shard=(\d+)/", 1).cast("long").alias("shard"), "content")

    def run(batches):
        for batch in batches:
            for k, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = memoryview(content.as_buffer())
                n = len(data) // step
                if len(data) % step or n > shard or any(data[i * step + step - 1] != ord(MARK) for i in range(n)):
                    raise ValueError(f"shard {k} isn't whole records of {step} bytes")
                at = np.arange(n, dtype=np.int64)
                crc = [zlib.crc32(data[i * step : (i + 1) * step - len(MARK)]) for i in range(n)]
                columns = (k * shard + at, np.full(n, k, np.int64), at * step, np.full(n, length * width, np.int64), np.array(crc, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    names = ["slot", "shard", "byte_offset", "n_bytes", "record_crc32"]
    return files.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def read_slots(data: bytes, first: int, n: int, length: int, width: int = 2) -> np.ndarray:
    """n records of a shard's bytes from its first-th on, as an array of ids."""
    step = length * width + len(MARK)
    body = np.frombuffer(data[first * step : (first + n) * step], np.uint8).reshape(-1, step)[:, :-1]
    return np.ascontiguousarray(body).view(f"<u{width}")
