"""Helpers that several operators share: reading tables, cutting lineage, hashing words."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.names import col, cols

_LOCAL: list[str] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A temporary one only in local mode, where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="quern-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as a table in the shared folder and read it again: later stages then don't depend on this lineage or on any executor."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Queries inside end with Spark removing their shuffle files, by its own setting; once their result is written nothing reads these again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def discard(table: DataFrame) -> None:
    """Deletes what ``cut`` wrote. Only for tables that nothing reads any more."""
    jvm, path = table.sparkSession.sparkContext._jvm, table.written_to
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


#: Residues of ids that a broadcast may hold.
RESIDUES = 1 << 20


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for inner columns that no column of ``df`` has, whatever its case."""
    taken, k = {c.lower() for c in df.columns}, 0
    while any(f"{n}_{k}".lower() in taken or f"{n}_{k}_".lower() in taken for n in names):
        k += 1
    return [f"{n}_{k}" for n in names]


def residues_of(ids: DataFrame, column: str, name: str) -> DataFrame:
    """(name) the residues of the ids, at most RESIDUES rows of 8 bytes, whatever the table's size: a proven bound for a broadcast."""
    return F.broadcast(ids.select(residue(F.col(column)).alias(name)).distinct())


def residue(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(RESIDUES))


def drop_ids(docs: DataFrame, id_column: str, ids: DataFrame) -> DataFrame:
    """The rows whose id isn't in the one column of ``ids``; null ids stay. Only rows that share a residue with one are shuffled."""
    name, r = fresh(docs, "gone", "residue")
    ids = ids.toDF(name)
    gone = cut(ids.filter(F.col(name).isNotNull()).distinct(), "gone")
    # the id's type in ids may differ; both sides' residues must be those of one type
    kind = dict(gone.dtypes)[name]
    some, keyed = residues_of(gone, name, r), docs.withColumn(r, residue(col(id_column).cast(kind)))
    rest = keyed.join(some, r, "left_anti").select(*cols(docs.columns))
    near = keyed.join(some, r, "left_semi").join(gone, col(id_column).cast(kind) == F.col(name), "left_anti").select(*cols(docs.columns))
    return rest.unionByName(near)


def learn_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


# --- words as 64-bit hashes, whole Arrow columns at once --------------------------------

#: Word separators: U+0020 and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_M = 0xFFFFFFFFFFFFFFFF
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mixed(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values (splitmix64)."""
    x = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(_BASE)
    return mix64(x)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mixed(256, 11)
_BYTE[65:91] = _BYTE[97:123]
_POWERS: list[np.ndarray] = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the start of each value (one more at the end). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return b, o - o[0]


def blocks(offsets: np.ndarray, size: int = 1 << 21):
    """Ranges of documents of about ``size`` bytes, one document at least."""
    d, n = 0, len(offsets) - 1
    while d < n:
        e = max(d + 1, int(np.searchsorted(offsets, offsets[d] + size, "right")) - 1)
        yield d, e
        d = e


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of other bytes than separators, A-Z as a-z) of some documents, and where each document's words start (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    offsets = offsets - offsets[0]
    inside = ~SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    cuts = offsets[offsets < n]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after)
    r, inverse = _powers(n)
    sums = np.cumsum(_BYTE[data] * r[:n], dtype=np.uint64)
    left = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    return mix64((sums[ends] - left) * inverse[starts]), np.searchsorted(starts, offsets)


_SHINGLE = _mixed(64, 77) | np.uint64(1)


def shingle_hashes(words: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words within documents; a document with fewer words has one, of them all; without words none. Also the document of each, ascending."""
    counts = np.diff(starts)
    many = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    docs = np.repeat(np.arange(len(counts)), many)
    first = np.concatenate([[0], np.cumsum(many)])
    at = starts[docs] + (np.arange(len(docs)) - first[docs])
    out = np.zeros(len(docs), np.uint64)
    size = np.minimum(counts, width)[docs]
    full = size == width
    whole = at[full] if not full.all() else at
    acc = np.zeros(len(whole), np.uint64)
    for j in range(width):
        acc += words[whole + j] * _SHINGLE[j]
    out[full] = acc
    for k in range(1, width):
        short = size == k
        if short.any():
            out[short] = sum((words[at[short] + j] * _SHINGLE[j] for j in range(k)), _SHINGLE[width + k : width + k + 1])
    return mix64(out), docs

