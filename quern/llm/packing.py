"""Sum-of-squares online packing of tokenised documents into fixed windows."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quern.functions.names import quoted

from . import bpe

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


class SumOfSquares:
    """Windows of ``capacity`` tokens. ``level[h]`` counts the partially filled windows that hold h tokens; each piece goes to the fill level, a new window's 0 included, after which the sum of the squared counts is least. Ties: the fuller window."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.level = np.zeros(capacity + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(capacity)]

    def place(self, size: int, piece) -> list | None:
        """Adds a piece of 1 to capacity - 1 tokens. The window's pieces if it is now full."""
        n = self.level
        n[self.capacity] = 0
        last = self.capacity - size
        # a window going from h to h + size changes the sum by 2 * (n[h + size] - n[h]) + 2; a full window leaves the sum
        change = 2 * (n[1 + size : last + size + 1] - n[1 : last + 1]) + 2
        change[-1] = 1 - 2 * n[last]
        change[n[1 : last + 1] == 0] = np.iinfo(np.int64).max
        best = last - int(np.argmin(change[::-1]))
        if change[best - 1] <= 2 * n[size] + 1:
            n[best] -= 1
            window = self.open[best].pop()
        else:
            best, window = 0, []
        window.append(piece)
        if best + size == self.capacity:
            return window
        n[best + size] += 1
        self.open[best + size].append(window)
        return None

    def rest(self) -> Iterator[tuple[int, list]]:
        """Empties the level array, fullest windows first."""
        for h in range(self.capacity - 1, 0, -1):
            for window in self.open[h]:
                yield h, window
            self.open[h], self.level[h] = [], 0


def _parts(n: int) -> Iterator[int]:
    """Powers of two that add up to n, largest first."""
    while n:
        p = 1 << (n.bit_length() - 1)
        yield p
        n -= p


class Packer:
    """Packs documents, one after the other, and yields (window length, [(doc_id, start, ids, doc tokens)])."""

    def __init__(self, capacity: int):
        self.capacity, self.windows, self.recut = capacity, SumOfSquares(capacity), 0

    def add(self, doc_id, ids: bytes) -> Iterator[tuple[int, list]]:
        n, size = len(ids) // 4, self.capacity
        for start in range(0, n - size + 1, size):
            yield size, [(doc_id, start, ids[4 * start : 4 * (start + size)], n)]
        if n % size:
            start = n - n % size
            full = self.windows.place(n % size, (doc_id, start, ids[4 * start :], n))
            if full is not None:
                yield size, full

    def finish(self) -> Iterator[tuple[int, list]]:
        """The windows still open stay as they were placed, fullest first, and are filled up with the pieces of the emptiest, which are cut for that; of the last one powers of two remain, so nothing is padded. ``recut`` counts the tokens that so leave their window."""
        left = deque(window for _, window in self.windows.rest())
        tokens = lambda pieces: sum(len(p[2]) for p in pieces) // 4
        spare: deque = deque()
        open_tokens = sum(map(tokens, left))

        def take(room: int) -> Iterator:
            while room:
                if not spare:
                    spare.extend(left.pop())
                doc_id, start, ids, n = spare.popleft()
                some = min(room, len(ids) // 4)
                if 4 * some < len(ids):
                    spare.appendleft((doc_id, start + some, ids[4 * some :], n))
                room -= some
                yield doc_id, start, ids[: 4 * some], n

        while left:
            if open_tokens < self.capacity:
                for window in left:
                    spare.extend(window)
                break
            window = left.popleft()
            room = self.capacity - tokens(window)
            self.recut += room
            open_tokens -= self.capacity
            yield self.capacity, window + list(take(room))
        last = tokens(spare)
        self.recut += last
        for size in _parts(last):
            yield size, list(take(size))


def pack(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = bpe.END_ID, capacity: int = 2048, block_docs: int = 100_000, with_ids: bool = True, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each piece of each document, with its window (``sequence_id``, ``offset``) and, ``with_ids``, its ids (little-endian unsigned 32-bit).

    A document is its ids and then ``end_id``. Windows are packed per input partition as a stream;
    no row is shuffled. Only the pieces of open windows are held; after ``block_docs`` documents the
    open windows are completed and a new level array starts, so memory stays bounded.
    ``sequence_id``: partition * 2^40 + count, the same again when a task is repeated.

    Null or empty text: the end id alone. A null id stays null. Repeated rows are packed each.
    An empty table gives no rows. Other columns are ignored.
    """
    path = tokenizer or bpe.default_path()

    def run(batches):
        coder, end = bpe.load(path), np.array([end_id], "<u4").tobytes()
        next_id, out = TaskContext.get().partitionId() << 40, [[] for _ in range(9)]
        packer, seen = Packer(capacity), 0

        def put(windows):
            nonlocal next_id
            for size, window in windows:
                offset = 0
                for doc_id, start, ids, n in window:
                    for column, v in zip(out, (doc_id, start, len(ids) // 4, zlib.crc32(ids), n, next_id, offset, size, ids if with_ids else None), strict=True):
                        column.append(v)
                    offset += len(ids) // 4
                next_id += 1

        def rows():
            arrays = [pa.array(c, pa.int64()) for c in out[:8]] + ([pa.array(out[8], pa.binary())] if with_ids else [])
            for c in out:
                c.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                put(packer.add(doc_id, coder.encode(text.as_py()) + end))
                seen += 1
                if seen % block_docs == 0:
                    put(packer.finish())
                if len(out[0]) >= 8192:
                    yield rows()
        put(packer.finish())
        yield rows()

    schema = PIECES + (", ids binary" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(docs[quoted(id_column)].cast("long").alias("doc_id"), docs[quoted(text_column)].cast("string").alias("text")).mapInArrow(run, schema)
