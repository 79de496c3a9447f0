"""Removal of repeated word sequences by recompression.

A text's words are symbols. One round names runs of equal symbols; each further round deals all
symbols to a left and a right half by their names and names every pair of a left and a right one.
Names are made from what they stand for and so mean the same in all documents, and whether two
symbols become one is decided by these two alone: equal substrings are cut into the same symbols, but
for a few at their ends. Of every symbol of the highest round the words are known that decide it,
its context, some four to ten.

1. Every batch of documents asks, by buckets of hashes, which of its high-level symbols (each named
   with its context) stand in several documents, and which of its documents consist of the same words as one
   with a smaller id: these share their topmost symbol and are repeats as a whole.
2. A window of ``window`` words can repeat only if all symbols whose contexts lie in it are shared.
   The others are cut out; what is left are the long repeats and a few words around chance ones.
   These windows are verified: batches ask with 96-bit hashes of the words and the smallest id
   that has them, and buckets answer whether a document with a smaller id has them too.
3. Words that such a window covers go.

A window without any context in it (runs, unlucky cuts) is always verified, so no repeat is lost. Texts move twice,
compressed, with the answers to their batch. A symbol or window costs a batch one entry, however
often it stands there, so no group of copies gathers in a task: a bucket holds at most one entry of a key for each batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.names import quoted

from .common import SPACE, _mixed, _powers, blocks, cut, discard, mix64, text_buffers
from .katz import _bits, _flags, _pack_keys, _packed, _unpack_keys, _unpacked, pair_hash

_EXACT = _mixed(256, 1213)
_SIDES, _SECOND = _mixed(16, 31), _mixed(1, 57)[0]
#: Bytes that are hashed in one vectorised step.
_STEP = 1 << 22


def word_edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte of each word, the byte behind it, and where each document's words start (one more at the end)."""
    inside = ~SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts], after[cuts - 1] = False, False
    first = np.flatnonzero(inside & ~before)
    return first, np.flatnonzero(inside & ~after) + 1, np.searchsorted(first, offsets)


def exact_hashes(data: np.ndarray, first: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, byte by byte."""
    out, i = np.empty(len(first), np.uint64), 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(behind, first[i] + _STEP, "right")))
        a, b = first[i], behind[j - 1]
        r, inverse = _powers(int(b - a))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_EXACT[data[a:b]] * r[: b - a], dtype=np.uint64)])
        out[i:j] = mix64((sums[behind[i:j] - a] - sums[first[i:j] - a]) * inverse[first[i:j] - a])
        i = j
    return out


class Ranges:
    """Hashes of ranges of a sequence."""

    def __init__(self, values: np.ndarray):
        r, self.inverse = _powers(len(values) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * r[: len(values)], dtype=np.uint64)])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64((self.sums[b] - self.sums[a]) * self.inverse[a])


def name_runs(words: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names of the runs of equal words, the context of each (the run and its neighbours) and which are edges of documents."""
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | edge[1:] | edge[:-1]
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(words)))
    names = np.where(size > 1, pair_hash(words[at], size.astype(np.uint64)), words[at])
    return names, np.maximum(at - 1, 0), np.minimum(at + size + 1, len(words)), edge[at]


def name_pairs(names: np.ndarray, lo: np.ndarray, hi: np.ndarray, edge: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same after a round of pairs. Two symbols decide each cut: a left one is joined if the next is a right one, a right one if the one before is a left one."""
    bit = (mix64(names ^ _SIDES[turn]) & np.uint64(1)).astype(bool)
    left, right = bit & ~edge, ~bit & ~edge
    joined = np.zeros(len(names), bool)
    joined[:-1] = left[:-1] & right[1:]
    stays = np.ones(len(names), bool)
    stays[1:] = ~joined[:-1]
    p = np.flatnonzero(stays)
    one = np.where(edge[p], p, p - right[p])
    two = np.where(edge[p], p, one + 1)
    named = names[p]
    both = joined[p]
    named[both] = pair_hash(names[p[both]], names[p[both] + 1])
    return named, lo[one], hi[two], edge[p]


class Texts:
    """Documents of a batch. Positions count words, with an edge before each document and behind the last."""

    def __init__(self, row: dict, window: int):
        self.ids = pa.array(row["ids"], pa.int64())
        self.named = self.ids.is_valid().to_numpy(zero_copy_only=False)
        self.id = self.ids.fill_null(0).to_numpy()
        self.window = window
        self.data = _unpacked(row["texts"], np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(np.array(row["sizes"], np.int64))])
        self.first, self.behind, self.start = word_edges(self.data, self.offsets)
        self.counts = np.diff(self.start)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.at = np.arange(len(self.doc)) + self.doc + 1
        self.begin = self.start[:-1] + np.arange(len(self.counts)) + 1

    def hashed(self) -> None:
        words = exact_hashes(self.data, self.first, self.behind)
        n = len(words) + len(self.counts) + 1
        self.words, self.edge = np.zeros(n, np.uint64), np.ones(n, bool)
        self.words[self.at], self.edge[self.at] = words, False
        self.one, self.two = Ranges(self.words), Ranges(mix64(self.words ^ _SECOND))

    def symbols(self, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Context (from, to) and name of each high-level symbol whose context lies in a document and isn't longer than a window."""
        level = name_runs(self.words, self.edge)
        for turn in range(rounds):
            level = name_pairs(*level, turn)
        _, lo, hi, edge = level
        edges = np.concatenate([[0], np.cumsum(self.edge)])
        keep = ~edge
        keep[keep] = (hi[keep] - lo[keep] <= self.window) & (edges[hi[keep]] == edges[lo[keep]])
        lo, hi = lo[keep], hi[keep]
        return lo, hi, self.one.of(lo, hi)

    def roots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents with a window and an id, and two hashes of all their words."""
        d = np.flatnonzero((self.counts >= self.window) & self.named)
        a, b = self.begin[d], self.begin[d] + self.counts[d]
        return d, self.one.of(a, b), self.two.of(a, b)


def grouped(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by both hashes, where each group of equal ones starts in it, and each element's group."""
    order = np.lexsort((two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), group


class Question:
    """What a batch asks first: distinct symbols in ascending order, and the smallest document of each distinct whole text."""

    def __init__(self, t: Texts, rounds: int):
        t.hashed()
        self.docs, one, two = t.roots()
        order, start, group = grouped(one, two)
        least = np.minimum.reduceat(t.id[self.docs][order], start) if len(order) else np.zeros(0, np.int64)
        self.root, self.root_two, self.least, self.group = one[order][start], two[order][start], least, group
        # of a batch's equal texts only those with the smallest id go on
        self.copies = np.zeros(len(t.counts), bool)
        self.copies[self.docs] = t.id[self.docs] > least[group]
        self.lo, self.hi, name = t.symbols(rounds)
        doc = np.searchsorted(t.begin, self.lo, "right") - 1
        live = t.named[doc] & ~self.copies[doc]
        self.lo, self.hi, doc = self.lo[live], self.hi[live], t.id[doc[live]]
        self.names, self.place = np.unique(name[live], return_inverse=True)
        low, high = np.full(len(self.names), np.iinfo(np.int64).max), np.full(len(self.names), np.iinfo(np.int64).min)
        np.minimum.at(low, self.place, doc)
        np.maximum.at(high, self.place, doc)
        self.several = low < high


class Dealt:
    """Ascending keys by buckets, which are ranges of them: only those that have keys, so it doesn't grow with the number of buckets."""

    def __init__(self, keys: np.ndarray, buckets: int):
        self.full, start = np.unique(keys >> np.uint64(64 - (buckets.bit_length() - 1)), return_index=True)
        self.edge = np.append(start, len(keys))

    @classmethod
    def of(cls, full: list[int], edge: list[int]) -> Dealt:
        out = cls.__new__(cls)
        out.full, out.edge = np.array(full, np.uint64), np.array(edge, np.int64)
        return out

    def part(self, bucket: int) -> slice:
        i = int(np.searchsorted(self.full, np.uint64(bucket)))
        return slice(int(self.edge[i]), int(self.edge[i + 1])) if i < len(self.full) and self.full[i] == bucket else slice(0, 0)


def batched(docs: DataFrame, batch_bytes: int) -> DataFrame:
    """(batch, ids, sizes, texts) one row for each batch of documents, in the order of the rows; a longer text is a batch of its own."""

    def run(batches):
        held, size, done = [], 0, 0

        def row():
            data = np.concatenate([h[1] for h in held])
            values = ([TaskContext.get().partitionId() << 40 | done], [pa.concat_arrays([h[0] for h in held]).to_pylist()], [np.concatenate([h[2] for h in held])], [_packed(data)], [len(data)])
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int64()), strict=True)], names=["batch", "ids", "sizes", "texts", "bytes"])

        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for d, e in blocks(offsets):
                held.append((batch.column(0).slice(d, e - d), data[offsets[d] : offsets[e]], np.diff(offsets[d : e + 1])))
                size += int(offsets[e] - offsets[d])
                if size >= batch_bytes:
                    yield row()
                    held, size, done = [], 0, done + 1
        if held:
            yield row()

    return docs.mapInArrow(run, "batch long, ids array<long>, sizes array<long>, texts binary, bytes long")


def shared(batches: DataFrame, buckets: int, window: int, rounds: int) -> DataFrame:
    """(batch, bucket, symbols, roots) flags in the order of each batch's question: which symbols stand in several documents, and which whole texts a smaller id has too."""

    def ask(rows):
        for batch in rows:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                q = Question(Texts(row, window), rounds)
                names, roots = Dealt(q.names, buckets), Dealt(q.root, buckets)
                full = np.union1d(names.full, roots.full)
                part = lambda pack, x, dealt: pa.array([pack(x[dealt.part(f)]) for f in full], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int64)), pa.array([row["batch"]] * len(full), pa.int64()), part(_pack_keys, q.names, names), part(_bits, q.several, names), part(_packed, q.root, roots), part(_packed, q.root_two, roots), part(_packed, q.least, roots)], names=["bucket", "batch", "names", "several", "root", "root_two", "least"])

    asked = batches.mapInArrow(ask, "bucket long, batch long, names binary, several binary, root binary, root_two binary, least binary")

    def answer(table: pa.Table) -> pa.Table:
        column = lambda c, read: [read(v.as_buffer()) for v in table.column(c)]
        names = [_unpack_keys(v.as_py()) for v in table.column("names")]
        several = [_flags(v.as_py(), len(n)) for v, n in zip(table.column("several"), names, strict=True)]
        root, two = (column(c, lambda b: _unpacked(bytes(b), np.uint64)) for c in ("root", "root_two"))
        least = column("least", lambda b: _unpacked(bytes(b), np.int64))
        distinct, place, times = np.unique(np.concatenate(names), return_inverse=True, return_counts=True)
        yes = times > 1
        yes[place[np.concatenate(several)]] = True
        return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"), "symbols": pa.array([_bits(x) for x in _split(yes[place], names)], pa.binary()), "roots": pa.array([_bits(x) for x in _split(_smaller(root, two, least), root)], pa.binary())})

    return asked.groupBy("bucket").applyInArrow(answer, "batch long, bucket long, symbols binary, roots binary")


def _split(values: np.ndarray, like: list) -> list[np.ndarray]:
    return np.split(values, np.cumsum([len(x) for x in like])[:-1])


def _smaller(one: list, two: list, least: list) -> np.ndarray:
    """Of each entry, whether another with the same hashes has a smaller id."""
    one, two, least = np.concatenate(one), np.concatenate(two), np.concatenate(least)
    if not len(one):
        return np.zeros(0, bool)
    order, start, group = grouped(one, two)
    return least > np.minimum.reduceat(least[order], start)[group]


def _told(answers: list[dict], column: str, dealt: Dealt) -> np.ndarray:
    """A batch's flags, from the rows of its buckets."""
    out = np.zeros(dealt.edge[-1], bool)
    for a in answers:
        part = dealt.part(a["bucket"])
        out[part] = _flags(a[column], part.stop - part.start)
    return out


WINDOWS = {"batch": pa.int64(), "ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int64()), "texts": pa.binary(), "copies": pa.binary(), "live": pa.binary(), "group": pa.binary(), "later": pa.binary(), "full": pa.list_(pa.int64()), "edge": pa.list_(pa.int64()), "bucket": pa.int64(), "one": pa.binary(), "two": pa.binary(), "least": pa.binary()}
WINDOWS_DDL = "batch long, ids array<long>, sizes array<long>, texts binary, copies binary, live binary, group binary, later binary, full array<long>, edge array<long>, bucket long, one binary, two binary, least binary"


def _rows(size: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in WINDOWS.items()], names=list(WINDOWS))


def _live(t: Texts, q: Question, answers: list[dict], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents that are whole copies, and the first positions of the windows all of whose symbols are shared."""
    copies = q.copies.copy()
    copies[q.docs] |= _told(answers, "roots", Dealt(q.root, buckets))[q.group]
    known = _told(answers, "symbols", Dealt(q.names, buckets))[q.place]
    dead = np.zeros(len(t.words) + 1, np.int32)
    # a symbol that stands in one document only takes out all windows that hold its context
    np.add.at(dead, np.maximum(q.hi[~known] - t.window, 0), 1)
    np.add.at(dead, q.lo[~known] + 1, -1)
    ends = (t.begin + t.counts)[t.doc]
    able = (t.named & ~copies)[t.doc] & (t.at + t.window <= ends)
    return copies, t.at[able & (np.cumsum(dead)[t.at] == 0)]


def windows(batches: DataFrame, answers: DataFrame, buckets: int, window: int, rounds: int) -> DataFrame:
    """A row of each batch, with its texts, and one for each bucket with the windows that the batch asks for."""
    given = answers.groupBy("batch").agg(F.collect_list(F.struct("bucket", "symbols", "roots")).alias("given"))

    def run(rows):
        for batch in rows:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                t = Texts(row, window)
                q = Question(t, rounds)
                copies, live = _live(t, q, row["given"] or [], buckets)
                one, two = t.one.of(live, live + window), (t.two.of(live, live + window) >> np.uint64(32)).astype(np.uint32)
                doc = t.id[np.searchsorted(t.begin, live, "right") - 1]
                order, start, group = grouped(one, two)
                least = np.minimum.reduceat(doc[order], start) if len(order) else np.zeros(0, np.int64)
                one, two = one[order][start], two[order][start]
                dealt = Dealt(one, buckets)
                flags = np.zeros(len(t.words), bool)
                flags[live] = True
                yield _rows(1, batch=[row["batch"]], ids=[row["ids"]], sizes=[row["sizes"]], texts=[row["texts"]], copies=[_bits(copies)], live=[_bits(flags)], group=[_packed(group.astype(np.uint32))], later=[_bits(doc > least[group])], full=[dealt.full.astype(np.int64)], edge=[dealt.edge])
                part = lambda pack, x: [pack(y) for y in np.split(x, dealt.edge[1:-1])]  # noqa: E731, B023
                if n := len(dealt.full):
                    yield _rows(n, batch=[row["batch"]] * n, bucket=dealt.full.astype(np.int64), one=part(_packed, one), two=part(_packed, two), least=part(_packed, least))

    return batches.join(given, "batch", "left").select("batch", "ids", "sizes", "texts", "given").mapInArrow(run, WINDOWS_DDL)


def verified(found: DataFrame) -> DataFrame:
    """(batch, bucket, smaller) which of a batch's windows a document with a smaller id has too."""

    def answer(table: pa.Table) -> pa.Table:
        column = lambda c, kind: [_unpacked(v.as_py(), kind) for v in table.column(c)]
        one = column("one", np.uint64)
        flags = _smaller(one, column("two", np.uint32), column("least", np.int64))
        return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"), "smaller": pa.array([_bits(x) for x in _split(flags, one)], pa.binary())})

    asked = found.filter("bucket is not null").select("batch", "bucket", "one", "two", "least")
    return asked.groupBy("bucket").applyInArrow(answer, "batch long, bucket long, smaller binary")


def kept_texts(t: Texts, gone: np.ndarray) -> list[bytes]:
    """The words that stay of each document, joined by one space."""
    first, behind, doc = t.first[~gone], t.behind[~gone], t.doc[~gone]
    size = behind - first + 1
    end = np.cumsum(size)
    out = t.data[np.minimum(np.arange(end[-1] if len(end) else 0) - np.repeat(end - size - first, size), len(t.data) - 1)]
    out[end - 1] = 0x20
    edge = np.concatenate([[0], end])[np.searchsorted(doc, np.arange(len(t.counts) + 1))]
    raw = out.tobytes()
    return [raw[a : max(a, b - 1)] for a, b in zip(edge[:-1], edge[1:], strict=True)]


def remove_repeats(docs: DataFrame, *, window: int = 13, rounds: int = 3, batch_bytes: int = 4 << 20, bucket_bytes: int = 8 << 20, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id column, text, n_words and n_removed of every row: the words that stay, joined by one space, without those that some window of ``window`` words covers whose word sequence also starts in a document with a smaller id.

    Windows are judged on the texts as they come. Words are compared as they are. A null or empty text has no words and
    gives an empty one. Rows with the same id are one document's: none removes words of another, and each gets a row. A null id is
    neither smaller nor larger than another, so its text stays whole. Texts may be of any length (a task takes some thirty times its longest text in memory); one of fewer words than a window stays. Texts of the same words but the smallest id's are emptied. An
    empty table gives no rows. Other columns are ignored, whatever their names.
    """
    if window < 1 or not 1 <= rounds <= len(_SIDES):
        raise ValueError(f"window must be 1 at least, and rounds from 1 to {len(_SIDES)}")
    rows = docs.select(docs[quoted(id_column)].cast("long").alias("id"), docs[quoted(text_column)].cast("string").alias("text"))
    batches = cut(batched(rows, batch_bytes), "batches")
    total = batches.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    buckets = 1 << max(6, (total // bucket_bytes).bit_length())
    answers = cut(shared(batches, buckets, window, rounds), "symbols")
    found = cut(windows(batches, answers, buckets, window, rounds), "windows")
    discard(batches)
    discard(answers)
    given = cut(verified(found), "verified").groupBy("batch").agg(F.collect_list(F.struct("bucket", "smaller")).alias("given"))
    texts = found.filter("bucket is null").select("batch", "ids", "sizes", "texts", "copies", "live", "group", "later", "full", "edge")

    def finish(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                t = Texts(row, window)
                live = np.flatnonzero(_flags(row["live"], len(t.doc) + len(t.counts) + 1))
                hit = _flags(row["later"], len(live)) | _told(row["given"] or [], "smaller", Dealt.of(row["full"], row["edge"]))[_unpacked(row["group"], np.uint32)]
                cover = np.zeros(len(t.doc) + len(t.counts) + 2 + window, np.int32)
                np.add.at(cover, live[hit], 1)
                np.add.at(cover, live[hit] + window, -1)
                gone = (np.cumsum(cover)[t.at] > 0) | _flags(row["copies"], len(t.counts))[t.doc]
                removed = np.bincount(t.doc[gone], minlength=len(t.counts))
                yield pa.RecordBatch.from_arrays([t.ids, pa.array(kept_texts(t, gone), pa.binary()).cast(pa.string()), pa.array(t.counts), pa.array(removed)], names=["id", "text", "n_words", "n_removed"])

    out = texts.join(given, "batch", "left").mapInArrow(finish, "id long, text string, n_words long, n_removed long")
    return out.withColumnRenamed("id", id_column)
