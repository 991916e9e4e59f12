"""Substring dedup (operator 3): recompression symbols bring equal windows together.

Each task names the runs and pairs of its texts (``recompress``), which is consistent over all tasks. Every window of
``window`` words is sent to the symbol that the window's words alone decide (least name inside it), or to its own
name where it holds none; neighbouring windows under one symbol travel as one row. Rows of one symbol meet,
sorted by doc_id, and the windows are verified by a second, independent name. Rows with equal words in one slice of a task are
settled there and only the smallest doc_id's row goes on, so a hot passage sends a row per slice, not one per copy.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_texts, stash, text_steps
from .recompress import NONE, choose, mix, symbols

ROUNDS, SHORTEST = 2, 4
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)  # of the rolling names; odd, so that it has an inverse
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BASE2 = np.uint64(0xD1B54A32D192ED03 | 1)  # of the second names, which are rolled from another hash of the words
INVERSE2 = np.uint64(pow(int(BASE2), -1, 1 << 64))
CHECK = 6  # bytes of a window's second name
COUNT_BITS = 24  # of a row's number of windows, below its first word
STEP_BYTES = 1_000_000
#: Windows that a step behind the exchange takes together, names of one key that are carried in memory, parts of a key with more (a power of two).
STEP_WINDOWS, MOST_CARRIED, PARTS = 400_000, 1_000_000, 256
#: Repeated doc_ids that are broadcast; beyond, rows meet them by a shuffle.
MOST_REPEATED = 100_000


def _rolled(names: np.ndarray, base: np.uint64, inverse: np.uint64):
    """A function of arrays (first word, word behind the last): names of stretches of words, equal where the words' names are."""
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(names), base)]))
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(names), inverse)]))
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(names) * powers[:-1])])
    return lambda lo, hi: mix((total[hi] - total[lo]) * back[lo])


def window_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(key, doc, tag, place, checks): neighbouring windows, ``place`` is the first one's first word and, in ``COUNT_BITS`` bits, their number.

    ``checks`` is null for windows already known to be in a document with a smaller id.
    """
    for b in text_steps(batches, step_bytes=STEP_BYTES):
        ids = b.column("doc_id").to_numpy()
        raw = raw_texts(b)
        words = [t.split() for t in raw]
        size = np.array([len(w) for w in words], np.int64)
        n = int(size.sum())
        if n < window:
            continue
        both = np.frombuffer(b"".join(map(xxhash.xxh128_digest, chain.from_iterable(words))), np.uint64).reshape(n, 2)
        names = both[:, 0].copy()
        doc = np.repeat(np.arange(len(words)), size)
        sym, lo, hi = symbols(names, doc, ROUNDS, window)
        best = choose(sym, lo, hi, n, window, SHORTEST)
        first_name, second_name = _rolled(names, BASE, INVERSE), _rolled(both[:, 1], BASE2, INVERSE2)
        every = np.arange(n - window + 1)
        best = np.where(best == NONE, first_name(every, every + window) * np.uint64(5) + np.uint64(1), best)
        inside = doc[:n - window + 1] == doc[window - 1:]
        at = np.flatnonzero(inside)
        if not len(at):
            continue
        # neighbouring windows of one text under one symbol are one row
        new = np.concatenate([[True], (np.diff(at) != 1) | (best[at[1:]] != best[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])])
        first = at[new]
        count = np.diff(np.append(np.flatnonzero(new), len(at)))
        owner, key = doc[first], best[first]
        start = first - (np.cumsum(size) - size)[owner]
        whole, again = (name(first, first + count + window - 1) + key for name in (first_name, second_name))
        order = np.lexsort((ids[owner], again, whole))
        same = np.concatenate([[False], (whole[order][1:] == whole[order][:-1]) & (again[order][1:] == again[order][:-1])])
        least = ids[owner][order][np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        settled = np.zeros(len(order), bool)
        settled[order] = ids[owner][order] > least
        checks = second_name(at, at + window).view(np.uint8).reshape(-1, 8)[:, :CHECK].copy()
        ends = np.where(settled, 0, count)
        checks = checks[np.repeat(~settled, count)]
        offsets = np.concatenate([[0], np.cumsum(ends * CHECK)]).astype(np.int32)
        valid = pa.array(~settled)
        blob = pa.Array.from_buffers(pa.binary(), len(first), [valid.buffers()[1], pa.py_buffer(offsets), pa.py_buffer(checks)])
        tags = b.column("tag").to_numpy()
        # settled rows only pass through: any key will do, so they are spread
        key = np.where(settled, mix(first.astype(np.uint64) + whole), key)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[owner]), pa.array(tags[owner]),
                                          pa.array((start << COUNT_BITS) | count), blob], names=["key", "doc", "tag", "place", "checks"])


def _spans(doc, tag, first, n, gone, window):
    """Word spans (doc, tag, lo, hi) covered by the windows flagged in ``gone`` (flat over rows of n windows)."""
    row = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = np.flatnonzero(gone)
    if not len(at):
        return None
    new = np.concatenate([[True], (np.diff(at) != 1) | (row[at[1:]] != row[at[:-1]])])
    lo, hi = at[new], at[np.append(np.flatnonzero(new)[1:], len(at)) - 1]
    start = first[row[lo]]
    return doc[row[lo]], tag[row[lo]], start + pos[lo], start + pos[hi] + window


def _later(key: np.ndarray, names: np.ndarray, docs: np.ndarray):
    """Which windows a smaller doc_id has under the same key and name; the order by (key, name, doc_id) and the first ones in it."""
    order = np.lexsort((docs, names, key))
    new = np.concatenate([[True], (names[order][1:] != names[order][:-1]) | (key[order][1:] != key[order][:-1])])
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    gone = np.zeros(len(order), bool)
    gone[order] = docs[order] > docs[lead]
    return gone, order, new


class _LargeKey:
    """Windows of one key, dealt by their names into parts of a temporary file, so that one part is held at a time.

    What stays in memory is a flag a window and the places of the parts.
    """

    def __init__(self, names: np.ndarray, docs: np.ndarray):
        self.file = tempfile.TemporaryFile()
        self.pieces, self.rows, self.windows = [], [], 0
        self._deal(names, docs, np.full(len(names), -1))

    def _deal(self, names, docs, at) -> None:
        part = (names & np.uint64(PARTS - 1)).astype(np.uint8)
        ends = np.cumsum(np.bincount(part, minlength=PARTS))
        self.pieces.append((self.file.tell(), ends))
        self.file.write(np.stack([names.view(np.int64), docs, at], axis=1)[np.argsort(part, kind="stable")].tobytes())

    def add(self, doc, tag, first, n, names) -> None:
        self._deal(names, np.repeat(doc, n), np.arange(self.windows, self.windows + len(names)))
        self.rows.append((self.file.tell(), len(doc), self.windows, self.windows + len(names)))
        self.file.write(np.stack([doc, tag, first, n]).astype(np.int64).tobytes())
        self.windows += len(names)

    def _read(self, start: int, numbers: int) -> np.ndarray:
        self.file.seek(start)
        return np.frombuffer(self.file.read(8 * numbers), np.int64)

    def spans(self, window: int) -> Iterator[tuple | None]:
        gone = np.zeros(self.windows, bool)
        for p in range(PARTS):
            lows = [(start, int(ends[p - 1]) if p else 0, int(ends[p])) for start, ends in self.pieces]
            names, docs, at = np.concatenate([self._read(start + 24 * lo, 3 * (hi - lo)) for start, lo, hi in lows]).reshape(-1, 3).T
            if len(names):
                late = at[_later(np.zeros(len(names), np.int8), names, docs)[0]]
                gone[late[late >= 0]] = True
        for start, n_rows, lo, hi in self.rows:
            yield _spans(*self._read(start, 4 * n_rows).reshape(4, -1), gone[lo:hi], window)
        self.file.close()


def _window_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """(key, doc, tag, first word, number of windows, whether settled) of rows, and the names of the windows that aren't, ``STEP_WINDOWS`` or more at a time."""
    held, size = [], 0
    for b in batches:
        key, doc, tag, place = (b.column(c).to_numpy() for c in ("key", "doc", "tag", "place"))
        blob = b.column("checks")
        data = np.frombuffer(b"".join(blob.drop_null().to_pylist()), np.uint8).reshape(-1, CHECK)
        names = np.zeros((len(data), 8), np.uint8)
        names[:, :CHECK] = data
        held.append((key, doc, tag, place >> COUNT_BITS, place & ((1 << COUNT_BITS) - 1), np.asarray(blob.is_null()), names.view(np.uint64).ravel()))
        size += len(names) + len(key)
        if size >= STEP_WINDOWS:
            yield [np.concatenate(x) for x in zip(*held)]
            held, size = [], 0
    if size:
        yield [np.concatenate(x) for x in zip(*held)]


def _repeats(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple | None]:
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    carried_key, carried, large = None, none, None
    for key, doc, tag, first, n, ready, names in _window_steps(batches):
        if ready.any():
            yield _spans(doc[ready], tag[ready], first[ready], n[ready], np.ones(int(n[ready].sum()), bool), window)
            key, doc, tag, first, n = (x[~ready] for x in (key, doc, tag, first, n))
        if large is not None and len(key):
            own = int(np.searchsorted(key, carried_key, side="right"))
            flat = int(n[:own].sum())
            large.add(doc[:own], tag[:own], first[:own], n[:own], names[:flat])
            key, doc, tag, first, n, names = key[own:], doc[own:], tag[own:], first[own:], n[own:], names[flat:]
            if len(key):
                yield from large.spans(window)
                carried_key, carried, large = None, none, None
        if not len(key):
            continue
        run = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
        goes_on = carried_key is not None and key[0] == carried_key
        at = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        many = doc[at] != doc[np.append(at[1:], len(doc)) - 1]  # sorted by doc: first and last differ
        if goes_on:
            many[0] = True
        last = run[-1]
        use = many[run] | (run == last)
        flat = np.repeat(use, n)
        r, d, c = np.repeat(run[use], n[use]), np.repeat(doc[use], n[use]), names[flat]
        head = carried if goes_on else none
        r, d, c = (np.concatenate(x) for x in ((np.zeros(len(head[0]), np.int64), r), (head[1], d), (head[0], c)))
        gone, order, new = _later(r, c, d)
        yield _spans(doc[use], tag[use], first[use], n[use], gone[len(head[0]):], window)
        ends = order[new][r[order[new]] == last]
        carried_key, carried = key[-1], (c[ends], d[ends])
        if len(ends) > MOST_CARRIED:
            large, carried = _LargeKey(*carried), none
    if large is not None:
        yield from large.spans(window)


def repeated_spans(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, doc) in, word spans out that a smaller doc_id's windows repeat.

    Of the key that a step ends with only its windows' names and smallest doc_ids are carried on, not its rows. A key with over ``MOST_CARRIED``
    names goes through a temporary file, so no step sorts more than that beside its own windows, however common the key is.
    """
    for found in _repeats(batches, window):
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], names=["doc", "tag", "lo", "hi"])


def _travel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as rows of the span table, compressed for the exchange."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for b in text_steps(batches):
        raw = raw_texts(b)
        none = pa.nulls(b.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tag"), none, none,
                                          pa.array([squeeze(t) for t in raw], pa.binary())], names=["doc", "tag", "lo", "hi", "raw"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of a text, then the text, in; the text without the spans' words out."""
    names = ["doc_id", "n_words", "n_removed", "kept"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    stretch = zstandard.ZstdDecompressor().decompress
    here, spans = None, []
    for b in batches:
        out, size = [], 0
        for doc, tag, lo, hi, text in zip(*(b.column(c).to_pylist() for c in ("doc", "tag", "lo", "hi", "raw"))):
            if (doc, tag) != here:
                here, spans = (doc, tag), []
            if text is None:
                spans.append((lo, hi))
                continue
            text = stretch(text)
            words = text.split()
            end, parts = 0, []
            for lo, hi in sorted(spans):
                if lo > end:
                    parts += words[end:lo]
                end = max(end, hi)
            kept = parts + words[end:]
            out.append((doc, len(words), len(words) - len(kept), b" ".join(kept).decode()))
            size += len(text)
            if size > 8_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)


def _tagged(d: DataFrame) -> DataFrame:
    """``d`` with ``tag``: 0 for an id that no other row has, a written row number (above 0) for others; null ids get a hash that spreads them."""
    repeated = d.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    n = repeated.limit(MOST_REPEATED + 1).count()
    nulls = d.where("doc_id is null").withColumn("tag", F.xxhash64("text"))
    if not n:
        return d.where("doc_id is not null").withColumn("tag", F.lit(0).cast("long")).unionByName(nulls)
    repeated = F.broadcast(repeated) if n <= MOST_REPEATED else repeated
    own = stash(d.join(repeated, "doc_id", "left_semi").withColumn("tag", F.monotonically_increasing_id() + 1), "repeated-ids")
    return d.where("doc_id is not null").join(repeated, "doc_id", "left_anti").withColumn("tag", F.lit(0).cast("long")).unionByName(own).unionByName(nulls)


def dedup_substrings(docs: DataFrame, window: int = 13) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept (the words left, joined by a space).

    A word goes if a window of ``window`` consecutive words of its document that covers it also starts in a document with a
    smaller doc_id, judged on the input. Words are split at ASCII white space. Null and empty texts have no
    words; a null doc_id is neither smaller nor larger, so such rows keep all words; rows that repeat a doc_id don't count as
    smaller than each other and are told apart by a written row number. Two windows count as equal if two names of 64 and 48 bits, rolled
    from independent hashes of their words, agree. An empty table gives an empty one; other columns are not read.
    """
    d = _tagged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    rows = d.where("doc_id is not null").mapInArrow(lambda it: window_rows(it, window), "key long, doc long, tag long, place long, checks binary")
    spans = (rows.repartition("key").sortWithinPartitions("key", "doc")
             .mapInArrow(lambda it: repeated_spans(it, window), "doc long, tag long, lo long, hi long"))
    tagged = d.mapInArrow(_travel, "doc long, tag long, lo long, hi long, raw binary")
    both = spans.withColumn("raw", F.lit(None).cast("binary")).unionByName(tagged)
    # rows without an id are spread by their tag
    return (both.repartition("doc", "tag").sortWithinPartitions("doc", "tag", F.col("raw").isNotNull())
            .mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept string"))
