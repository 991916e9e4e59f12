"""Benchmark decontamination (operator 2): CGK embedding, bit-sampling LSH, edit verification.

Chakraborty, Goldenberg and Koucky (STOC 2016): a random walk reads a string, at each step writes the
symbol it stands on and moves on by a random bit that depends on the step and the symbol. Strings at small edit
distance get walks that meet again, so the written strings are at small Hamming distance. Each repetition
draws a walk and sampled steps; a window of item size is a candidate if its symbols at
all sampled steps are those of an item. Symbols are words; a candidate is verified by its word edit distance.
"""

from __future__ import annotations

import pickle
import string
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_steps, texts

DROP = string.punctuation.encode()
CLASS_STEP = 1.2  # item lengths within this factor share a window size (that of the shortest)
MEET = (4, 12, *(28 << k for k in range(40)))  # steps after which walks that have met are joined
ITEM_BLOCK = 20_000  # items a broadcast holds; more items are handled block after block


def words_of(text: str) -> list[bytes]:
    """Lower-cased words without ASCII marks; words of marks alone vanish."""
    return text.lower().encode().translate(None, DROP).split()


class Index:
    """LSH tables of a block of items: by repetition, the walk's bits and the sampled steps of each length class.

    Items under ``min_words`` words are too short to sample; they are looked up by their whole word sequence.
    """

    def __init__(self, items: list[tuple[int, list[bytes]]], max_edits: float, repetitions: int, samples: int, seed: int = 11, min_words: int = 1):
        rng = np.random.default_rng(seed)
        items = sorted(items, key=lambda i: len(i[1]) < min_words)  # short ones last
        self.vocab: dict[bytes, int] = {}
        self.items = [(i, np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], np.int32)) for i, words in items]
        self.edits = [int(max_edits * len(w)) if len(w) >= min_words else 0 for _, w in self.items]
        long = sum(len(w) >= min_words for _, w in self.items)
        self.short: dict[int, dict[bytes, list[int]]] = {}  # words -> their ids as bytes -> items
        for k, (_, w) in enumerate(self.items[long:], long):
            self.short.setdefault(len(w), {}).setdefault(w.tobytes(), []).append(k)
        self.pad = len(self.vocab) + 1  # before, between and after texts
        sizes = sorted({len(w) for _, w in self.items[:long]})
        self.classes: list[tuple[int, list[int]]] = []  # (window words, items)
        while sizes:
            top = sizes[0] * CLASS_STEP
            self.classes.append((sizes[0], [k for k, (_, w) in enumerate(self.items[:long]) if sizes[0] <= len(w) <= top]))
            sizes = [s for s in sizes if s > top]
        self.repetitions = []
        for _ in range(repetitions if self.classes else 0):
            steps = 2 * self.classes[-1][0]
            bits = rng.integers(0, 1 << 62, (steps // 62 + 1, self.pad + 1), dtype=np.int64)
            tables = []
            for c, (window, members) in enumerate(self.classes):
                # the steps come from the whole walk over the window, so no part of an item is needed by all tables
                goals = np.sort(rng.choice(2 * window, samples, replace=False)).tolist()
                written = np.array([self._written(self.items[k][1], bits, goals, window) for k in members], np.int64)
                starts = np.zeros(self.pad + 1, bool)
                starts[written[:, 0]] = True
                heads = [np.unique(self._mix(written[:, :m].T)) for m in range(2, samples)]
                full = self._mix(written.T)
                order = np.argsort(full, kind="stable")
                tables.append((goals, c, starts, heads, full[order], np.array(members)[order]))
            self.repetitions.append((bits, sorted(tables, key=lambda t: t[:2])))

    def _mix(self, columns) -> np.ndarray:
        """One number for the symbols of the columns (it may wrap around: verification drops what meets by chance)."""
        out = np.zeros(len(columns[0]), np.int64)
        for c in columns:
            out = out * (self.pad + 1) + c
        return out

    def _written(self, word_ids: np.ndarray, bits: np.ndarray, at: list[int], window: int) -> list[int]:
        """What the walk over the item's first ``window`` words writes at the steps ``at``."""
        i, out = 0, []
        for step in range(at[-1] + 1):
            sym = int(word_ids[i]) if i < window else self.pad
            if step in at:
                out.append(sym)
            i += int(bits[step // 62, sym] >> (step % 62)) & 1
        return out

    def short_hits(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, item) of every stretch of words that is a short item."""
        for n, known in self.short.items():
            if len(ids) < n:
                continue
            heads = np.zeros(self.pad + 1, bool)
            heads[[np.frombuffer(w, np.int32)[0] for w in known]] = True
            for at in np.flatnonzero(heads[ids[:len(ids) - n + 1]]).tolist():
                for k in known.get(ids[at:at + n].tobytes(), ()):
                    yield at, k

    def candidates(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window start, item) pairs of all repetitions. All windows walk to the first sampled step of their length class;
        only those that still agree with some item walk on, as a table lookup fails at the first symbol that differs.
        Windows whose walks have met go on as one: they read the same words from there."""
        n = len(ids)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        tail = np.full(2 * self.classes[-1][0] + 1 if self.classes else 1, self.pad, ids.dtype)
        ids = np.concatenate([ids, tail])  # no walk leaves the array

        def walk(turn, at, steps):
            buf = np.empty(len(at), np.int64)
            for step in steps:
                np.take(turn, at, out=buf, mode="clip")
                np.right_shift(buf, step % 62, out=buf)
                np.bitwise_and(buf, 1, out=buf)
                np.add(at, buf, out=at)

        if not self.classes:
            return found[0]
        windows = np.array([w for w, _ in self.classes])
        # Of a window within k edits of an item, all words but k are the item's: others can't be verified and don't walk.
        known = np.concatenate([[0], np.cumsum((ids > 0) & (ids < self.pad))])
        fits = np.stack([known[w:n + w] - known[:n] >= w - max(self.edits[k] for k in members) for w, members in self.classes])
        base = np.flatnonzero(fits.any(axis=0))
        for bits, tables in self.repetitions if len(base) else ():
            at, group = base.copy(), np.arange(len(base) + 1)  # walks that differ; where the windows of each begin in ``base``
            step, turn = 0, bits[0][ids]
            for goals, c, starts, heads, keys, owner in tables:
                while step < goals[0]:
                    stop = min(goals[0], step // 62 * 62 + 62, next(m for m in MEET if m > step))
                    walk(turn, at, range(step, stop))
                    step = stop
                    if step % 62 == 0:
                        turn = bits[step // 62][ids]
                    if step in MEET:
                        new = np.flatnonzero(np.diff(at, prepend=-1))  # walks keep their order
                        at, group = at[new], np.append(group[new], len(base))
                hit = starts.take(ids.take(at, mode="clip"), mode="clip")  # clip: no bounds check, all are inside
                if starts[self.pad]:
                    hit |= at >= base[group[:-1]] + windows[c]
                hit = np.flatnonzero(hit)
                count = group[hit + 1] - group[hit]
                begin = base[np.repeat(group[hit] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))]
                pos = np.repeat(at[hit], count)
                keep = fits[c][begin]
                begin, pos = begin[keep], pos[keep]
                code, here = np.zeros(len(begin), np.int64), step
                for goal, met in zip(goals, [np.flatnonzero(starts), *heads, keys]):
                    while here < goal:
                        stop = min(goal, here // 62 * 62 + 62)
                        walk(turn if here // 62 == step // 62 else bits[here // 62][ids], pos, range(here, stop))
                        here = stop
                    code = code * (self.pad + 1) + np.where(pos < begin + windows[c], ids[pos], self.pad)
                    keep = met[np.minimum(np.searchsorted(met, code), len(met) - 1)] == code
                    begin, pos, code = begin[keep], pos[keep], code[keep]
                    if not len(begin):
                        break
                if len(begin):
                    lo = np.searchsorted(keys, code, "left")
                    count = np.searchsorted(keys, code, "right") - lo
                    found.append((np.repeat(begin, count), owner[np.repeat(lo - np.cumsum(count) + count, count) + np.arange(int(count.sum()))]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def verify(self, ids: np.ndarray, lows: np.ndarray, highs: np.ndarray, begin: np.ndarray, item: np.ndarray):
        """Least edits between the item and any stretch of words around each candidate: (edits, end of the stretch)."""
        edits, ends = np.full(len(begin), 1 << 30), np.zeros(len(begin), np.int64)
        for k in np.unique(item):
            pick = np.flatnonzero(item == k)
            words, most = self.items[k][1], self.edits[k]
            for part in np.array_split(pick, len(pick) // 2000 + 1):
                lo = begin[part] - most
                span = np.arange(len(words) + 2 * most + SNAP)
                at = lo[:, None] + span
                inside = (at >= lows[part][:, None]) & (at < highs[part][:, None])
                region = np.where(inside, ids[np.clip(at, 0, len(ids) - 1)], self.pad)
                # within ``most`` edits all but ``most`` of the item's words are there
                own = np.zeros(self.pad + 1, bool)
                own[words] = True
                enough = own[region].sum(axis=1) >= len(words) - most
                part, lo, region = part[enough], lo[enough], region[enough]
                row = np.zeros((len(part), len(span) + 1), np.int32)
                ramp = np.arange(len(span) + 1, dtype=np.int32)
                for w in words:
                    new = row + 1
                    np.minimum(new[:, 1:], row[:, :-1] + (region != w), out=new[:, 1:])
                    row = np.minimum.accumulate(new - ramp, axis=1) + ramp
                if not len(part):
                    continue
                edits[part] = row.min(axis=1)
                ends[part] = lo + row.argmin(axis=1)
        return edits, ends


STEP_BYTES = 1_000_000  # text searched at a time: the walks of all its windows stay in a core's cache
SNAP = 8  # candidates of one item whose starts share a block of so many words are verified together


def _search(index: Index, batch: list[str]) -> list[tuple[int, int, int, int]]:
    """(text number, item number, edits, end word) of verified hits, the best of a text and item."""
    get = index.vocab.get
    docs = [words_of(t) for t in batch]
    sizes = np.array([len(d) for d in docs], np.int64)
    ids = np.full(int(sizes.sum()) + len(docs) + 1, index.pad, np.int32)
    lows = np.cumsum(sizes + 1) - sizes
    for lo, d in zip(lows.tolist(), docs):
        ids[lo:lo + len(d)] = np.fromiter(map(get, d, repeat(0)), np.int32, len(d))
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for at, k in index.short_hits(ids):
        doc = int(np.searchsorted(lows, at, side="right")) - 1
        best.setdefault((doc, k), (0, at - int(lows[doc]) + len(index.items[k][1])))
    begin, item = index.candidates(ids)
    if not len(begin):
        return [(d, i, e, end) for (d, i), (e, end) in best.items()]
    pairs = np.unique(np.stack([begin // SNAP * SNAP, item], axis=1), axis=0)
    begin, item = pairs[:, 0], pairs[:, 1]
    doc = np.clip(np.searchsorted(lows, begin + SNAP - 1, side="right") - 1, 0, None)
    # a block of starts can reach over the border of two texts: look at both
    prev = np.searchsorted(lows, begin, side="right") - 1
    two = np.flatnonzero((prev != doc) & (prev >= 0))
    doc, begin, item = np.concatenate([doc, prev[two]]), np.concatenate([begin, begin[two]]), np.concatenate([item, item[two]])
    edits, ends = index.verify(ids, lows[doc], (lows + sizes)[doc], begin, item)
    limit = np.array(index.edits)
    for j in np.flatnonzero(edits <= limit[item]).tolist():
        key, hit = (int(doc[j]), int(item[j])), (int(edits[j]), int(ends[j] - lows[doc[j]]))
        if key not in best or hit < best[key]:
            best[key] = hit
    return [(d, i, e, end) for (d, i), (e, end) in best.items()]


def item_blocks(benchmark: DataFrame, max_edits: float, repetitions: int, samples: int, min_words: int, least_words: int = 1) -> Iterator[Broadcast]:
    """The index of each block of at most about ``ITEM_BLOCK`` items of ``least_words`` words or more, broadcast."""
    items = (benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
             .where("item_id is not null and text is not null").distinct())
    # blocks by a hash of the item, so that their number alone follows the number of items
    blocks = items.count() // ITEM_BLOCK + 1
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        own = [(r.item_id, w) for r in rows if len(w := words_of(r.text)) >= least_words]
        yield benchmark.sparkSession.sparkContext.broadcast(pickle.dumps(Index(own, max_edits, repetitions, samples, min_words=min_words)))


def find_leaks(docs: DataFrame, benchmark: DataFrame, max_edits: float = 0.2, repetitions: int = 32, samples: int = 3,
               min_words: int = 8) -> DataFrame:
    """One row per document and item met: doc_id, item_id, item_words, edits, similarity, end_word.

    An item is met if some stretch of a document's words is within ``max_edits`` x its words of word edits, and its window was
    retrieved in one of ``repetitions`` tables. ``edits`` is the least found, ``end_word`` the word where that stretch
    ends. Items under ``min_words`` words are met where their words stand in a row unchanged. Items without a word, null ids (of items) and null
    texts match nothing. Repeated rows of a doc_id
    count as one document (least edits); a null doc_id is a document of its own. Empty tables give an
    empty result; other columns are not read. Items are broadcast in blocks of ``ITEM_BLOCK``; every document is read whole.
    """
    schema = "doc_id long, item_id long, item_words long, edits long, similarity double, end_word long"
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for shared in item_blocks(benchmark, max_edits, repetitions, samples, min_words):
        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = pickle.loads(shared.value)
            for b in text_steps(batches, step_bytes=STEP_BYTES):
                hits = _search(index, texts(b))
                if not hits:
                    continue
                at, item, edits, end = (list(c) for c in zip(*hits))
                n = [len(index.items[i][1]) for i in item]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(at)), pa.array([index.items[i][0] for i in item], pa.int64()), pa.array(n, pa.int64()),
                     pa.array(edits, pa.int64()), pa.array([1 - e / k for e, k in zip(edits, n)]), pa.array(end, pa.int64())],
                    names=["doc_id", "item_id", "item_words", "edits", "similarity", "end_word"])

        part = d.mapInArrow(search, schema)
        out = part if out is None else out.union(part)
    best = out.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "item_words", "similarity", "end_word")).alias("b"))
    return best.select("doc_id", "item_id", "b.item_words", "b.edits", "b.similarity", "b.end_word")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, max_edits: float = 0.2, repetitions: int = 32, samples: int = 3,
               min_words: int = 8, least_words: int = 4) -> DataFrame:
    """The rows of ``docs`` in which ``find_leaks`` meets no item of ``least_words`` words or more; all columns stay, nothing is shuffled.

    Items of fewer words (a bare "yes") stand in clean documents too and drop none.
    """
    at = docs.columns.index("text")
    docs = docs.withColumn("text", F.col("text").cast("string"))
    for shared in item_blocks(benchmark, max_edits, repetitions, samples, min_words, least_words):

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = pickle.loads(shared.value)
            for b in text_steps(batches, step_bytes=STEP_BYTES):
                keep = [True] * b.num_rows
                for hit in _search(index, pc.fill_null(b.column(at), "").to_pylist()):
                    keep[hit[0]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
