"""Packing (operator 8): concatenate and cut.

Pass one tokenises once and writes the ids with each document's place in its partition's stream; the
partitions' token totals get prefix sums; pass two turns places into global offsets and cuts at fixed window bounds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import stash, text_steps, texts

MEMO = 300_000
STEP_BYTES = 1_000_000  # text encoded at a time: its runs become strings, many times its size
#: Characters around which nothing of a special token, a contraction or a composed character can stand:
#: white space, ASCII letters, digits and marks but for ' < > ` | and backslash, and Latin-1 letters.
_MARKS = r"!\"#$%&()*+,\-./:;=?@\[\]^_{}~"
_LETTERS = r"a-z\u00DF-\u00F6\u00F8-\u00FF"
PLAIN = re.compile(rf"[\t\n\r 0-9{_MARKS}{_LETTERS}A-Z\u00C0-\u00D6\u00D8-\u00DE]*")
WORD = re.compile(r"[^\t\n\r ]+")
RUNS = re.compile(rf"[{_LETTERS}]+|[0-9]|[{_MARKS}]+")
#: Byte-level BPE shows a byte as a printable character: its own where it has one, else the next after 255.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class WordIds:
    """Token ids of whole texts, by way of the ids of their words.

    The tokenizer lower-cases, drops white space and cuts a text into runs of letters, single digits and runs of marks,
    each encoded by itself. A text of plain characters is cut the same way here and its runs go to the tokenizer's model;
    in any other text each white-space word with other characters goes through the whole tokenizer. Runs are met again and again, so their
    ids are kept (up to ``MEMO`` runs; later ones are encoded each time).
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.end_id = end_id
        self.memo: dict[str, int] = {}
        self.flat = np.zeros(1 << 20, np.uint32)
        self.bounds = np.zeros(1 << 16, np.int64)
        self.words = self.used = self.kept = 0
        self.late: list[str] = []

    def units(self, text: str) -> list[str]:
        """Runs of a plain text; else words, where those that aren't plain stay whole."""
        if PLAIN.fullmatch(text):
            return RUNS.findall(text.lower())
        return list(chain.from_iterable(RUNS.findall(w.lower()) if PLAIN.fullmatch(w) else (w,) for w in WORD.findall(text)))

    def _learn(self, new: list[str]) -> None:
        model, parts = self.model.tokenize, []
        for w in new:
            if RUNS.fullmatch(w):
                parts.append([t.id for t in model(w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_CHARS))])
            else:
                parts.append(self.tok.encode(w, add_special_tokens=False).ids)
        add = np.fromiter(chain.from_iterable(parts), np.uint32)
        while self.used + len(add) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.words + len(parts) + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        self.flat[self.used:self.used + len(add)] = add
        self.bounds[self.words + 1:self.words + len(parts) + 1] = self.used + np.cumsum([len(p) for p in parts])
        self.memo.update(zip(new, range(self.words, self.words + len(new))))
        self.words += len(new)
        self.used += len(add)

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end_id``, and the number of ids of each text."""
        if self.words > MEMO:  # the early runs, which hold the frequent ones, stay; the last step's go
            for w in self.late:
                del self.memo[w]
            self.words, self.used = self.kept, int(self.bounds[self.kept])
        docs = [self.units(t) for t in batch]
        counts = np.array([len(d) for d in docs], np.int64)
        runs = list(chain.from_iterable(docs))
        at = np.fromiter(map(self.memo.get, runs, repeat(-1)), np.int64, len(runs))
        new: list[str] = []
        if len(unknown := np.flatnonzero(at < 0)):
            missed = [runs[i] for i in unknown.tolist()]
            new = list(dict.fromkeys(missed))
            self._learn(new)
            at[unknown] = np.fromiter(map(self.memo.__getitem__, missed), np.int64, len(missed))
        if self.words <= MEMO:
            self.kept = self.words
        else:
            self.late = new
        lo = self.bounds[at]
        size = self.bounds[at + 1] - lo
        ends = np.cumsum(size)
        n = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]) + 1  # with the end id
        ids = np.empty(int(n.sum()), np.uint32)
        stop = np.cumsum(n) - 1
        where = np.ones(len(ids), bool)
        where[stop] = False
        ids[where] = self.flat[np.arange(int(size.sum())) + np.repeat(lo - ends + size, size)]
        ids[stop] = self.end_id
        return ids, n


_LOADED: dict[tuple[str, int], WordIds] = {}


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """doc_id, part, place, n, ids: a document's ids (little-endian uint32) and its place in its partition's stream."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (tokenizer_path, end_id)
        enc = _LOADED[key] if key in _LOADED else _LOADED.setdefault(key, WordIds(*key))
        part, place = TaskContext.get().partitionId(), 0
        for b in text_steps(batches, step_bytes=STEP_BYTES):
            ids, n = enc.encode(texts(b))
            ends = np.cumsum(n)
            raw = ids.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.full(b.num_rows, part, np.int32)), pa.array(place + ends - n), pa.array(n),
                 pa.array([raw[4 * (e - k):4 * e] for e, k in zip(ends.tolist(), n.tolist())], pa.binary())],
                names=["doc_id", "part", "place", "n", "ids"])
            place += int(ends[-1]) if len(ends) else 0

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, part int, place long, n long, ids binary"))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, window: int = 2048) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian uint32), doc_tokens, sequence_id, offset.

    The stream is all documents, each followed by ``end_id``, partition after partition; sequence s holds its
    ids from s * window on, so only the last sequence can be short. A null or empty text is its end id alone; null doc_ids and repeated rows
    are packed like any other row; an empty table gives no pieces. Other columns are not read.
    Work and memory follow one slice of texts; only the partitions' totals (one row a partition) are summed up in one place.
    """
    ids = stash(tokenise(docs, tokenizer_path, end_id), "ids")
    totals = ids.groupBy("part").agg(F.sum("n").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("base"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        for b in text_steps(batches, "ids"):
            at, n = (b.column(c).to_numpy() for c in ("at", "n"))
            first, last = at // window, (at + n - 1) // window
            pieces = last - first + 1
            doc = np.repeat(np.arange(b.num_rows), pieces)
            seq = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces) + first[doc]
            begin = np.maximum(at[doc], seq * window)
            size = np.minimum((at + n)[doc], (seq + 1) * window) - begin
            start = begin - at[doc]
            raw = b.column("ids").to_pylist()
            body = [raw[d][4 * s:4 * (s + k)] for d, s, k in zip(doc.tolist(), start.tolist(), size.tolist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(size), pa.array(body, pa.binary()),
                                              pa.array(n[doc]), pa.array(seq), pa.array(begin - seq * window)], names=names)

    # ``before`` has one row per partition of the written table, a bound that doesn't grow with its rows.
    placed = ids.join(F.broadcast(before), "part").select("doc_id", (F.col("base") + F.col("place")).alias("at"), "n", "ids")
    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def with_crc(pieces: DataFrame) -> DataFrame:
    """The pieces with ``ids_crc32`` in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
