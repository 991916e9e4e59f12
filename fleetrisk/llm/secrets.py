"""Secret scans (operator 9): patterns, plus guess-cost dynamic programming on credential values.

A value that follows a credential word is cut into dictionary words, dates, repeats,
keyboard walks and brute-force spans so that the sum of log10 guesses is least
(the scheme of Wheeler, "zxcvbn", USENIX Security 2016, with additive costs). A value that
costs at least ``min_log10_guesses`` is a secret of kind ``guess``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, text_steps, texts

# The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "guess"]

#: A credential word, a separator and the value whose guess cost counts.
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth|bearer|(?:api|access|private|secret)[_-]?key)["']?"""
                     r"""(?:\x20{0,3}(?::=|=>|[:=])\x20{0,3}|\x20(?:is|was)\x20)["']?([^\s"'<>]{6,})""", re.I | re.A)

# Common words of passwords and placeholders, most common first.
WORDS = """password admin secret token change example test user login welcome default qwerty letmein master
dragon monkey shadow sunshine princess football baseball superman batman trustno hello freedom whatever
love money summer winter spring autumn flower secure private public access server system root guest
demo sample dummy placeholder your here insert value none null true false value key api pass word
the and for you with this that from have name home work life time blue red green black white dog cat
january february march april may june july august september october november december
monday tuesday wednesday thursday friday saturday sunday""".split()
# What prose says of credentials, in the corpora's languages, after the words above.
WORDS += """required invalid expired encrypted generated stored hashed rotated revoked missing incorrect correct changed something
optional unknown protected necessary forgotten hidden removed deleted created provided requis invalide obligatoire incorrect
généré chiffré oublié nécessaire erforderlich ungültig abgelaufen verschlüsselt geschützt vergessen gespeichert notwendig
necesario inválido requerida obligatorio generado cifrado olvidado guardado protegido incorrecto""".split()
RANK = {w: i + 1 for i, w in reversed(list(enumerate(WORDS)))}
LONGEST = 24  # letters of a word
#: Words of the corpus that a scan broadcasts, the most frequent first; they rank after ``WORDS``.
MOST_WORDS, LEAST_DOCS = 50_000, 3
ROWS = ["1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz"]
NEXT = {(a, b) for row in ROWS for line in (row, row[::-1]) for a, b in zip(line, line[1:])}
KEYS = {ch: (x, y) for y, row in enumerate(ROWS[:4]) for x, ch in enumerate(row)}  # each row is half a key to the right of the one above
STEPS = {(1, 0), (-1, 0), (0, 1), (-1, 1), (0, -1), (1, -1)}  # to neighbouring keys
LONGEST_BLOCK = 64  # of a repeat
LEET = str.maketrans("4@310$57", "aaeiosst")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?"
                  r"|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d")
BRUTE_SPAN = 24
_CLASSES = ((str.islower, 26), (str.isupper, 26), (str.isdigit, 10))


class _Repeats:
    """Where blocks of a value follow themselves, found as asked for."""

    def __init__(self, value: str):
        self.value, self.n = value, len(value)
        self.chars = np.frombuffer(value.encode("utf-32-le"), np.uint32)
        self.breaks: dict[int, np.ndarray] = {}

    def run(self, i: int, p: int) -> int:
        """Characters from ``i`` on that equal the one ``p`` later."""
        at = self.breaks.get(p)
        if at is None:
            at = self.breaks[p] = np.append(np.flatnonzero(self.chars[p:] != self.chars[:-p]), max(self.n - p, 0))
        return max(int(at[np.searchsorted(at, i)]) - i, 0) if i < self.n - p else 0

    def block(self, i: int) -> tuple[int, int] | None:
        """(length, copies) of the shortest block of 2 to ``LONGEST_BLOCK`` characters at ``i`` that follows itself."""
        v = self.value
        for p in range(2, min(LONGEST_BLOCK, (self.n - i) // 2) + 1):
            if v[i] == v[i + p] and v[i:i + p] == v[i + p:i + 2 * p]:
                return p, self.run(i, p) // p + 1
        return None


def _walks(low: str, i: int) -> Iterator[tuple[int, int]]:
    """(end, turns) of walks of three keys or more from ``i`` over neighbouring keys, also of other rows."""
    turns, last = 1, None
    for j in range(i, min(len(low) - 1, i + LONGEST)):
        a, b = KEYS.get(low[j]), KEYS.get(low[j + 1])
        move = (b[0] - a[0], b[1] - a[1]) if a and b else None
        if move not in STEPS:
            return
        turns += last is not None and move != last
        last = move
        if j > i:
            yield j + 2, turns


def guess_cost(value: str, rank_of: dict[str, int] = RANK, blocks: bool = True, enough: float = math.inf) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` needs (0 for an empty value); ``rank_of``: ranks of words.

    With ``enough`` only the side of it counts: the result is below ``enough`` just if the cost is, and work ends once that is known, so a
    long value costs little more than its first hundreds of characters. Cuts more than ``LONGEST_BLOCK`` characters inside a run of one
    character are not looked at: one longer run is cheaper than any way through them.
    """
    n = len(value)
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(LEET)
    best = [0.0] + [math.inf] * n
    repeats, costs = _Repeats(value), {}
    i = -1
    while i < n - 1 and (best[n] >= enough or enough == math.inf):
        i += 1
        if best[i] >= enough:  # no use going on from here
            i = next((j for j in range(i + 1, n) if best[j] < enough), n) - 1
            continue
        run_end = i + 1 + repeats.run(i, 1)
        if run_end - i > LONGEST_BLOCK and value[max(0, i - LONGEST_BLOCK - 1):i] == value[i] * (LONGEST_BLOCK + 1):
            continue  # deep inside a run
        base = best[i] + 0.3  # each segment also costs the guess where it ends
        for j in range(i + 3, min(n, i + LONGEST) + 1):
            rank = rank_of.get(low[i:j])
            leet = rank is None
            rank = rank or rank_of.get(plain[i:j])
            if rank:
                cased = value[i:j] != low[i:j]
                best[j] = min(best[j], base + math.log10(rank + 1) + 0.6 * cased + 0.9 * leet)
        if m := DATE.match(value, i):
            best[m.end()] = min(best[m.end()], base + math.log10(365 * 120 if m.end() - i > 4 else 120))
        near, far = min(run_end, i + LONGEST_BLOCK), max(i + 3, run_end - LONGEST_BLOCK)
        for k in chain(range(i + 3, near + 1), range(max(far, near + 1), run_end + 1)):
            best[k] = min(best[k], base + math.log10(95 * (k - i)))
        j = i + 1
        while j < n and j - i < len(ROWS[-1]) and (low[j - 1], low[j]) in NEXT:
            j += 1
            if j - i >= 3:
                best[j] = min(best[j], base + math.log10(47 * 4 * (j - i)))
        for end, turns in _walks(low, i):
            best[end] = min(best[end], base + math.log10(47 * (end - i)) + turns * math.log10(6))
        found = repeats.block(i) if blocks else None
        if found and run_end < i + found[0]:  # not a run of one character
            p, copies = found
            block = value[i:i + p]
            if block not in costs:
                costs[block] = guess_cost(block, rank_of, False)
            best[i + p * copies] = min(best[i + p * copies], base + costs[block] + math.log10(copies))
        seen, size = set(), 0
        for j in range(i, min(n, i + BRUTE_SPAN)):
            kind = next((k for k, (test, _) in enumerate(_CLASSES) if test(value[j])), 3)
            if kind not in seen:
                seen.add(kind)
                size += _CLASSES[kind][1] if kind < 3 else 33
            best[j + 1] = min(best[j + 1], base + (j + 1 - i) * math.log10(size))
    return best[n]


def find_spans(text: str, min_log10_guesses: float, rank_of: dict[str, int] = RANK) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of all findings, by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found += [(m.start(1), 3, m.end(1)) for m in CONTEXT.finditer(text) if guess_cost(m[1].rstrip(".,;:!?)"), rank_of, enough=min_log10_guesses) >= min_log10_guesses]
    return sorted(found)


def rank_words(docs: DataFrame) -> dict[str, int]:
    """``RANK`` and after it the corpus' words of 3 to ``LONGEST`` letters by the number of documents they are in.

    The whole corpus is counted (combined before the shuffle); words of ``LEAST_DOCS`` documents or more count, the first
    ``MOST_WORDS`` are kept. What stands as a credential's value isn't counted, so a secret in many copies doesn't become a word.
    """
    text = F.regexp_replace(F.lower(F.col("text").cast("string")), CONTEXT.pattern, " ")
    words = F.array_distinct(F.split(text, r"[\s,;:!?()\"]+|\.(?=\s|$)"))
    counts = (docs.select(F.explode(words).alias("word")).where(F.col("word").rlike(f"^\\p{{L}}{{3,{LONGEST}}}$"))
              .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_DOCS))
    out = dict(RANK)
    for r in sorted(first_words(stash(counts, "secret-words"), MOST_WORDS).collect(), key=lambda r: (-r.n, r.word)):
        out.setdefault(r.word, len(out) + 1)
    return out


def first_words(counts: DataFrame, most: int, parts: int = 256) -> DataFrame:
    """The ``most`` rows of ``counts`` (word, n) with the largest n, ties by word.

    The n at which the cut falls is found by histograms of ``parts`` intervals, each round inside the interval that holds it; words at the
    cut are laid out in ranges, of which only the one on the cut is sorted. A histogram and a row a range reach the driver.
    """
    lo, hi, above = 0, (counts.agg(F.max("n")).first()[0] or 0) + 1, 0  # words with n >= hi: above, fewer than most
    while hi - lo > 1:
        width = -(-(hi - lo) // parts)
        hist = (counts.where((F.col("n") >= lo) & (F.col("n") < hi)).groupBy(F.floor((F.col("n") - lo) / width).alias("b"))
                .agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("b")).collect())
        for r in hist:
            if above + r.words >= most:
                lo, hi = lo + r.b * width, min(hi, lo + (r.b + 1) * width)
                break
            above += r.words
        else:
            return counts  # all of them
    ties = stash(counts.where(F.col("n") == lo).repartitionByRange("word").withColumn("part", F.spark_partition_id()), "secret-ties")
    left, whole, cut = most - above, -1, None
    for r in sorted(ties.groupBy("part").count().collect()):
        if r["count"] > left:
            cut = r.part
            break
        left, whole = left - r["count"], r.part
    out = counts.where(F.col("n") > lo).unionByName(ties.where(F.col("part") <= whole).drop("part"))
    return out if cut is None else out.unionByName(ties.where(F.col("part") == cut).drop("part").orderBy("word").limit(left))


def scan_secrets(docs: DataFrame, min_log10_guesses: float = 10.0) -> DataFrame:
    """One row per row of ``docs``: doc_id, spans array<struct<kind, start, end>>, code points, end exclusive, by start and kind.

    Kinds ``assign``, ``access`` and ``hex`` are pattern matches (leftmost, non-overlapping per kind);
    ``guess`` is a credential value by its guess cost. Null and empty texts have no spans, repeated
    rows and null ids come back as they are, an empty table gives an empty one; other columns are not read.
    Whole texts are searched, one slice of a batch at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(rank_words(docs))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_of = shared.value
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in text_steps(batches):
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find_spans(t, min_log10_guesses, rank_of)] for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(find, "doc_id long, spans array<struct<kind string, start long, end long>>"))


def redact(docs: DataFrame, mask: str = "[{}]", min_log10_guesses: float = 10.0) -> DataFrame:
    """``docs`` with every span (overlapping ones joined) replaced by its kind in brackets; a column ``n_chars`` follows.

    All rows and columns stay; a null text stays null.
    """
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(rank_words(docs))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_of = shared.value
        for b in text_steps(batches):
            out = []
            for t in b.column("text").to_pylist():
                if t:
                    parts, end = [], 0
                    for s, k, e in find_spans(t, min_log10_guesses, rank_of):
                        if s >= end:
                            parts += (t[end:s], mask.format(KINDS[k]))
                        end = max(end, e)
                    t = "".join(parts) + t[end:] if parts else t
                out.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else c for i, c in enumerate(b.columns)],
                                             names=b.schema.names)

    out = docs.withColumn("text", F.col("text").cast("string")).mapInArrow(clean, docs.withColumn("text", F.col("text").cast("string")).schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length("text").cast(kind))
    return out
