"""Toxicity (operator 5): a convolutional text classifier trained in numpy.

A word is the sum of hashed embeddings of the word and of its first four and five letters;
filters of widths 1, 2 and 3 run over the whole text, ReLU, max pooling over the text, then a logistic layer.
Training goes to a bounded sample of labelled rows on the driver; scoring is an Arrow map
over every whole text. Scaling and thresholds by language come from all labelled rows at their true class rate: a histogram,
counted in Spark, of the logits of rows outside the sample, and the sampled rows' logits of models that weren't trained on them.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import stash, text_steps, texts

DIM, WIDTHS, FILTERS = 8, (1, 2, 3), 6
REACH = max(WIDTHS) - 1  # words that a window holds behind its first
PAD = REACH + 1  # zero words that end a text
HASH_BITS = 22
STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
MEMO = 100_000  # words kept by a task at the start of a step
STEP_BYTES = 1_000_000
FOLDS = 3  # parts of the sample, each scored by a model trained on the others
BINS, TOP = 64, 64  # bins of a logit's unit, largest logit told apart
MOST = 400_000  # words of a text that are convolved at a time
MOST_LANGS = 1000  # languages with thresholds of their own, those with the most toxic labels


def word_features(word: str) -> tuple[int, ...]:
    """Buckets of the word and of its short prefixes."""
    w = word.strip(STRIP).lower()
    if not w:
        return ()
    found = [f"w{w}"] + [f"{k}{w[:k]}" for k in (4, 5) if len(w) >= k]
    return tuple(xxhash.xxh32_intdigest(f.encode()) & ((1 << HASH_BITS) - 1) for f in found)


class _Words(dict):
    """word -> row of ``vectors``; row 0 is the zero vector of words without a trained bucket."""

    def __init__(self, rows: dict[int, int], table: np.ndarray):
        self.rows, self.table = rows, table
        self.reset()

    def reset(self):
        self.clear()
        self.combos, self.vectors = {(): 0}, np.zeros((4096, DIM), np.float32)

    def __missing__(self, word: str) -> int:
        known = tuple(self.rows[f] for f in word_features(word) if f in self.rows)
        at = self.combos.get(known)
        if at is None:
            at = self.combos[known] = len(self.combos)
            if at == len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
            self.vectors[at] = self.table[list(known)].sum(axis=0)
        self[word] = at
        return at


def _pool(x: np.ndarray, starts: np.ndarray, model: dict, want_where: bool = False):
    """Max-pooled filter outputs per text. ``x``: word vectors of all texts, each followed by ``PAD`` zero words; windows start at a
    text's words and at the zero word behind them, so none reads into the next text."""
    pooled, where = [], []
    n = len(x)
    ends = np.append(starts[1:], n) - REACH
    turns = np.stack([starts, ends], axis=1).ravel()
    for w in WIDTHS:
        k = model[f"k{w}"]  # (w, DIM, FILTERS)
        conv = np.tile(model[f"b{w}"], (n, 1)).astype(np.float32)
        for j in range(w):
            conv[: n - j] += x[j:] @ k[j]
        pooled.append(np.maximum.reduceat(conv, turns, axis=0)[::2])
        if want_where:
            where.append(np.stack([conv[s:e].argmax(axis=0) + s for s, e in zip(starts, ends)]))
    out = np.maximum(np.concatenate(pooled, axis=1), 0)
    return (out, where) if want_where else out


def _logits(pooled: np.ndarray, model: dict) -> np.ndarray:
    return pooled @ model["out"] + model["bias"]


def fit(rows: list[tuple[str, int, str]], epochs: int = 14, batch: int = 48, rate: float = 0.04,
        min_texts: int = 3, seed: int = 7) -> dict:
    """Train on (text, 0/1, lang) rows. The result is a plain dict; its ``sample`` has (lang, label, logit) of each row, the
    logit by a model that was not trained on the row. ``calibrate`` adds scaling and thresholds.

    A bucket gets an embedding if it is met in at least ``min_texts`` sampled texts. Without two classes the model scores the base rate.
    """
    rng = np.random.default_rng(seed)
    y = np.array([r[1] for r in rows], dtype=np.float32)
    if not len(rows) or y.min() == y.max():
        return {"constant": float(y.mean()) if len(rows) else 0.0, "sample": []}
    known: dict[str, int] = {}
    docs = []
    for text, _, _ in rows:  # one text's words at a time; only distinct words stay
        docs.append(np.fromiter((known.setdefault(w, len(known)) for w in text.split()), np.int32))
    feats = np.zeros((len(known), 3), np.int64) - 1
    for i, w in enumerate(known):
        fs = word_features(w)
        feats[i, :len(fs)] = fs
    del known
    met = np.zeros(1 << HASH_BITS, np.int32)
    for d in docs:
        met[np.setdiff1d(feats[np.unique(d)], [-1])] += 1
    active = np.flatnonzero(met >= min_texts)
    ids = np.zeros((1 << HASH_BITS) + 1, np.int32)  # the last one is that of no feature
    ids[active] = np.arange(1, len(active) + 1)
    code = ids[feats]  # word -> up to three rows, 0 where none
    empty = np.zeros((PAD, 3), np.int32)
    docs = [np.concatenate([code[d].reshape(-1, 3), empty]) for d in docs]
    del feats, code, met, ids
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)

    def batch_of(pick, table):
        cat = np.concatenate([docs[i] for i in pick])
        starts = np.concatenate([[0], np.cumsum([len(docs[i]) for i in pick])[:-1]])
        return cat, starts, table[cat].sum(axis=1)

    def trained(train):
        table = rng.normal(0, 0.05, (len(active) + 1, DIM)).astype(np.float32)
        table[0] = 0
        model = {f"k{w}": rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        model |= {f"b{w}": np.zeros(FILTERS, np.float32) for w in WIDTHS}
        model |= {"out": rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), "bias": np.float32(0)}
        adam = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in model.items()}
        grown = np.zeros(len(table), np.float32)  # adagrad by embedding row
        step = 0
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(train), max(1, len(train) // batch)):
                cat, starts, x = batch_of(part, table)
                pooled, where = _pool(x, starts, model, True)
                p = 1 / (1 + np.exp(-_logits(pooled, model)))
                delta = (p - y[part]) * weight[part] / len(part)
                grad = {"out": pooled.T @ delta + 1e-4 * model["out"], "bias": delta.sum()}
                back = delta[:, None] * model["out"][None] * (pooled > 0)
                for n_w, w in enumerate(WIDTHS):
                    at, d = where[n_w], back[:, n_w * FILTERS:(n_w + 1) * FILTERS]
                    grad[f"b{w}"] = d.sum(axis=0)
                    grad[f"k{w}"] = np.zeros_like(model[f"k{w}"])
                    for j in range(w):
                        pos = np.minimum(at + j, len(x) - 1)  # (texts, filters)
                        grad[f"k{w}"][j] = np.einsum("tfd,tf->df", x[pos], d)
                        dx = (d[:, :, None] * model[f"k{w}"][j].T[None]).reshape(-1, DIM)
                        for c in range(3):
                            row = cat[pos.ravel(), c]
                            live = (row > 0) & (np.abs(dx).sum(axis=1) > 0)
                            if live.any():
                                r, g = row[live], dx[live]
                                np.add.at(grown, r, (g * g).sum(axis=1))
                                np.add.at(table, r, -rate * 2 * g / (np.sqrt(grown[r]) + 1e-6)[:, None])
                step += 1
                for k, g in grad.items():
                    m, v = adam[k]
                    m[...] = 0.9 * m + 0.1 * g
                    v[...] = 0.999 * v + 0.001 * g * g
                    model[k] = (model[k] - rate * 0.25 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        table[(grown == 0)] = 0  # what no filter ever picked is background
        return model, table

    fold = np.zeros(len(docs), np.int64)
    for one in (0, 1):  # each fold has its share of both classes
        of = rng.permutation(np.flatnonzero(y == one))
        fold[of] = np.arange(len(of)) % FOLDS
    z = np.zeros(len(docs))
    few = min(y.sum(), len(y) - y.sum()) < FOLDS  # some fold would be without a class
    for f in () if few else range(FOLDS):
        part, table = trained(np.flatnonzero(fold != f))
        for c in np.array_split(np.flatnonzero(fold == f), len(docs) // 64 + 1):
            if len(c):
                _, s, x = batch_of(c, table)
                z[c] = _logits(_pool(x, s, part), part)
        del part, table
    model, table = trained(np.arange(len(docs)))
    if few:  # too few to hold any back
        _, s, x = batch_of(np.arange(len(docs)), table)
        z = _logits(_pool(x, s, model), model)
    live = np.flatnonzero(np.abs(table).sum(axis=1))
    return model | {"rows": {int(active[i - 1]): n for n, i in enumerate(live)}, "table": table[live],
                    "sample": [(r[2], r[1], float(v)) for r, v in zip(rows, z)]}


def calibrate(model: dict, counts: list[tuple[str, int, float, int]]) -> dict:
    """``model`` with ``scale``, ``thresholds`` by language and ``usual`` (that of all languages together) from the sample's
    logits and ``counts`` (lang, label, logit, number of rows) of the other labelled rows."""
    if "constant" in model:
        return model | {"thresholds": {}, "usual": 0.3}
    counts = [(*r, 1) for r in model["sample"]] + counts
    langs = np.array([c[0] for c in counts], object)
    zy, z, n = (np.array([c[i] for c in counts], np.float64) for i in (1, 2, 3))
    # Platt scaling with its smoothed targets.
    n1, n0 = (n * zy).sum(), (n * (1 - zy)).sum()
    goal = np.where(zy == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(400):
        q = 1 / (1 + np.exp(-(a * z + b)))
        s = n * np.maximum(q * (1 - q), 1e-9)
        g = np.array([(n * (q - goal) * z).sum() + 0.01 * (a - 1), (n * (q - goal)).sum()])
        h = np.array([[(s * z * z).sum() + 0.01, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        da, db = np.linalg.solve(h, g)
        a, b = a - np.clip(da, -0.2, 0.2), b - np.clip(db, -1, 1)
    a = max(float(a), 0.05)
    score = 1 / (1 + np.exp(-(a * z + b)))
    usual = best_threshold(score, zy, n)
    return model | {"scale": (a, float(b)), "usual": usual,
                    "thresholds": {x: best_threshold(score[langs == x], zy[langs == x], n[langs == x], usual) for x in set(langs) if x is not None}}


def best_threshold(score: np.ndarray, y: np.ndarray, n: np.ndarray, usual: float = 0.3) -> float:
    """Of the thresholds in [0.1, 0.9] with the best F1 (``n`` rows of each score) the one next to ``usual``; ``usual`` with under 5 toxic rows."""
    if (n * y).sum() < 5:
        return usual
    grid = np.linspace(0.1, 0.9, 33)
    hit = score[None] >= grid[:, None]
    f1 = 2 * (n * (hit & (y == 1))).sum(axis=1) / ((n * hit).sum(axis=1) + (n * y).sum())
    good = grid[f1 >= f1.max() - 1e-9]
    return float(good[np.argmin(np.abs(good - usual))])


def labelled(labels: DataFrame, keep=None) -> DataFrame:
    """(doc_id, toxic) of the labels that meet ``keep``, a condition on doc_id. A doc_id with both labels counts as toxic."""
    y = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
         .where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    return y if keep is None else y.where(keep)


def sample_labelled(docs: DataFrame, labels: DataFrame, max_rows: int, keep=None, max_bytes: int = 200_000_000) -> tuple[list[tuple[str, int, str]], list[int]]:
    """At most ``max_rows`` labelled rows with at most ``max_bytes`` of text, at most half of either toxic, by a hash of doc_id; and their doc_ids.

    ``keep``: a condition on doc_id that training rows meet. The bounds hold for the driver; ids are
    chosen first, so only sampled texts move. A row that would leave the bytes is passed over.
    """
    y = labelled(labels, keep)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                    _lang(docs).alias("lang"))
    known = y.join(d.groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("size")), "doc_id").withColumn("at", F.xxhash64("doc_id"))
    ranked = lambda one: known.where(F.col("toxic") == one).orderBy("at", "doc_id").limit(max_rows // 2)
    chosen, left = {}, {0: max_bytes // 2, 1: max_bytes // 2}
    for r in sorted(ranked(1).union(ranked(0)).collect(), key=lambda r: (r["at"], r.doc_id)):
        if r.size <= left[r.toxic]:
            left[r.toxic] -= r.size
            chosen[r.doc_id] = r.toxic
    if not chosen:
        return [], []
    ids = docs.sparkSession.createDataFrame([(i,) for i in chosen], "doc_id long")
    rows = d.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("lang").alias("lang")).orderBy("doc_id").collect()
    return [(r.text, chosen[r.doc_id], r.lang) for r in rows], sorted(chosen)


def with_logits(docs: DataFrame, model: dict, name: str) -> DataFrame:
    """``docs`` with the logit of each whole text in a column ``name``; null texts score as empty ones."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(shared.value)
        words = None if "constant" in m else _Words(m["rows"], m["table"])
        for b in text_steps(batches, step_bytes=STEP_BYTES):
            if words is None:
                value = np.zeros(b.num_rows)
            else:
                if len(words) > MEMO:
                    words.reset()
                value = _score_texts(texts(b), words, m)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(value, pa.float64())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def logit_counts(scored: DataFrame, logit: str, labels: DataFrame, keep, sampled: list[int]) -> list[tuple[str, int, float, int]]:
    """(lang, label, logit, number of rows) of all labelled rows outside the sample, by bins of the logit.

    No text moves: rows of id, language and logit meet the labels. Rows of one doc_id count as one.
    """
    spark = scored.sparkSession
    y = labelled(labels, keep).join(F.broadcast(spark.createDataFrame([(i,) for i in sampled], "doc_id long")), "doc_id", "left_anti")
    rows = (scored.select(F.col("doc_id").cast("long").alias("doc_id"), _lang(scored).alias("lang"), F.col(logit).alias("z")).where("doc_id is not null")
            .groupBy("doc_id").agg(F.min(F.struct("lang", "z")).alias("r")))
    at = F.round(F.greatest(F.lit(-TOP), F.least(F.lit(TOP), F.col("r.z"))) * BINS).cast("int")
    met = rows.join(y, "doc_id").select(F.col("r.lang").alias("lang"), "toxic", at.alias("at"))
    # the languages that come to the driver one by one: those with the most toxic labels; the others are counted together
    most = [r.lang for r in met.groupBy("lang").agg(F.sum("toxic").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()]
    own = F.when(F.col("lang").isin(most), F.col("lang"))
    got = met.groupBy(own.alias("lang"), "toxic", "at").agg(F.count(F.lit(1)).alias("n")).collect()
    return [(r.lang, r.toxic, r["at"] / BINS, r.n) for r in got]


def _lang(docs: DataFrame) -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")


def _score_and_cut(docs: DataFrame, logit: str, model: dict) -> tuple[Column, Column]:
    """Score in 0..1 and threshold as columns."""
    if "constant" in model:
        return F.lit(float(model["constant"])), F.lit(model["usual"])
    a, b = model["scale"]
    cuts = F.create_map(*(F.lit(x) for pair in sorted(model["thresholds"].items()) for x in pair))
    return 1 / (1 + F.exp(-(F.lit(a) * F.col(logit) + F.lit(b)))), F.coalesce(F.try_element_at(cuts, _lang(docs)), F.lit(model["usual"]))


def _scored(docs: DataFrame, read: DataFrame, labels: DataFrame, max_rows: int, keep, name: str) -> tuple[DataFrame, dict]:
    """``read`` (columns of ``docs``) with its logits, written once, and the calibrated model."""
    rows, sampled = sample_labelled(docs, labels, max_rows, keep)
    model = fit(rows)
    scored = with_logits(read, model, name)
    scored = stash(scored.drop("text") if read is not docs else scored, "toxicity-logits")
    return scored, calibrate(model, [] if "constant" in model else logit_counts(scored, name, labels, keep, sampled))


def _score_texts(batch: list[str], words: _Words, m: dict) -> np.ndarray:
    texts_ = [np.append(np.fromiter(map(words.__getitem__, t.split()), np.int32), np.zeros(PAD, np.int32)) for t in batch]
    whole = np.zeros((len(batch), len(WIDTHS) * FILTERS), np.float32)
    group, size = [], 0

    def pool_group():
        starts = np.cumsum([0] + [len(texts_[i]) for i in group[:-1]])
        whole[group] = _pool(words.vectors[np.concatenate([texts_[i] for i in group])], starts, m)

    for i, ids in enumerate(texts_):
        if len(ids) > MOST + REACH:  # piece by piece: windows that start in a piece read on into the next one
            for lo in range(0, len(ids) - REACH, MOST):
                whole[i] = np.maximum(whole[i], _pool(words.vectors[ids[lo:lo + MOST + REACH]], np.array([0]), m)[0])
            continue
        group.append(i)
        size += len(ids)
        if size > MOST:
            pool_group()
            group, size = [], 0
    if group:
        pool_group()
    return _logits(whole, m).astype(np.float64)


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 3000, keep=None) -> DataFrame:
    """``docs`` rows as (doc_id, lang, score, threshold): score in 0..1 of each whole text, threshold by language.

    The filters are trained on a sample of ``labels`` (see ``sample_labelled``: ``max_rows``, and 200 MB of text); scaling and thresholds cover all labelled rows that
    meet ``keep``. Languages with under 5 toxic labels, and those after the first ``MOST_LANGS`` by toxic labels, get
    the threshold of all languages together (0.3 if these have under 5); without a column lang all texts are of one language.
    A text's score doesn't depend on how much of it is convolved at a time.
    Null texts score as empty ones; null ids, repeated rows and empty tables pass through. Only the text enters the score.
    """
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.col("text").cast("string").alias("text"))
    scored, model = _scored(docs, read, labels, max_rows, keep, "logit")
    score, cut = _score_and_cut(scored, "logit", model)
    return scored.select("doc_id", "lang", score.alias("score"), cut.alias("threshold"))


def drop_toxic(docs: DataFrame, labels: DataFrame, max_rows: int = 3000) -> DataFrame:
    """The rows of ``docs`` whose score stays under their language's threshold; all columns stay. The rows are written once with
    their logits, as the thresholds are known only when all labelled rows have theirs; texts aren't shuffled but for the sample."""
    name = "_logit"
    while name in docs.columns:
        name += "_"
    scored, model = _scored(docs, docs, labels, max_rows, None, name)
    score, cut = _score_and_cut(scored, name, model)
    return scored.where(score < cut).select(*docs.columns)
