"""Substring dedup: the rows of one very common symbol."""

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("fleetrisk.llm")

from fleetrisk.llm import substrings  # noqa: E402

WINDOW = 13


def _rows(seed, n_rows, names, keys):
    """Rows (key, doc, tag, first, names or None if settled), sorted by key and doc; ``names`` different windows."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n_rows):
        settled = rng.random() < 0.05
        out.append((int(rng.choice(keys)), int(rng.integers(0, n_rows // 2)), int(rng.integers(0, 2)), 100 * i,
                    int(rng.integers(1, 9)) if settled else [int(x) for x in rng.integers(0, names, rng.integers(1, 9))], settled))
    return sorted(out, key=lambda r: r[:2])


def _batches(rows, size):
    for lo in range(0, len(rows), size):
        key, doc, tag, first, names, settled = zip(*rows[lo:lo + size])
        count = [x if s else len(x) for x, s in zip(names, settled)]
        blobs = [None if s else b"".join(v.to_bytes(substrings.CHECK, "little") for v in x) for x, s in zip(names, settled)]
        place = [(f << substrings.COUNT_BITS) | n for f, n in zip(first, count)]
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (key, doc, tag, place)), pa.array(blobs, pa.binary())],
                                         names=["key", "doc", "tag", "place", "checks"])


def _covered(batches):
    got = set()
    for b in batches:
        for doc, tag, lo, hi in zip(*(b.column(c).to_pylist() for c in ("doc", "tag", "lo", "hi"))):
            got |= {(doc, tag, w) for w in range(lo, hi)}
    return got


def _brute(rows):
    least, got = {}, set()
    for key, doc, _, _, names, settled in rows:
        for x in () if settled else names:
            least[key, x] = min(doc, least.get((key, x), doc))
    for key, doc, tag, first, names, settled in rows:
        for i, x in enumerate(range(names) if settled else names):
            if settled or least[key, x] < doc:
                got |= {(doc, tag, w) for w in range(first + i, first + i + WINDOW)}
    return got


@pytest.mark.parametrize("step, most", [(400_000, 1_000_000), (50, 1_000_000), (50, 60), (1, 0), (700, 200)])
def test_spans_of_large_keys(monkeypatch, step, most):
    monkeypatch.setattr(substrings, "STEP_WINDOWS", step, raising=False)
    monkeypatch.setattr(substrings, "MOST_CARRIED", most, raising=False)
    for seed, keys in enumerate(([7], [-3, 2], [1, 2, 3, 4, 4, 4, 4], [*range(60)])):
        rows = _rows(seed, 600, 900, keys)
        for size in (13, 600):
            assert _covered(substrings.repeated_spans(_batches(rows, size), WINDOW)) == _brute(rows), (keys, size)
    assert list(substrings.repeated_spans(_batches([], 5), WINDOW)) == []


def test_a_common_key_is_not_sorted_again_with_every_batch(monkeypatch):
    """60 batches of one key whose windows all differ: before, each batch was sorted with all names before it, 30 times the windows in all."""
    n, each, sorted_names = 60, 10_000, []
    lexsort = np.lexsort

    def counting(keys, *more):
        sorted_names.append(len(keys[0]))
        return lexsort(keys, *more)

    def batches():
        for i in range(n):
            names = np.arange(i * each, (i + 1) * each, dtype=np.int64).view(np.uint8).reshape(-1, 8)[:, :substrings.CHECK]
            blobs = names.reshape(each // 5, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(blobs), 5)), pa.array(np.arange(len(blobs)) + i * len(blobs)), pa.array(np.zeros(len(blobs), np.int64)),
                 pa.array(np.full(len(blobs), 5)), pa.array([b.tobytes() for b in blobs], pa.binary())], names=["key", "doc", "tag", "place", "checks"])
    monkeypatch.setattr(np, "lexsort", counting)
    assert sum(b.num_rows for b in substrings.repeated_spans(batches(), WINDOW)) == 0
    assert sum(sorted_names) <= 3 * n * each
