"""Operators on repeated ids, short items, very long texts and values, colliding columns."""

import math
import random
import string

import numpy as np
import pytest

pytest.importorskip("fleetrisk.llm")

from fleetrisk.llm import chat, common, components, decontam, secrets, sharding, simhash, substrings, toxicity  # noqa: E402

WORDS = ["w%d" % i for i in range(900)]


# 2 decontamination

def test_short_items(spark):
    rng = random.Random(1)
    items = [(n, " ".join(rng.sample(WORDS, n))) for n in range(1, 8)] + [(20, " ".join(rng.sample(WORDS, 20))), (30, "!!!"), (31, None)]
    docs = [(100 + i, " ".join(rng.choices(WORDS[:300], k=30)).upper() + " " + t + ". " + "tail " * 5) for i, t in items[:8]] + [(200, "tail " * 9), (201, items[4][1].rsplit(" ", 1)[0] + " tail")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.edits, r.end_word) for r in decontam.find_leaks(d, b).collect()}
    want = {}
    for i, text in docs:
        words = text.lower().replace(".", "").split()
        for j, item in items[:7]:
            own = item.split()
            ends = [k + len(own) for k in range(len(words)) if words[k:k + len(own)] == own]
            if ends:
                want[i, j] = (0, ends[0])
    assert {k: v for k, v in got.items() if k[1] < 8} == want and got[120, 20][0] == 0
    clean = {r.doc_id for r in decontam.drop_leaks(d, b).collect()}
    assert clean == {i for i, _ in docs} - {i for i, j in got if j >= 4}  # items of under four words drop nothing


# 3 substrings

def brute_substrings(rows, window=13):
    first = {}
    split = [(i, (t or "").split()) for i, t in rows]
    for i, w in split:
        if i is not None:
            for k in range(len(w) - window + 1):
                g = tuple(w[k:k + window])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in split:
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k:k + window])] < i:
                    gone |= set(range(k, k + window))
        out.append((str(i), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def test_substrings_of_repeated_ids(spark, monkeypatch):
    rng = random.Random(2)
    a, b, everywhere = (" ".join(rng.choices(WORDS, k=21)) for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (2, b + " " + a), (None, a), (None, a), (3, None), (3, "")]
    rows += [(i, " ".join(rng.choices(WORDS, k=rng.randrange(0, 60))) + " " + everywhere + " " + " ".join(rng.choices(WORDS[:3], k=40))) for i in range(10, 250)]
    rows += [(7, " ".join(rng.choices(WORDS, k=20)) + " " + everywhere) for _ in range(40)]  # an id of many texts
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, tag long, doc string").repartition(5)
    for most in (substrings.MOST_REPEATED, 1):
        monkeypatch.setattr(substrings, "MOST_REPEATED", most)
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in substrings.dedup_substrings(df).collect()) == brute_substrings(rows)


# 4 simhash

def test_keep_one_of_repeated_ids(spark):
    rng = random.Random(3)
    text = [" ".join(rng.choices(WORDS, k=50)) for _ in range(6)]
    rows = [(1, text[0]), (1, text[1]), (1, text[1]), (2, text[1]), (None, text[1]), (None, text[2]), (None, text[2]), (5, text[3]), (4, text[3]), (6, None), (7, "")]
    df = spark.createDataFrame([(*r, "k", k, "j") for k, r in enumerate(rows)], "doc_id long, text string, _kept string, _0 long, _0r string")
    runs = [sorted(map(str, simhash.keep_one(d).collect())) for d in (df, df.repartition(3), df.orderBy("_0"))]
    assert runs[0] == runs[1] == runs[2] and simhash.keep_one(df).columns == df.columns
    kept = sorted((str(r.doc_id), r.text) for r in simhash.keep_one(df).collect())
    assert kept == sorted([("1", text[0]), ("1", text[1]), ("None", text[2]), ("4", text[3]), ("6", None)], key=str)


def test_join_lookup_splits_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST_HOT", 5)
    rows = spark.createDataFrame([(0 if i < 60 else i, i) for i in range(100)], "k long, v long")
    table = rows.groupBy("k").count().withColumnRenamed("count", "_n").selectExpr("k", "k * 2 AS twice", "_n")
    got = sorted(tuple(r) for r in common.join_lookup(rows, table, "k", 100).collect())
    assert got == sorted(tuple(r) for r in rows.join(table.drop("_n"), "k").collect()) and len(got) == 100


def test_components_of_a_star(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5000) for i in range(1, 2500)] + [(2999, 7499)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {0} and len(got) == 3000 + 2500


# 5 toxicity

def plain_score(text, model):
    """One text, window by window."""
    vec = []
    for w in text.split():
        rows = [model["rows"][f] for f in toxicity.word_features(w) if f in model["rows"]]
        vec.append(model["table"][rows].sum(axis=0) if rows else np.zeros(toxicity.DIM, np.float32))
    n = len(vec)
    vec += [np.zeros(toxicity.DIM, np.float32)] * 3
    pooled = []
    for w in toxicity.WIDTHS:
        best = np.full(toxicity.FILTERS, -np.inf, np.float32)
        for k in range(n + 1):  # windows start at a word or at the end
            out = model[f"b{w}"].copy()
            for j in range(w):
                out = out + vec[k + j] @ model[f"k{w}"][j]
            best = np.maximum(best, out)
        pooled.append(np.maximum(best, 0))
    return float(np.concatenate(pooled) @ model["out"] + model["bias"])


def test_score_does_not_depend_on_pieces(monkeypatch):
    rng = random.Random(4)
    rows = [(" ".join(rng.choices(WORDS[:60], k=25)) + (" vile" if i % 2 else ""), i % 2, "en") for i in range(40)]
    model = toxicity.fit(rows, epochs=2)
    gen = np.random.default_rng(1)
    model["table"] = gen.normal(size=model["table"].shape).astype(np.float32)  # every window counts
    texts = ["", "one", " ".join(rng.choices(WORDS[:60], k=200)), " ".join(rng.choices(WORDS[:60], k=50)), "vile " * 49, " ".join(rng.choices(WORDS[:60], k=101))]
    want = [plain_score(t, model) for t in texts]
    for most in (400_000, 50, 49, 51, 7):
        monkeypatch.setattr(toxicity, "MOST", most)
        got = toxicity._score_texts(texts, toxicity._Words(model["rows"], model["table"]), model)
        assert np.allclose(got, want, atol=1e-4), most


def test_toxicity_without_lang(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(WORDS, k=15)) + (" vile" if i % 3 == 0 else "")) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    y = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(d, y, max_rows=200).collect()}
    assert sum((got[i].score >= got[i].threshold) == (i % 3 == 0) for i in got) > 285
    assert 180 < toxicity.drop_toxic(d, y, max_rows=200).count() < 220
    sample, ids = toxicity.sample_labelled(d, y, 200, max_bytes=4000)
    assert 0 < sum(len(t) for t, _, _ in sample) <= 4000 and len(sample) == len(ids) < 200


def test_many_languages(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_LANGS", 2)
    scored = spark.createDataFrame([(i, f"l{i % 5}", float(i % 3)) for i in range(60)], "doc_id long, lang string, z double")
    y = spark.createDataFrame([(i, int(i % 5 < 2)) for i in range(60)], "doc_id long, toxic int")
    counts = toxicity.logit_counts(scored, "z", y, None, [0, 1])
    assert {c[0] for c in counts} == {"l0", "l1", None} and sum(c[3] for c in counts) == 58


# 9 secrets

def all_segmentations(value, rank_of):
    """The least cost over every way to cut the value, each piece as the cheapest thing that it is on its own."""
    low, n = value.lower(), len(value)

    def piece(i, j, blocks=True):
        s, t, k = value[i:j], low[i:j], j - i
        costs = []
        if k <= secrets.BRUTE_SPAN:
            size = sum(c for have, c in ((any(x.islower() for x in s), 26), (any(x.isupper() for x in s), 26), (any(x.isdigit() for x in s), 10),
                                         (any(not (x.islower() or x.isupper() or x.isdigit()) for x in s), 33)) if have)
            costs.append(k * math.log10(size))
        if 3 <= k <= secrets.LONGEST:
            leet = t.translate(secrets.LEET)
            if t in rank_of:
                costs.append(math.log10(rank_of[t] + 1) + 0.6 * (s != t))
            elif leet in rank_of:
                costs.append(math.log10(rank_of[leet] + 1) + 0.6 * (s != t) + 0.9)
            if all(p in secrets.NEXT for p in zip(t, t[1:])) and k <= 26:
                costs.append(math.log10(47 * 4 * k))
            at = [secrets.KEYS.get(c) for c in t]
            if all(at):
                moves = [(b[0] - a[0], b[1] - a[1]) for a, b in zip(at, at[1:])]
                if all(m in secrets.STEPS for m in moves):
                    costs.append(math.log10(47 * k) + (1 + sum(a != b for a, b in zip(moves, moves[1:]))) * math.log10(6))
            if len(set(s)) == 1:
                costs.append(math.log10(95 * k))
        if (m := secrets.DATE.match(value, i)) and m.end() == j:
            costs.append(math.log10(365 * 120 if k > 4 else 120))
        if blocks:  # the shortest block that follows itself, as often as it does
            for p in range(2, min(secrets.LONGEST_BLOCK, (n - i) // 2) + 1):
                if value[i:i + p] == value[i + p:i + 2 * p]:
                    copies = 2
                    while value[i + p * copies:i + p * (copies + 1)] == value[i:i + p]:
                        copies += 1
                    if p * copies == k and len(set(value[i:i + p])) > 1:
                        costs.append(whole(i, i + p, False) + math.log10(copies))
                    break
        return min(costs, default=math.inf)

    def whole(i, j, blocks=True):
        best = math.inf
        for cuts in range(1 << (j - i - 1)):
            ends = [k for k in range(i + 1, j) if cuts >> (k - i - 1) & 1] + [j]
            best = min(best, sum(0.3 + known(a, b, blocks) for a, b in zip([i, *ends], ends)))
        return best

    memo = {}

    def known(a, b, blocks):
        if (a, b, blocks) not in memo:
            memo[a, b, blocks] = piece(a, b, blocks)
        return memo[a, b, blocks]
    return whole(0, n)


def test_guess_cost_is_the_least_over_all_segmentations():
    rng = random.Random(6)
    rank_of = dict(secrets.RANK) | {"horse": 400, "aaa": 500, "aab": 600}
    bits = ["a", "b", "aa", "abab", "qwe", "sde", "1", "12", "1999", "31012020", "pass", "P4ss", "horse", "H0rse", "Z", "-", "é", "$"]
    for _ in range(250):
        v = "".join(rng.choices(bits, k=rng.randrange(1, 6)))[:11]
        want = all_segmentations(v, rank_of)
        assert secrets.guess_cost(v, rank_of) == pytest.approx(want), v
        for enough in (4.0, 8.0, 10.0):
            assert (secrets.guess_cost(v, rank_of, enough=enough) >= enough) == (want >= enough - 1e-12), v


def test_long_values():
    rng = random.Random(7)
    random_value = "".join(rng.choices(string.ascii_letters + string.digits, k=400_000))
    for value, secret in ((random_value, True), ("a" * 400_000, False), ("ab" * 200_000, False), ("ab" * 200_000 + "x9$Kz!tQ", True), ("a" * 300_000 + "password", False),
                          (("horse" + "1" * 90) * 4000, True), ("qwerty" * 50_000, False)):
        assert (secrets.guess_cost(value, enough=10.0) >= 10) == secret
    assert secrets.guess_cost("b" * 200 + "aaaardvark9") == pytest.approx(secrets.guess_cost("b" * 150 + "aaaardvark9") + math.log10(200 / 150))


@pytest.mark.parametrize("most", [0, 1, 7, 60, 199, 200, 500])
def test_first_words(spark, most):
    rng = random.Random(8)
    rows = [(f"w{i}", rng.choice([3, 3, 3, 4, 5, 900, 10 ** 6 + i])) for i in range(200)]
    df = spark.createDataFrame(rows, "word string, n long").repartition(3)
    got = {(r.word, r.n) for r in secrets.first_words(df, most, parts=4).collect()}
    assert got == set(sorted(rows, key=lambda r: (-r[1], r[0]))[:most])


# 1 and 10

def test_rows_without_conversation(spark):
    rows = [(None, 0, "user", "a")] * 3 + [(None, 1, "assistant", "b"), (4, 0, "user", "c"), (4, 1, "assistant", "d")]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((str(r.conv_id), len(chat.parse(r.formatted))) for r in got) == [("4", 2)] + [("None", 1)] * 4


def test_shards_beside_a_column_of_that_name(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * 100, i, "o") for i in range(50)] + [(None, None, 1, "o")], "doc_id long, text string, shard long, Shard_ string")
    sharding.write_shards(df, 1000, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    assert set(back.columns) == {*df.columns, "shard__"}


# 7 embeddings

@pytest.mark.parametrize("n, size", [(900, 64), (3000, 24)])
def test_embedding_recall_and_pruning(spark, n, size):
    """Planted pairs just above the bound: recall against brute force, and how few pairs are looked at."""
    from fleetrisk.llm import embed_dedup
    gen = np.random.default_rng(n)
    base = gen.normal(size=(n, size))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    c = gen.uniform(0.93, 0.96, n // 3)[:, None]
    side = gen.normal(size=(n // 3, size))
    side -= (side * base[:n // 3]).sum(axis=1, keepdims=True) * base[:n // 3]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    x = np.concatenate([base, c * base[:n // 3] + np.sqrt(1 - c * c) * side]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    unit = embed_dedup.unit(x)
    want = ((unit @ unit.T >= 0.93).sum(axis=1) - 1).sum()
    got = sum(r.n_links for r in embed_dedup.link_vectors(df).collect())
    assert 0.97 * want <= got <= want
    m = embed_dedup.pivot_count(len(x))
    near = np.argpartition(-(unit @ unit[gen.choice(len(x), m, replace=False)].T), 7, axis=1)[:, :8]
    has = np.zeros((len(x), m), np.float32)
    np.put_along_axis(has, near, 1, axis=1)
    both = has @ has.T
    assert ((both >= 3).sum() - len(x)) < 0.35 * ((both >= 1).sum() - len(x))  # the count prunes what one shared pivot let through


# 6 licenses

def containment(text, template):
    import re

    def shingles(t):
        w = [x for x in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower()) if x]
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    own = shingles(template)
    return len(own & shingles(text)) / len(own)


def test_license_copies_in_whole_documents(spark):
    """Changed words, a line put in the middle, surrounding text: what holds 0.8 of a template over the whole document is met."""
    from fleetrisk.llm import licenses
    rng = random.Random(10)
    prose = lambda n: " ".join(rng.choices(WORDS, k=n))
    rows, want = [], set()
    for k, (name, text) in enumerate(sorted(licenses.TEMPLATES.items())):
        words = text.split()
        for j, made in enumerate((words, ["*"] + words, words[:len(words) // 2] + ["another"] + words[len(words) // 2 + 1:],
                                  words[:len(words) // 2] + ("Copyright (c) 1999 to 2024 " + prose(15)).split() + words[len(words) // 2:])):
            doc = prose(30) + " " + " ".join(made) + " " + prose(30)
            rows.append((10 * k + j, doc))
            size = len(licenses.TEMPLATES[name].split())
            if containment(doc, text) >= 0.8 and (j < 3 or size >= 45):
                want.add((10 * k + j, name))
    got = {(r.doc_id, r.license_id) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert want <= got and len(want) > 2.5 * len(licenses.TEMPLATES)
    text = dict(rows)
    assert all(containment(text[i], licenses.TEMPLATES[name]) >= 0.8 for i, name in got)
    clean = spark.createDataFrame([(i, prose(200) + " the license of this software is free") for i in range(20)], "doc_id long, text string")
    assert licenses.scan_licenses(clean).count() == 0


# memory of the pipeline's tasks

def test_python_gets_bounded_batches(spark):
    import pyarrow as pa
    common.prepare(spark)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "size"])

    docs = spark.range(2000, numPartitions=1).selectExpr("id as doc_id", "repeat('word ', 2000) as text")  # 20 MB
    got = docs.mapInArrow(sizes, "rows long, size long").collect()
    assert sum(r.rows for r in got) == 2000
    assert max(r.size for r in got) <= common.BATCH_BYTES + 100_000


def test_a_bound_of_the_session_stays(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, 1_000_000)
    try:
        common.prepare(spark)
        assert spark.conf.get(key) == "1000000"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_packing_encodes_small_steps(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    from fleetrisk.llm import packing
    monkeypatch.setattr(packing, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": staticmethod(lambda: 0)}))}))
    seen = []

    class Ids:
        def encode(self, batch):
            seen.append(sum(map(len, batch)))
            return np.zeros(len(batch), np.uint32), np.ones(len(batch), np.int64)

    monkeypatch.setitem(packing._LOADED, ("none", 1), Ids())
    run = []
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: run.append(f) or self)
    packing.tokenise(docs, "none", 1)
    rows = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(["x" * 100_000] * 40)], names=["doc_id", "text"])
    out = list(run[0](iter([rows])))
    assert sum(seen) == 4_000_000 and max(seen) <= 1_000_000
    assert [r for b in out for r in b.column("place").to_pylist()] == list(range(40))
