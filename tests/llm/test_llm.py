"""Each operator against brute force, and its results on nulls, empty and long texts, repeats, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

pytest.importorskip("fleetrisk.llm")

import __spark_entry__ as E  # noqa: E402
from fleetrisk.llm import chat, components, decontam, embed_dedup, licenses, packing, secrets, sharding, simhash, substrings, toxicity  # noqa: E402
from fleetrisk.llm.queries import tokenizer_file  # noqa: E402
from oracle import compare, duck  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, sf=SF):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, empty, blank and very long texts, repeated rows, columns whose names operators use themselves."""
    rng = random.Random(3)
    vocab = ["w%d" % i for i in range(400)]
    long = " ".join(rng.choices(vocab, k=30_000)) + " " + "x" * 50_000
    rows = [(1, "a b c", "en"), (1, "a b c", "en"), (1, "other text here", None), (2, None, "en"), (3, "", "de"), (4, " \n\t ", "en"),
            (None, "a b c", "en"), (None, None, None), (5, long, "en"), (6, long, "fr"), (7, "é 日本 ß", "xx"), (8, "\\" * 30_000, "en")]
    return spark.createDataFrame([(i, t, lang, "s", 1, 2, 3, "4", 5, 6, 7) for i, t, lang in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, fp long, key long, raw string, component_id long, score long, prefix long")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


# 1 chat

def test_chat_escape_round_trip():
    rng = random.Random(1)
    bits = chat.CONTROLS + ["\\", "\\\\", "a", "<", "[", "]", "/INST]", "\n", "é"]
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", "<|text|>", "x\\"]), "".join(rng.choices(bits, k=rng.randrange(7)))) for _ in range(rng.randrange(5))]
        text, mask, _ = chat.round_trip(turns)
        assert chat.parse(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]


def test_chat_cases(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (None, 0, "user", "n"), (2, None, "user", "first"), (2, 0, "user", "\\" * 40_000)]
    c = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.format_chats(c).collect()}
    assert chat.parse(got[1].formatted) == [("user", ""), ("", "x"), ("assistant", "a"), ("assistant", "b")]
    assert chat.parse(got[2].formatted) == [("user", "first"), ("user", "\\" * 40_000)] and len(got) == 3
    assert chat.chat_digests(chat.format_chats(c.limit(0))).collect() == []


# 2 decontamination

def _edit(item, doc):
    row = [0] * (len(doc) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(doc, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (w != x)))
        row = new
    return min(row)


def test_decontam_against_brute_force(spark):
    docs = dict(list(docs_of(spark).items())[:60])
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    rng = random.Random(2)
    for k, (i, t) in enumerate(list(items.items())[:20]):  # near copies at up to 15 % of words changed
        w = t.split()
        for _ in range(int(len(w) * 0.15)):
            w[rng.randrange(len(w))] = "zq%d" % rng.randrange(999)
        docs[10_000 + k] = "Start here. " + " ".join(w) + " and the end"
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontam.find_leaks(d, b).collect()}
    want = {}
    for di, t in docs.items():
        words = decontam.words_of(t)
        for ii, s in items.items():
            item = decontam.words_of(s)
            if len(item) >= 8 and len(set(item) & set(words)) > 0.5 * len(set(item)) and (e := _edit(item, words)) <= int(0.2 * len(item)):
                want[di, ii] = e
    assert set(got) <= set(want) and all(got[k] >= want[k] for k in got)
    assert len(got) >= 0.95 * len(want) and len(want) >= 20
    assert {k for k, e in want.items() if e == 0} <= set(got)


def test_decontam_cases(spark, odd, none):
    b = spark.createDataFrame([(1, None), (None, "x " * 20), (2, "too short"), (3, " ".join("w%d" % i for i in range(20)))], "item_id long, text string")
    assert decontam.find_leaks(odd, b).collect() == [] and decontam.find_leaks(none, b).collect() == []
    assert decontam.find_leaks(odd, b.limit(0)).collect() == []
    assert decontam.drop_leaks(odd, b).count() == odd.count()


def test_decontam_edits_in_one_place():
    """Copies whose whole edit limit is spent on the head, the tail or the middle; every item length from 15 words to 59."""
    rng = random.Random(12)
    items = [(i, [b"w%dx%d" % (i, k) for k in range(n)]) for i, n in enumerate([15] * 5 + [30] * 25 + [45] * 25 + [59] * 25)]
    index = decontam.Index(items, 0.2, 32, 3)
    for edit in (lambda w, k: w[k:], lambda w, k: [b"new%d" % rng.randrange(10**9) for _ in range(k)] + w[k:], lambda w, k: w[:-k],
                 lambda w, k: w[:len(w) // 2] + [b"new%d" % rng.randrange(10**9) for _ in range(k)] + w[len(w) // 2:]):
        texts = [b" ".join([b"before"] * 20 + edit(w, int(0.2 * len(w))) + [b"after"] * 20).decode() for _, w in items]
        met = {(d, i) for d, i, _, _ in decontam._search(index, texts)}
        assert all(d == i for d, i in met) and len(met) >= 0.95 * len(items)


# 3 substrings

def _substrings(docs, n=13):
    first = {}
    for i in sorted(docs):
        w = WORD.findall(docs[i] or "")
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k:k + n]), i)
    out = {}
    for i, t in docs.items():
        w = WORD.findall(t or "")
        gone = {k + j for k in range(len(w) - n + 1) if first[tuple(w[k:k + n])] < i for j in range(n)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out[i] = (len(w), len(gone), " ".join(kept))
    return out


def test_substrings_against_brute_force(spark):
    rng = random.Random(5)
    vocab = ["a", "b", "c", "dd", "e f", "g"]
    base = [rng.choices(vocab, k=60) for _ in range(6)]
    docs = {}
    for i in range(120):
        w = []
        for _ in range(rng.randrange(5)):
            s = rng.choice(base)
            lo = rng.randrange(50)
            w += s[lo:lo + rng.randrange(25)] + rng.choices(vocab, k=rng.randrange(6)) + ["a"] * rng.randrange(20)
        docs[i] = rng.choice([" ", "\n", "  "]).join(w)
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.dedup_substrings(d).collect()}
    assert got == _substrings(docs)


def test_substrings_cases(odd, none):
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substrings.dedup_substrings(odd).collect()), key=str)
    assert len(got) == odd.count() and (6, 30_001, 30_001) in got and (5, 30_001, 0) in got and (None, 3, 0) in got and (2, 0, 0) in got
    assert substrings.dedup_substrings(none).collect() == []


# 4 simhash

def _simhash(text, n=4):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(nodes, linked):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize("blocks", [None, 5, 8])
def test_simhash_against_brute_force(spark, blocks):
    docs = docs_of(spark)
    fp = {i: _simhash(t) for i, t in docs.items()}
    comp = _components(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_groups(spark.read.parquet(f"{SF}/documents.parquet"), blocks=blocks).collect()}
    assert got == {i: (f"{fp[i]:016x}", comp[i]) for i in fp}


def test_simhash_links_dense_groups_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 8)
    rng = random.Random(9)
    fps = {(1 << 40) ^ (1 << rng.randrange(40)) ^ (1 << rng.randrange(40)) for _ in range(150)} | {rng.getrandbits(63) for _ in range(100)}
    got = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    assert all((r.a ^ r.b).bit_count() <= 4 for r in got)
    want = _components(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4])
    assert _components(fps, [(r.a, r.b) for r in got]) == want


def test_simhash_cases(odd, none):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_groups(odd).collect()]
    assert len(got) == odd.count() and simhash.near_groups(none).collect() == []
    assert {c for i, f, c in got if f == "0" * 16} == {2} and {c for i, _, c in got if i in (5, 6)} == {5}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "1", "2", "5", "7", "8"])  # rows without an id stand behind those with one; of one id two texts that aren't near stay


def test_components_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 500), (7, 7), (None, 3), (900, 901)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 400: 400, 500: 400, 900: 900, 901: 900}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


# 5 toxicity

def test_toxicity_held_out(spark):
    rng = random.Random(4)
    words = ["k%d" % i for i in range(800)]
    rows = []
    for i in range(900):
        w = rng.choices(words, k=rng.randrange(5, 200))
        if i % 5 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(["nasty", "foulish", "foulness"]))
        rows.append((i, " ".join(w), "en" if i % 2 else "de", int(i % 5 == 0)))
    d = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    y = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(d, y, keep="doc_id % 4 <> 2").collect()}
    held = [i for i in got if i % 4 == 2]
    assert len(got) == 900 and np.mean([(got[i].score >= got[i].threshold) == (i % 5 == 0) for i in held]) >= 0.97


def test_toxicity_cases(spark, odd, none):
    y = spark.createDataFrame([(1, 1), (5, 0), (5, 0), (None, 1), (77, 1), (6, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(odd, y).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(none, y).collect() == [] and toxicity.toxicity(odd, y.limit(0)).count() == odd.count()
    assert toxicity.drop_toxic(odd, y.limit(0)).columns == odd.columns


def test_toxicity_calibrated_on_all_labels(spark):
    """Many more labels than the sample holds, 10 % toxic, one language rare: the scaling follows the true class rate, no toxic label is left out."""
    rng = random.Random(14)
    words = ["k%d" % i for i in range(300)]
    rows = []
    for i in range(3000):
        toxic = i % 10 == 0
        w = rng.choices(words, k=20) + (["nasty"] if toxic != (rng.random() < 0.08) else [])  # noisy labels
        rows.append((i, " ".join(w), "de" if i % 40 == 0 else "en" if i % 2 else "fr", int(toxic)))
    d = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    y = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    sample, ids = toxicity.sample_labelled(d, y, 200)
    model = toxicity.fit(sample)
    counts = toxicity.logit_counts(toxicity.with_logits(d, model, "logit"), "logit", y, None, ids)
    assert len(sample) == len(ids) == 200 and sum(c[3] for c in counts) == 2800 and sum(c[1] * c[3] for c in counts) == 200
    got = toxicity.toxicity(d, y, max_rows=200).collect()
    assert abs(np.mean([r.score for r in got]) - 0.1) < 0.02  # half of the sample is toxic, a tenth of the labels
    score = {r.doc_id: r for r in got}
    for lang in ("de", "fr"):
        own = [r for r in rows if r[2] == lang]
        f1 = lambda cut: 2 * sum(score[i].score >= cut and t for i, _, _, t in own) / max(1, sum(score[i].score >= cut for i, *_ in own) + sum(r[3] for r in own))  # noqa: E731, B023
        assert f1(score[own[0][0]].threshold) >= max(f1(c) for c in np.linspace(0.1, 0.9, 33)) - 0.03


# 6 licenses, 10 sharding: SQL twins

@pytest.mark.parametrize("name", ["op1_chat_formatting", "op3_substring_dedup", "op6_license_scan", "op10_sharding"])
def test_against_sql(spark, name):
    res = compare(E.queries()[name](spark, SF), duck(SF), E.oracle_sql()[name])
    assert res["values_match"], res


def test_license_cases(spark, odd, none):
    assert licenses.scan_licenses(odd).collect() == [] and licenses.scan_licenses(none).collect() == [] and licenses.scan_licenses(odd, {}).collect() == []
    text = licenses.TEMPLATES["GPL-header"].replace("warranty", "x")
    d = spark.createDataFrame([(1, "zz " * 40 + text + " tail"), (None, text), (3, text.upper()), (3, text)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.containment) for r in licenses.scan_licenses(d).where("license_id = 'GPL-header'").collect()), key=str)
    assert got == [(1, 1.0), (3, 1.0), (None, 1.0)]
    with pytest.raises(ValueError):
        licenses.scan_licenses(d, {"tiny": "too few words"})


def test_native_plans(spark, odd):
    for df in (licenses.scan_licenses(odd), sharding.assign_shards(odd, 1000)):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())


@pytest.mark.parametrize("limit", [2_000, 50_000])
def test_shards_fit(spark, limit):
    res = compare(sharding.assign_shards(spark.read.parquet(f"{SF}/documents.parquet"), limit), duck(SF), sharding.shard_sql(limit))
    assert res["values_match"], res


def test_shard_cases(spark, odd, none):
    hot = spark.createDataFrame([(1, "x" * 100)] * 300 + [(None, "y" * 100)] * 100 + [(2, None)], "doc_id long, text string")
    got = sharding.assign_shards(hot, 1000).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.n_bytes)
    assert len(got) == 401 and max(map(sum, by.values())) <= 1000 and all(sum(by[r.shard]) == r.shard_bytes for r in got)
    assert all(not a.startswith(b) for a in by for b in by if a != b)
    assert sharding.assign_shards(none, 10).collect() == [] and sharding.assign_shards(odd, 10).count() == odd.count()


def test_write_shards_writes_each_row_once(spark, tmp_path):
    """Null, repeated and hot keys, clashing column names; a row is where it was assigned, no folder is over the limit."""
    rows = [(1, "h%03d" % i + "x" * 96, i) for i in range(300)] + [(None, "n%03d" % i + "y" * 96, i) for i in range(100)] + [(2, None, 1), (3, "a", 2), (3, "a", 2)]
    d = spark.createDataFrame(rows, "doc_id long, text string, cell long")
    table = {r.shard: r for r in sharding.write_shards(d, 1000, str(tmp_path / "out")).collect()}
    got = [(f.name[len("shard="):], r) for f in (tmp_path / "out").glob("shard=*") for r in spark.read.parquet(str(f)).collect()]
    assert sorted(((r.doc_id, r.text, r.cell) for _, r in got), key=str) == sorted(rows, key=str)
    by = {}
    for s, r in got:
        by.setdefault(s, []).append(len(r.text or ""))
    assert {s: (sum(v), len(v)) for s, v in by.items()} == {s: (r.shard_bytes, r.shard_rows) for s, r in table.items()} and max(map(sum, by.values())) <= 1000


# 7 embeddings

def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(150, 24))
    x = np.concatenate([base, base[:80] + rng.normal(size=(80, 24)) * 0.2, np.repeat(base[:3], 40, axis=0), base[5] + rng.normal(size=(60, 24)) * 0.15])
    label = rng.integers(0, 2, len(x))
    rows = [(i, v.astype(np.float32).tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))]
    rows += [(9000, None, 0), (9001, [0.0] * 24, 0), (9002, [float("nan")] * 24, 0), (9003, rows[0][1], None), (9004, [float("inf")] + [1.0] * 23, 0), (9005, [1.0, 2.0], 0),
             (9006, [1.0, 2.0], 0), (9007, [], 0), (9008, [None] + [1.0] * 23, 0)]
    d = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, rep long")
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    comp = _components(range(len(x)), zip(*np.nonzero(near)))
    got = {r.vec_id: r for r in embed_dedup.link_vectors(d).collect()}
    assert len(got) == len(rows)
    links = np.array([got[i].n_links for i in range(len(x))])
    assert (links <= near.sum(axis=1)).all() and links.sum() >= 0.9 * near.sum()
    assert np.mean([got[i].component_id == comp[i] for i in range(len(x))]) >= 0.95
    assert all(got[i].n_links == 0 and got[i].kept for i in (9000, 9001, 9002, 9003, 9004, 9007, 9008))
    assert got[9006].component_id == 9005 and not got[9006].kept
    assert embed_dedup.link_vectors(d.limit(0)).collect() == []


# 8 packing

def _packed(spark, df, window=64):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_file())
    rows = packing.pack(df, tokenizer_file(), window=window).collect()
    seqs, docs = {}, {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and len(seqs.setdefault(r.sequence_id, [])) == r.offset
        seqs[r.sequence_id] += ids
    assert all(len(s) == window for s in list(seqs.values())[:-1])
    stream = sum((seqs[k] for k in sorted(seqs)), [])
    want = sorted(tuple(tok.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in df.collect())
    at = 0
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        if r.start == 0:
            docs.setdefault(r.doc_id, []).append(tuple(stream[at:at + r.doc_tokens]))
        at += r.length
    assert sorted(sum(docs.values(), [])) == want
    return rows


def test_packing_round_trip(spark, odd, none):
    _packed(spark, spark.read.parquet(f"{SF}/documents.parquet").limit(60).select("doc_id", "text"))
    _packed(spark, odd.where("doc_id is null or doc_id not in (5, 6)"), window=16)
    assert packing.pack(none, tokenizer_file()).collect() == []


def test_packing_ids_of_odd_texts(monkeypatch):
    from tokenizers import Tokenizer
    monkeypatch.setattr(packing, "MEMO", 40)
    tok, enc = Tokenizer.from_file(tokenizer_file()), packing.WordIds(tokenizer_file(), 1)
    rng = random.Random(8)
    bits = ["don't", "a", "Ünïcode", "é", "́", "12x", "<|endoftext|>", "<|startoftext|>", "!!", "_", "ΟΔΟΣ", "İ", "ẞ", "日本", "🙂", "\x1c", " ", "\xa0", " ", "\n", "\t", "x" * 30, "'s", "WORLD,", "µ", "ª"]
    for _ in range(60):
        batch = ["".join(rng.choices(bits, k=rng.randrange(12))) + " " + " ".join("v%s" % chr(97 + rng.randrange(26)) * rng.randrange(3) for _ in range(9)) for _ in range(5)] + [""]
        ids, n = enc.encode(batch)
        want = [tok.encode(t, add_special_tokens=False).ids + [1] for t in batch]
        assert ids.tolist() == sum(want, []) and n.tolist() == [len(w) for w in want]


# 9 secrets

def _base(text):
    a = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?a:(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)))""", text) if len(m[2]) >= 6]
    a += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(a + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_secret_base_patterns():
    rng = random.Random(7)
    bits = ["password", "Token", "api_key", "APIKEY", "=", ":", " ", '"', "AKIA", "AKIA" + "Z9" * 9, "0f" * 13, "abc", "x9/+", "é", "\n", "secret", "ſecret=abcdefg"]
    for _ in range(3000):
        t = "".join(rng.choices(bits, k=rng.randrange(12)))
        assert [s for s in secrets.find_spans(t, 10.0) if s[1] < 3] == _base(t)


def test_guess_cost():
    cost = secrets.guess_cost
    assert cost("") == 0 and cost("password") < cost("password2019") < cost("tr0ub4dour&3") < cost("b7db7aa4a5fcc78305")
    assert cost("aaaaaaaaaaaa") < 5 and cost("qwertyuiop") < 5 and cost("2019-05-11") < 6 and cost("x" * 50_000) < 10
    assert [s[1] for s in secrets.find_spans("pwd: changeme ok", 10.0)] == [] and [s[1] for s in secrets.find_spans("pwd: gV7#kQ!2zLp9 ok", 10.0)] == [3]


def test_secret_cases(spark, odd, none):
    got = secrets.scan_secrets(odd).collect()
    assert len(got) == odd.count() and all(r.spans == [] for r in got) and secrets.scan_secrets(none).collect() == []
    d = spark.createDataFrame([(1, "my password=abc123xyz end", 25, "k"), (2, None, 0, "k"), (3, "é token: 'deadbeefdeadbeefdeadbeef00' z", 40, "k")], "doc_id long, text string, n_chars long, spans string")
    out = {r.doc_id: r for r in secrets.redact(d).collect()}
    assert out[1].text == "my [assign] end" and out[1].n_chars == 15 and out[2].text is None and out[3].text == "é [assign]' z"


def test_secrets_leave_prose(spark):
    """Words of the corpus after credential words stay, secrets go, also one that many copies repeat; blocks and walks over rows are cheap."""
    said = ["rebuilding", "verschlüsselungen", "renouvellement", "contraseñas"]
    rows = [f"all {w} is common, {w}." for w in said for _ in range(3)] + [f"the password is {w} here" for w in said] + ["the token is generated", "the secret is something"]
    bad = ["the password is gV7#kQ!2zLp9 ok"] + ["the password is qhzkvbwtrpx ok"] * 5
    d = spark.createDataFrame(list(enumerate(rows + bad)), "doc_id long, text string")
    out = [r.text for r in secrets.redact(d).orderBy("doc_id").collect()]
    assert out == rows + ["the password is [guess] ok"] * 6
    assert secrets.guess_cost("kq7Zkq7Zkq7Z") < 10 and secrets.guess_cost("1qaz2wsx") < 8 and secrets.guess_cost("abcdabcdabcd") < 6


# pipeline

def test_pipeline_against_brute_force(spark):
    import corpus_pipeline
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "decontamination", "secrets", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model_kept = stages["toxicity"](spark, docs, SF)
    assert model_kept.columns == docs.columns
    kept = {r.doc_id: r.text for r in model_kept.collect()}
    fp = {i: _simhash(t) for i, t in kept.items()}
    comp = _components(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4])
    kept = {i: t for i, t in kept.items() if comp[i] == i}
    items = [decontam.words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def leaks(t):
        w = decontam.words_of(t)
        return any(len(i) >= 8 and len(set(i) & set(w)) >= 0.8 * len(set(i)) - 2 and _edit(i, w) <= int(0.2 * len(i)) for i in items)

    kept = {i: t for i, t in kept.items() if not leaks(t)}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == set(kept)
    assert sum(r.length for r in got) == sum({r.doc_id: r.doc_tokens for r in got}.values())
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_file())
    for r in got[:40]:
        text, end, parts = kept[r.doc_id], 0, []
        for s, k, e in secrets.find_spans(text, 10.0):
            if s >= end:
                parts.append(text[end:s] + f"[{secrets.KINDS[k]}]")
            end = max(end, e)
        ids = tok.encode("".join(parts) + text[end:], add_special_tokens=False).ids + [1]
        assert zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32


def test_query_digests(spark):
    docs = docs_of(spark)
    for r in E.queries()["op9_secret_scans"](spark, SF).collect():
        base = _base(docs[r.doc_id] or "")
        said = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.n_assign == sum(k == 0 for _, k, _ in base)
    scored = E.queries()["op5_toxicity"](spark, SF).collect()
    assert len(scored) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in scored)
