"""Operator 11 against brute force: list ranking, numbering over ranges, the trie, odd input."""

import hashlib
import random
import zlib

import pytest

pytest.importorskip("fleetrisk.llm")

import __spark_entry__ as E  # noqa: E402
from fleetrisk.llm import list_rank, trie  # noqa: E402
from oracle import compare, duck  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(convs: dict[int, list[tuple[str, str]]]) -> set[tuple]:
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1].encode()) if k else 0)
    out = set()
    for k, m in members.items():
        ends = sorted(c for c in m if len(convs[c]) == len(k))
        out.add((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children.get(k, [])), leaves[k], saved[k],
                 hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def rows_of(df):
    got = [tuple(r) for r in df.select(*COLUMNS).collect()]
    assert len(got) == len(set(got))
    return set(got)


def random_convs(seed: int, n: int) -> dict[int, list[tuple[str, str]]]:
    rng = random.Random(seed)
    said = [("user", "hi"), ("user", "hé日本"), ("assistant", "ok"), ("assistant", ""), ("", "x" * 50), ("user", "o k"), ("user: o", "k")]
    return {rng.randrange(-3, 10 ** 12) if i % 7 else i: rng.choices(said, k=rng.randrange(0, 7)) for i in range(n)}


def frame(spark, convs):
    return spark.createDataFrame([(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)] or [(None, 0, "", "")],
                                 "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("base", [3, 50_000])
def test_list_rank(spark, base):
    rng = random.Random(base)
    order = [i.to_bytes(4, "big") for i in rng.sample(range(10 ** 6), 200)]
    weights = [rng.randrange(1, 9) for _ in order]
    rows = list(zip(order, [*order[1:], None], weights))
    rng.shuffle(rows)
    got = {bytes(r.id): r.pos for r in list_rank.list_rank(spark.createDataFrame(rows, "id binary, succ binary, w long"), base).collect()}
    assert got == {k: sum(weights[:i]) for i, k in enumerate(order)}
    none = spark.createDataFrame([], "id binary, succ binary, w long")
    assert list_rank.list_rank(none, base).count() == 0


def test_list_rank_refuses_two_lists(spark):
    rows = spark.createDataFrame([(b"a", None, 1), (b"b", None, 1)], "id binary, succ binary, w long")
    with pytest.raises(Exception, match="not one linked list"):
        list_rank.list_rank(rows).collect()


def test_prefix_sums(spark):
    rows = spark.range(1000).withColumn("v", (F.col("id") * 7) % 13)
    got = {r.id: r.s for r in list_rank.prefix_sums(rows, "id", {"s": F.col("v")}, block=64).collect()}
    assert got == {i: sum(j * 7 % 13 for j in range(i + 1)) for i in range(1000)}


@pytest.mark.parametrize("seed, base", [(1, 50_000), (2, 5)])
def test_trie_against_brute_force(spark, seed, base):
    convs = random_convs(seed, 120)
    ids = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    nodes = trie.trie_of(trie.number_turns(frame(spark, convs)), ids, base).cache()
    assert rows_of(nodes) == brute(convs)
    tour = sorted(x for r in nodes.collect() for x in (r.enter, r.exit))
    assert tour == list(range(2 * len(brute(convs))))


def test_long_conversation_and_many_children(spark, monkeypatch):
    """A conversation of many pieces, paths cut often, chunks of ids, very many children of one node."""
    monkeypatch.setattr(trie, "PIECE", 16)
    monkeypatch.setattr(trie, "CHUNK", 10)
    path = [("user", f"t{i}") for i in range(150)]
    convs = {0: path, 1: path[:100], 2: path[:100] + [("user", "else")], 3: path[:32], 4: path[:16], 5: path[:17]}
    convs |= {i: [("user", f"own {i}")] for i in range(10, 210)} | {i: [("user", "own 10")] for i in range(300, 345)}
    assert rows_of(trie.prefix_trie(frame(spark, convs))) == brute(convs)


def test_odd_rows(spark):
    rows = [(1, None, "user", "first"), (1, 0, "user", None), (1, 0, None, "x"), (2, 0, "user", "a"), (2, 0, "user", "a"), (None, 0, "user", "lost"), (3, 1, "r" * 80, "y" * 100_000),
            (3, 1, "r" * 80 + "s", "b"), (3, 1, "r" * 79, "c")]
    c = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, name string, pos long, depth long")
    want = {1: [("user", "first"), ("", "x"), ("user", "")], 2: [("user", "a")] * 2, 3: [("r" * 79, "c"), ("r" * 80, "y" * 100_000), ("r" * 80 + "s", "b")], 9: []}
    numbered = trie.number_turns(c)
    got = {}
    for r in sorted(numbered.collect(), key=lambda r: (r.conv_id, r.pos)):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
        assert r.pos == len(got[r.conv_id])
    assert got == {k: v for k, v in want.items() if v}
    ids = spark.createDataFrame([(1,), (2,), (9,), (9,), (None,)], "conv_id long")
    nodes = trie.prefix_trie(c, ids)
    assert rows_of(nodes) == brute(want)
    last = {(r.conv_id, r.depth): r.text for r in trie.node_texts(nodes, numbered).collect()}
    assert last[1, 1] == "first" and last[1, 0] is None and last[2, 2] == "a"


def test_nothing(spark):
    none = frame(spark, {})
    assert trie.prefix_trie(none).count() == 0
    only = spark.createDataFrame([(7,), (5,)], "conv_id long")
    assert rows_of(trie.prefix_trie(none, only)) == brute({5: [], 7: []})


def test_splice(spark):
    convs = {c: t for c, t in random_convs(4, 60).items() if t} | {i: [("user", f"{i}.{k}") for k in range(12)] for i in range(1000, 1040)}
    convs = {abs(c): t for c, t in convs.items()}
    h = lambda c: zlib.crc32(str(c).encode()) % 9
    want = {c: convs.get(c - c % 5, [])[:h(c)] + t[h(c):] for c, t in convs.items()}
    numbered = trie.number_turns(frame(spark, convs))
    turns, ids = trie.splice(numbered, numbered.select("conv_id").distinct())
    assert {r.conv_id for r in ids.collect()} == set(convs)
    assert rows_of(trie.trie_of(turns, ids)) == brute(want)


def test_query_matches_sql(spark):
    res = compare(E.queries()["op11_conversation_trie"](spark, SF), duck(SF), E.oracle_sql()["op11_conversation_trie"])
    assert res["values_match"], res
