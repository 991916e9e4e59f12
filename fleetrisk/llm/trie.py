"""Conversation prefix trie (operator 11): subtree sums by the Euler-tour technique.

Every distinct sequence of first turns is a node. An enter and an exit arc per node form a tour of the trie, a linked list; it is
ranked distributedly (``list_rank``), and what a subtree holds is the difference of two prefix sums at its arcs' positions
(Tarjan and Vishkin, "An efficient parallel biconnectivity algorithm", 1985).

A node's name is taken from sums of position-dependent turn hashes, so it needs no walk along a conversation. Runs of arcs that the trie
alone links one after the other (one conversation's own path) enter the list as one element.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash
from .list_rank import BASE, list_rank, prefix_sums

#: Turns of one conversation, or nodes of one path, that a window holds.
PIECE = 4096
#: Ids that one chunk of a member list holds.
CHUNK = 4096
_LANES = range(4)
_EMPTY = hashlib.sha256(b"").hexdigest()


def _said() -> list[Column]:
    """What the trie needs of a turn: a digest of role and text, and the text's bytes."""
    return [F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)).alias("said"),
            F.octet_length("text").cast("long").alias("bytes")]


def number_turns(conversations: DataFrame, texts: bool = True) -> DataFrame:
    """(conv_id, pos, role, text): the turns of each conversation numbered from 1, null role and text as empty strings.

    Without ``texts`` a digest and the text's length stand for role and text (said, bytes). Order is by ``turn`` (null first), ties by role, then text; repeated rows are turns of their own. Rows without a conv_id belong to no
    conversation and are left out; other columns are not read. The table is cut into ranges, so a conversation of any
    size spreads over tasks; only a range's first conversation can begin before it, which a row a range settles.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    c = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
                                                          text("role").alias("role"), text("text").alias("text"))
    # bounds of ranges hold prefixes only; they order as the whole values do
    short = F.length("role") <= 64
    bounds = ["conv_id", "turn", F.substring("role", 1, 64), ~short, F.when(short, F.substring("text", 1, 64))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for b in batches:
            pos = []
            for i in b.column("conv_id").to_pylist():
                n = n + 1 if i == last else 1
                last = i
                pos.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pos, pa.int64())], names=[*b.schema.names, "pos"])

    kept = ["role", "text"] if texts else _said()
    kinds = "role string, text string" if texts else "said binary, bytes long"
    cut = (c.repartitionByRange(*bounds).sortWithinPartitions("conv_id", "turn", "role", "text")
           .select("conv_id", F.spark_partition_id().alias("_part"), *kept)
           .mapInArrow(count, f"conv_id long, _part int, {kinds}, pos long"))
    cut = stash(cut, "turns")
    spans = cut.groupBy("conv_id", "_part").agg(F.max("pos").alias("_n"))
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("conv_id", "_part", F.sum("_n").over(before).alias("_before")).where("_before > 0")
    return (cut.join(F.broadcast(spans), ["conv_id", "_part"], "left")  # at most one row a range
            .select("conv_id", (F.col("pos") + F.coalesce("_before", F.lit(0))).alias("pos"), *(["role", "text"] if texts else ["said", "bytes"])))


def _name(depth: Column, lanes: list[Column]) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat_ws(":", depth.cast("string"), *(x.cast("string") for x in lanes)), 256), 1, 32))


def _named(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, name, parent, bytes, said, is_end) of numbered turns: the node that each turn leads to."""
    t = turns.select("conv_id", "pos", F.floor((F.col("pos") - 1) / PIECE).alias("_piece"), *(["said", "bytes"] if "said" in turns.columns else _said()))
    mixed = [F.xxhash64(F.lit(k), "pos", "said") for k in (1, 2)]
    low = F.lit(0xFFFFFFFF).cast("long")
    lanes = [x for m in mixed for x in (m.bitwiseAND(low), F.shiftrightunsigned(m, 32))]  # 32 bits each: sums don't overflow
    t = t.select("*", *(x.alias(f"_l{k}") for k, x in zip(_LANES, lanes)))
    inside = Window.partitionBy("conv_id", "_piece").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    own = t.select("*", *(F.sum(f"_l{k}").over(inside).alias(f"_s{k}") for k in _LANES))
    pieces = t.groupBy("conv_id", "_piece").agg(F.count(F.lit(1)).alias("_n"), *(F.sum(f"_l{k}").alias(f"_t{k}") for k in _LANES))
    whole = Window.partitionBy("conv_id")  # one row a piece
    before = whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("conv_id", "_piece", F.sum("_n").over(whole).alias("_length"),
                           *(F.coalesce(F.sum(f"_t{k}").over(before), F.lit(0)).alias(f"_o{k}") for k in _LANES))
    sums = [F.col(f"_s{k}") + F.col(f"_o{k}") for k in _LANES]
    return own.join(pieces, ["conv_id", "_piece"]).select(
        "conv_id", F.col("pos").alias("depth"), _name(F.col("pos"), sums).alias("name"),
        _name(F.col("pos") - 1, [s - F.col(f"_l{k}") for k, s in zip(_LANES, sums)]).alias("parent"),
        "bytes", "said", (F.col("pos") == F.col("_length")).alias("is_end"))


def _siblings(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``part`` (range of (parent, conv_id)), ``next`` (sibling with the next larger conv_id) and ``is_first``.

    Siblings lie in ranges, so a parent of very many children spreads over tasks; what ranges' ends need is settled by two rows a range.
    """
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before, front = None, None, True
        schema = None

        def out(t: pa.RecordBatch, nexts: pa.Array, firsts: list, edges: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*t.columns, nexts, pa.array(firsts, pa.bool_()), pa.array(edges, pa.bool_())], names=[*schema, "next", "is_first", "_edge"])

        for b in batches:
            if not b.num_rows:
                continue
            schema = b.schema.names
            t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks().to_batches()[0]
            n = t.num_rows - 1
            if n:
                up, names = t.column("parent"), t.column("name")
                same = pc.equal(up.slice(1), up.slice(0, n)).to_pylist()
                nexts = pa.array([k if s else None for k, s in zip(names.slice(1).to_pylist(), same)], names.type)
                firsts = [up[0].as_py() != before, *(not s for s in same[:-1])]
                yield out(t.slice(0, n), nexts, firsts, [front] + [False] * (n - 1))
                before, front = up[n - 1].as_py(), False
            held = t.slice(n, 1)
        if held is not None:
            yield out(held, pa.nulls(1, held.column("name").type), [held.column("parent")[0].as_py() != before], [True])

    cut = (nodes.repartitionByRange("parent", "conv_id").sortWithinPartitions("parent", "conv_id").withColumn("part", F.spark_partition_id()))
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    cut = stash(cut.mapInArrow(link, f"{kind}, next binary, is_first boolean, _edge boolean"), "siblings")
    order = Window.partitionBy(F.lit(0)).orderBy("part", "parent", "conv_id")  # two rows a range
    edges = cut.where("_edge").select(
        "name", F.when(F.lead("parent").over(order) == F.col("parent"), F.lead("name").over(order)).alias("_next"),
        F.lag("parent").over(order).eqNullSafe(F.col("parent")).alias("_follows"),
        (F.lead("part").over(order) == F.col("part")).alias("_goes_on"))
    return (cut.join(F.broadcast(edges), "name", "left")
            .withColumn("next", F.when(F.coalesce("_goes_on", F.lit(True)), F.col("next")).otherwise(F.coalesce("next", "_next")))
            .withColumn("is_first", F.col("is_first") & ~F.coalesce("_follows", F.lit(False)))
            .drop("_edge", "_next", "_follows", "_goes_on"))


def _member_digests(ends: DataFrame) -> DataFrame:
    """(name, conv_id) -> (name, n_ends, ends_sha256): digest of the ids in ascending order, comma-joined.

    Ids are joined in chunks over ranges first; a name's chunks are then streamed through one digest, which is sequential by nature.
    """
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids = None, []

        def out():
            return pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([len(ids)], pa.int64()),
                                               pa.array([",".join(map(str, ids))], pa.string())], names=["name", "low", "n", "ids"])
        for b in batches:
            for k, i in zip(b.column("name").to_pylist(), b.column("conv_id").to_pylist()):
                if ids and (k != name or len(ids) == CHUNK):
                    yield out()
                    ids = []
                name = k
                ids.append(i)
        if ids:
            yield out()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, n, said = None, 0, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([n], pa.int64()), pa.array([said.hexdigest()])], names=["name", "n_ends", "ends_sha256"])
        for b in batches:
            for k, count, ids in zip(*(b.column(c).to_pylist() for c in ("name", "n", "ids"))):
                if k != name or said is None:
                    if said is not None:
                        yield out()
                    name, n, said = k, 0, hashlib.sha256()
                said.update((("," if n else "") + ids).encode())
                n += count
        if said is not None:
            yield out()

    cut = (ends.repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id")
           .mapInArrow(chunks, "name binary, low long, n long, ids string"))
    return cut.repartition("name").sortWithinPartitions("name", "low").mapInArrow(digest, "name binary, n_ends long, ends_sha256 string")


def _enter(name) -> Column:
    return F.concat(name, F.unhex(F.lit("00")))


def _exit(name) -> Column:
    return F.concat(name, F.unhex(F.lit("01")))


def _tour(tree: DataFrame) -> DataFrame:
    """Arcs of the Euler tour, a row a node: for enter (e) and exit (x), the run's head, the place in it and, on its last arc, the successor.

    A node and its first child of the same conv_id lie on one path. The enter arcs of a path follow each other; its exit arcs do
    so while a node has no next sibling. Paths are cut every ``PIECE`` nodes.
    """
    t = tree.withColumn("_cut", F.floor(F.col("depth") / PIECE))
    down = Window.partitionBy("conv_id", "_cut").orderBy("depth")
    up = Window.partitionBy("conv_id", "_cut").orderBy(F.desc("depth"))
    breaks = F.lag("name").over(up).isNull() | F.lag("next").over(up).isNotNull()
    t = t.select("*", _enter(F.first("name").over(down)).alias("e_head"), (F.row_number().over(down) - 1).cast("long").alias("e_off"),
                 F.lead("name").over(down).isNull().alias("e_last"), F.sum(breaks.cast("long")).over(up).alias("_run"))
    run = Window.partitionBy("conv_id", "_cut", "_run").orderBy(F.desc("depth"))
    return t.select("*", _exit(F.first("name").over(run)).alias("x_head"), (F.row_number().over(run) - 1).cast("long").alias("x_off"),
                    F.lead("name").over(run).isNull().alias("x_last"),
                    F.coalesce(_enter("first_child"), _exit("name")).alias("e_succ"),
                    F.coalesce(_enter("next"), _exit("parent")).alias("x_succ")).drop("_cut", "_run")


def trie_of(turns: DataFrame, ids: DataFrame | None = None, base: int = BASE) -> DataFrame:
    """The trie of numbered turns (conv_id, pos from 1 without gaps, role, text or said, bytes, none null).

    One row per node: conv_id (smallest member), depth, parent_conv_id (the parent's; null for the root), n_convs (members), n_children, n_leaves
    (childless nodes of the subtree), own_tokens ((n_convs - 1) times UTF-8 bytes of the last text), saved_tokens (their sum over the subtree),
    n_ends and ends_sha256 (members that end here), enter and exit (positions in the tour). A node's last turn is
    turn ``depth`` of conversation ``conv_id``. ``ids`` (conv_id) names conversations that may have no turn; they end at the root. Null ids
    are left out; without any conversation there is no node. ``base``: see ``list_rank``.
    """
    spark = turns.sparkSession
    named = stash(_named(turns), "trie-turns")
    convs = named.where("depth = 1").select("conv_id")
    bare = (ids.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct().join(convs, "conv_id", "left_anti")
            if ids is not None else convs.limit(0))
    root_name = _name(F.lit(0), [F.lit(0)] * len(_LANES))
    root = (convs.union(bare).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
            .select(root_name.alias("name"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"),
                    F.lit(0).cast("long").alias("bytes"), "conv_id", "n_convs"))
    # a name stands for one parent and one last turn: grouped by all three, and checked
    nodes = stash(named.groupBy("name", "parent", "depth", "bytes", "said").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
                  .drop("said"), "trie-nodes")
    if nodes.groupBy("name").count().where("count > 1").limit(1).count():
        raise RuntimeError("two nodes share a name")
    sib = _siblings(nodes.select("name", "parent", "depth", "bytes", "conv_id", "n_convs"))
    kids = (sib.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))
            .join(sib.where("is_first").select("parent", F.col("name").alias("first_child")), "parent").withColumnRenamed("parent", "name"))
    all_nodes = sib.drop("is_first").unionByName(root.select("*", F.lit(-1).alias("part"), F.lit(None).cast("binary").alias("next")))
    tree = all_nodes.join(kids, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    tour = stash(_tour(tree).withColumn("own_tokens", (F.col("n_convs") - 1) * F.col("bytes")), "trie-tour")

    lists = [tour.where(f"{k}_last").select(F.col(f"{k}_head").alias("id"), F.col(f"{k}_succ").alias("succ"), (F.col(f"{k}_off") + 1).alias("w")) for k in "ex"]
    pos = list_rank(lists[0].union(lists[1]), base)
    leaf = (F.col("n_children") == 0).cast("long")
    none = F.lit(0).cast("long")
    arcs = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"{k}_head").alias("id"), F.col(f"{k}_off").alias("off"),
                              (leaf if k == "e" else none).alias("leaf"), (F.col("own_tokens") if k == "e" else none).alias("saves")) for k in "ex"))
    arcs = tour.select("name", F.explode(arcs).alias("a")).select("name", "a.*").join(pos, "id").select("name", "kind", "leaf", "saves", (F.col("pos") + F.col("off")).alias("at"))
    sums = prefix_sums(arcs, "at", {"leaves": F.col("leaf"), "saved": F.col("saves")})
    enters = F.col("kind") == "e"
    part = lambda total, own: F.sum(F.when(enters, F.col(own) - F.col(total)).otherwise(F.col(total)))
    under = sums.groupBy("name").agg(part("leaves", "leaf").alias("n_leaves"), part("saved", "saves").alias("saved_tokens"),
                                     F.min("at").alias("enter"), F.max("at").alias("exit"))
    ends = named.where("is_end").select("name", "conv_id").union(bare.select(root_name.alias("name"), "conv_id"))
    # a parent's conv_id reaches its children by the ranges that they lie in, so very many children don't meet in one task
    above = (sib.select("parent", "part").distinct().join(tour.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent"))
    return (tour.join(under, "name").join(_member_digests(ends), "name", "left").join(above, ["parent", "part"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "own_tokens", "saved_tokens",
                    F.coalesce("n_ends", F.lit(0)).cast("long").alias("n_ends"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"), "enter", "exit"))


def prefix_trie(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The prefix trie of ``conversations`` (conv_id, turn, role, text); order and nulls as in ``number_turns``, result as in ``trie_of``."""
    return trie_of(number_turns(conversations), ids)


def node_texts(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """``nodes`` with role and text of each node's last turn, from numbered turns; null for the root."""
    last = turns.select("conv_id", F.col("pos").alias("depth"), "role", "text")
    return nodes.join(last, ["conv_id", "depth"], "left")


def splice(turns: DataFrame, ids: DataFrame, group: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt from numbered ``turns``: the first h turns of conversation c - c % ``group``, then c's own after its first h.

    h is the crc32 of c in decimal modulo ``most`` + 1; a shorter (or absent) other conversation gives all it has. Returns the
    rebuilt turns, numbered, and the ids of all rebuilt conversations (some may be left without a turn).
    """
    h = lambda c: F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(most + 1)).cast("long")
    heads = turns.where(F.col("pos") <= most).withColumnRenamed("conv_id", "other")
    own_length = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    have = heads.groupBy("other").agg(F.count(F.lit(1)).alias("have"))
    convs = (ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("other"), h("conv_id").alias("h"))
             .join(own_length, "conv_id", "left").join(have, "other", "left")
             .select("conv_id", "other", F.coalesce("n", F.lit(0)).alias("n"), "h", F.least("h", F.coalesce("have", F.lit(0))).alias("taken")))
    first = (convs.where("taken > 0").join(heads, "other").where("pos <= taken").select(*turns.columns))
    # the shift of a conversation's own turns joins piece by piece, so a very long conversation stays spread
    shift = convs.select("conv_id", (F.col("h") - F.col("taken")).alias("shift"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / PIECE))).alias("_piece"))
    rest = (turns.where(F.col("pos") > h("conv_id")).withColumn("_piece", F.floor(F.col("pos") / PIECE)).join(shift, ["conv_id", "_piece"])
            .withColumn("pos", F.col("pos") - F.col("shift")).select(*turns.columns))
    return first.unionByName(rest), convs.select("conv_id")
