"""Prefix trie of conversations: one node for each distinct sequence of first turns, with the sums of its subtree.

Every conversation becomes rows of at most WIDTH turns, its slabs; a slab's key names all turns before it.  Slabs are dealt
by range of (slab, key, turn ids, conversation) into shards.  A shard is a padded matrix of turn ids: it is sorted with
lexsort, the change masks of its columns, OR-accumulated from left to right, mark where nodes start, and reduceat sums up
the rows of every node of a depth.  Nodes that hold a shard's first or last row may continue in other shards, and nodes
between two slabs have members in one and children in the other: these are open; their parts are combined by key.

Two passes: the first finds each node's members and smallest member; from these follow, for each conversation, the bytes it
shares with smaller ones and whether it stands for a leaf.  The second sums these weights over each node's members, which
gives the sums over its subtree.  Nothing depends on the length of a conversation or on how many share a prefix: a long one
is many slabs, a common prefix or a group of copies is spread over shards.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, written
from tidemark.session import ship_package

#: Turns of a slab, the columns of a matrix.
WIDTH = 32
#: Rows of a shard, about.
SHARD_ROWS = 1 << 16
#: Slabs of one conversation summed up at once.
BLOCK = 4096
#: Ids of a node's ends kept in one row.
PIECE = 512
NOTHING = hashlib.sha256(b"").hexdigest()


# ---- conversations as turns in order -----------------------------------------------------------------------------------

def _placed(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, parts): the turns in order, and for each conversation and partition how many turns it holds there.

    The order is turn (null first), then the digest of role and text; rows that agree in all of it are alike.  Rows are dealt
    by range, so a conversation of any length is spread over partitions; ``seq`` counts on inside a partition.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
                                                                              .cast("binary"))).alias("id"),
        F.octet_length(text).cast("long").alias("size"), F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "id", "row"]
    rows = written(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                   .select("conv_id", "id", "size", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("seq")), "turns")
    parts = rows.groupBy("conv_id", "pid").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    earlier = Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    return rows, written(parts.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "parts")


def _in_order(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows with ``place`` in their conversation; joined per partition, so a long conversation's rows stay spread."""
    return rows.join(parts, ["conv_id", "pid"]).withColumn("place", F.col("offset") + F.col("seq") - F.col("first"))


def _lengths(parts: DataFrame) -> DataFrame:
    return parts.groupBy("conv_id").agg(F.sum("n").alias("length"))


def sequences(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths) of the conversations as they are: (conv_id, at, id, size, length) and (conv_id, length)."""
    rows, parts = _placed(conversations)
    lengths = _lengths(parts)
    turns = _in_order(rows, parts.join(lengths, "conv_id")).select("conv_id", F.col("place").alias("at"), "id", "size", "length")
    return turns, lengths


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths) of rebuilt conversations.

    Conversation c starts with the first h turns of conversation c - c % 5 (all it has if fewer, none if it is absent), h =
    crc32(decimal c) % 9, and goes on with its own turns after its first h.
    """
    rows, parts = _placed(conversations)
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    base = F.col("conv_id") - F.col("conv_id") % 5
    lengths = _lengths(parts)
    plan = (lengths.select("conv_id", head.alias("head"), base.alias("base"), F.col("length").alias("own"))
            .join(lengths.select(F.col("conv_id").alias("base"), F.col("length").alias("has")), "base", "left")
            .withColumn("taken", F.least("head", F.coalesce("has", F.lit(0))))
            .withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("head"), F.lit(0))))
    plan = written(plan, "plan")
    kept = _in_order(rows, parts.join(plan.select("conv_id", "head", "taken", "length"), "conv_id")).where("place >= head").select(
        "conv_id", (F.col("place") - F.col("head") + F.col("taken")).alias("at"), "id", "size", "length")
    # at most 8 turns a conversation, at most 5 conversations a base
    heads = (_in_order(rows, parts).where("place < 8").groupBy(F.col("conv_id").alias("base"))
             .agg(F.sort_array(F.collect_list(F.struct("place", "id", "size"))).alias("turns")))
    given = (plan.where("taken > 0").join(heads, "base")
             .select("conv_id", "length", F.inline(F.slice("turns", F.lit(1), F.col("taken").cast("int"))))
             .select("conv_id", F.col("place").alias("at"), "id", "size", "length"))
    return kept.unionByName(given), plan.select("conv_id", "length")


# ---- slabs -------------------------------------------------------------------------------------------------------------

def _before(slabs: DataFrame) -> DataFrame:
    """``key`` and ``before`` (turns and bytes before the slab) and ``after`` (the key that a next slab has).

    A key is four sums of 32-bit parts of a digest of (slab, its turns), 128 bits of hash.  Sums of the slabs before come from
    blocks of BLOCK slabs and sums of blocks before, so a long conversation is no single group.
    """
    digest = F.md5(F.concat(F.col("slab").cast("string"), F.lit(":"), F.hex("seq")).cast("binary"))
    parts = ["k0", "k1", "k2", "k3", "bytes"]
    for k in range(4):
        slabs = slabs.withColumn(f"k{k}", F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long"))
    slabs = slabs.withColumn("bytes", F.aggregate("sizes", F.lit(0).cast("long"), lambda t, x: t + x)).withColumn("block", F.expr(f"slab div {BLOCK}"))
    inner = Window.partitionBy("conv_id", "block").orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = slabs.groupBy("conv_id", "block").agg(*[F.sum(c).alias(c) for c in parts])
    sums = sums.select("conv_id", "block", *[F.coalesce(F.sum(c).over(outer), F.lit(0)).alias(f"{c}_blocks") for c in parts])
    placed = slabs.select("*", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"{c}_slabs") for c in parts]).join(sums, ["conv_id", "block"])
    total = lambda c: F.col(f"{c}_blocks") + F.col(f"{c}_slabs")
    key = lambda more: F.concat_ws(",", *[(total(c) + F.col(c) if more else total(c)).cast("string") for c in parts[:4]])
    return placed.select("conv_id", "slab", "seq", "sizes", "length", F.when(F.col("slab") == 0, "").otherwise(key(False)).alias("key"),
                         key(True).alias("after"), total("bytes").alias("before"))


def shards(turns: DataFrame, lengths: DataFrame, width: int) -> DataFrame:
    """The slabs, dealt into shards ``pid``: (pid, conv_id, slab, key, after, before, seq, sizes, length)."""
    turn = F.struct((F.col("at") % width).alias("at"), F.hex("id").alias("id"), "size")
    slabs = (turns.groupBy("conv_id", F.expr(f"at div {width}").alias("slab"))
             .agg(F.sort_array(F.collect_list(turn)).alias("t"), F.max("length").alias("length"))
             .select("conv_id", "slab", F.unhex(F.array_join("t.id", "")).alias("seq"), F.col("t.size").alias("sizes"), "length"))
    empty = lengths.where("length = 0").select("conv_id", F.lit(0).cast("long").alias("slab"), F.lit(b"").alias("seq"),
                                               F.array().cast("array<long>").alias("sizes"), "length")
    slabs = written(slabs.unionByName(empty), "slabs")
    short = slabs.where(F.col("length") < width).select("*", F.lit("").alias("key"), F.lit("").alias("after"), F.lit(0).cast("long").alias("before"))
    dealt = short.unionByName(_before(slabs.where(F.col("length") >= width)))
    spark = turns.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-slabs.count() // SHARD_ROWS))
    return written(dealt.repartitionByRange(n, "slab", "key", "seq", "conv_id").withColumn("pid", F.spark_partition_id()), "shards")


# ---- one shard ---------------------------------------------------------------------------------------------------------

@dataclass
class Depth:
    """The nodes of one depth of a shard's slabs; rows are places in the sorted shard."""
    rows: np.ndarray    # rows that reach this depth
    starts: np.ndarray  # where in ``rows`` each node starts
    first: np.ndarray   # first and last row of each node
    last: np.ndarray
    low: np.ndarray     # smallest conversation of each node
    open: np.ndarray
    edge: np.ndarray    # holds the shard's first or last row

    @property
    def counts(self) -> np.ndarray:
        return np.diff(np.append(self.starts, len(self.rows)))

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values[self.rows], self.starts)

    def spread(self, values: np.ndarray) -> np.ndarray:
        """A value of each node for each of its rows."""
        return np.repeat(values, self.counts)

    def node_of(self, rows: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, rows, side="right") - 1


class Shard:
    """The sorted matrix of a shard and its nodes by depth."""

    def __init__(self, table: pa.Table, most: int):
        self.most = most
        values = {c: table.column(c).combine_chunks() for c in table.column_names}
        seq = values["seq"].to_pylist()
        sizes = values["sizes"].to_pylist()
        n = len(seq)
        count = np.array([len(s) for s in sizes], np.int64)
        self.width = int(count.max())
        root = {k: i for i, k in enumerate(sorted(set(zip(values["slab"].to_pylist(), values["key"].to_pylist()))))}
        names = np.frombuffer(b"".join(seq), ">u8").reshape(-1, 2).astype(np.uint64)
        by = np.lexsort((names[:, 1], names[:, 0]))
        rank = np.zeros(len(names), np.int64)
        if len(names):
            rank[by] = np.concatenate([[0], np.cumsum((names[by][1:] != names[by][:-1]).any(1))])
        matrix = np.full((n, self.width + 1), -1, np.int64)
        matrix[:, 0] = [root[k] for k in zip(values["slab"].to_pylist(), values["key"].to_pylist())]
        filled = np.arange(self.width)[None, :] < count[:, None]
        matrix[:, 1:][filled] = rank
        size = np.zeros((n, self.width + 1), np.int64)
        size[:, 1:][filled] = [x for row in sizes for x in row]
        conv = values["conv_id"].to_numpy()
        order = np.lexsort((conv, *(matrix[:, j] for j in range(self.width, -1, -1))))
        matrix, self.size, self.conv, self.count = matrix[order], size[order], conv[order], count[order]
        self.slab, self.before, self.length = (values[c].to_numpy()[order] for c in ("slab", "before", "length"))
        self.seq, self.key, self.after = ([values[c][int(i)].as_py() for i in order] if c != "seq" else [seq[i] for i in order] for c in ("seq", "key", "after"))
        self.weights = {c: values[c].to_numpy()[order] for c in ("shared", "leaf") if c in values}
        #: where the conversation goes on in a next slab
        self.goes_on = self.length > (self.slab + 1) * most
        changed = np.ones(matrix.shape, bool)
        changed[1:] = matrix[1:] != matrix[:-1]
        starts_node = np.logical_or.accumulate(changed, axis=1)
        self.columns: list[Depth] = []
        for j in range(self.width + 1):
            rows = np.flatnonzero(matrix[:, j] >= 0)
            starts = np.flatnonzero(starts_node[rows, j])
            first, last = rows[starts], rows[np.append(starts[1:], len(rows)) - 1]
            edge = (first == 0) | (last == n - 1)
            between = self.slab[first] > 0 if j == 0 else np.zeros(len(first), bool)
            if j == most:
                between = np.add.reduceat(self.goes_on[rows].astype(np.int64), starts) > 0
            self.columns.append(Depth(rows, starts, first, last, np.minimum.reduceat(self.conv[rows], starts), edge | between, edge))

    def depth(self, j: int, rows: np.ndarray) -> np.ndarray:
        return self.slab[rows] * self.most + j

    def name(self, j: int, row: int) -> tuple[int, str, bytes]:
        """The name under which an open node is combined: depth, key of the slab's start and turns since."""
        depth = int(self.slab[row]) * self.most + j
        return (depth, self.after[row], b"") if j == self.most else (depth, self.key[row], self.seq[row][:16 * j])

    def children(self, j: int, inner: bool) -> np.ndarray:
        """Children of each node of depth j in this shard, without those at the shard's edges if ``inner``."""
        own = self.columns[j]
        total = np.zeros(len(own.first), np.int64)
        if j < self.width:
            below = self.columns[j + 1]
            np.add.at(total, own.node_of(below.first), (~below.edge if inner else np.ones(len(below.edge), bool)).astype(np.int64))
        return total


FIRST_PASS = ("conv_id long, shared long, leaf long, length long, pid int, depth long, key string, prefix binary, up_depth long, up_key string, "
              "up_prefix binary, edge boolean, n long, low long, children long, bytes long")
SECOND_PASS = ("kind string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, shared long, "
               "before long, member long")


def _table(rows: dict[str, list], schema: pa.Schema) -> pa.Table:
    return pa.table({f.name: pa.array(rows.get(f.name) if rows.get(f.name) is not None else [None] * len(next(iter(rows.values()))), f.type)
                     for f in schema}, schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def first_pass(table: pa.Table, width: int) -> pa.Table:
    """Each row's bytes in nodes it is not the smallest member of, whether it stands for a leaf, and the parts of open nodes."""
    shard, schema = Shard(table, width), _arrow(FIRST_PASS)
    shared, leaf = np.zeros(len(shard.conv), np.int64), np.zeros(len(shard.conv), np.int64)
    opened: dict[str, list] = {f.name: [] for f in schema}
    pid = table.column("pid")[0].as_py()
    for j, nodes in enumerate(shard.columns):
        lowest = shard.conv[nodes.rows] == nodes.spread(nodes.low)
        shared[nodes.rows] += np.where(lowest, 0, shard.size[nodes.rows, j])
        inner = shard.children(j, inner=True)
        childless = ~nodes.open & (shard.children(j, inner=False) == 0)
        leaf[nodes.rows[lowest & nodes.spread(childless)]] = 1
        for k in np.flatnonzero(nodes.open).tolist():
            row = int(nodes.first[k])
            top = j == 0
            counted = not (top and shard.slab[row] > 0)  # its members count where the slab before ends
            up = None if top else shard.name(j - 1, row)
            for field, value in zip(("depth", "key", "prefix"), shard.name(j, row)):
                opened[field].append(value)
            for field, value in zip(("up_depth", "up_key", "up_prefix"), up or (None,) * 3):
                opened[field].append(value)
            opened["edge"].append(bool(nodes.edge[k]) and not top)
            opened["n"].append(int(nodes.counts[k]) if counted else 0)
            opened["low"].append(int(nodes.low[k]) if counted else None)
            opened["children"].append(int(inner[k]))
            opened["bytes"].append(int(shard.size[row, j]))
            opened["pid"].append(pid)
    own = (shard.slab == 0) | (shared != 0) | (leaf != 0)
    weights = _table({"conv_id": shard.conv[own], "shared": shared[own], "leaf": leaf[own], "length": shard.length[own]}, schema)
    for field in ("conv_id", "shared", "leaf", "length"):
        opened[field] = [None] * len(opened["depth"])
    return pa.concat_tables([weights, _table(opened, schema)])


def second_pass(table: pa.Table, facts: pa.Table, width: int) -> pa.Table:
    """Nodes with the sums over their members ("node"), parts of open ones ("part"), and the node each conversation ends at
    ("end")."""
    shard, schema = Shard(table, width), _arrow(SECOND_PASS)
    known = {(f["depth"], f["key"], f["prefix"]): (f["low"], f["n"], f["children"]) for f in facts.to_pylist()}
    tables = []
    above: np.ndarray | None = None
    passed = shard.before.copy()  # bytes before the depth at hand
    for j, nodes in enumerate(shard.columns):
        low, n, children = nodes.low.copy(), nodes.counts, shard.children(j, inner=False)
        for k in np.flatnonzero(nodes.open).tolist():
            low[k], n[k], children[k] = known[shard.name(j, int(nodes.first[k]))]
        others = np.where(shard.conv[nodes.rows] == nodes.spread(low), 0, shard.weights["shared"][nodes.rows])
        facts_of = {"conv_id": low, "depth": shard.depth(j, nodes.first), "n_convs": n, "n_children": children,
                    "n_leaves": nodes.sums(shard.weights["leaf"]), "shared": np.add.reduceat(others, nodes.starts), "before": passed[nodes.first]}
        if above is not None:
            facts_of["parent_conv_id"] = above[shard.columns[j - 1].node_of(nodes.first)]
        shown = (shard.slab[nodes.first] == 0) if j == 0 else np.ones(len(low), bool)
        for kind, which in (("node", shown & ~nodes.open), ("part", shown & nodes.open)):
            if which.any():
                tables.append(_table({"kind": [kind] * int(which.sum()), **{c: v[which] for c, v in facts_of.items()}}, schema))
        ends = np.flatnonzero((shard.count[nodes.rows] == j) & ~shard.goes_on[nodes.rows])
        if len(ends):
            tables.append(_table({"kind": ["end"] * len(ends), "conv_id": nodes.spread(low)[ends],
                                  "depth": shard.depth(j, nodes.rows[ends]), "member": shard.conv[nodes.rows[ends]]}, schema))
        above = low
        passed = passed + shard.size[:, j]
    return pa.concat_tables(tables)


# ---- the trie ----------------------------------------------------------------------------------------------------------

def trie(turns: DataFrame, lengths: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of conversations given as (conv_id, at, id, size, length) turns and (conv_id, length).

    Nodes: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves (childless nodes
    of the subtree), saved_tokens (over the subtree, (members - 1) * bytes of the node's last turn).  (conv_id, depth) names a
    node.  Ends: member, and the conv_id and depth of the node at which it ends.
    """
    dealt = shards(turns, lengths, width)
    ship_package(turns.sparkSession)
    found = written(dealt.groupBy("pid").applyInArrow(lambda t: first_pass(t, width), FIRST_PASS), "first-pass")
    name = ["depth", "key", "prefix"]
    parts = found.where("depth is not null")
    # a child at a shard's edge may have parts in several shards: it counts once
    shared_children = (parts.where("edge").select(*name, "up_depth", "up_key", "up_prefix").distinct()
                       .groupBy(*[F.col(f"up_{c}").alias(c) for c in name]).agg(F.count("*").alias("more")))
    facts = (parts.groupBy(*name).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.sum("children").alias("inner"))
             .join(shared_children, name, "left")
             .select(*name, "n", "low", (F.col("inner") + F.coalesce("more", F.lit(0))).alias("children")))
    facts = written(facts, "facts")
    lost = (parts.where("low is not null").select(*name, F.col("low").alias("conv_id"), "bytes").join(facts.select(*name, "low"), name)
            .where("conv_id <> low").select("conv_id", F.col("bytes").alias("shared"), F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("length")))
    leaves = facts.where("children = 0").select(F.col("low").alias("conv_id"), F.lit(0).cast("long").alias("shared"), F.lit(1).cast("long").alias("leaf"),
                                                F.lit(0).cast("long").alias("length"))
    weights = (found.where("depth is null").select("conv_id", "shared", "leaf", "length").unionByName(lost).unionByName(leaves)
               .groupBy("conv_id").agg(F.sum("shared").alias("shared"), F.sum("leaf").alias("leaf"), F.max("length").alias("length")))
    # one row for each block of a conversation's slabs: the join stays spread where one conversation holds many
    blocks = F.sequence(F.lit(0).cast("long"), F.expr(f"greatest(length - 1, 0) div {width * BLOCK}"))
    weights = weights.select("conv_id", "shared", "leaf", F.explode(blocks).alias("block"))
    weighted = dealt.withColumn("block", F.expr(f"slab div {BLOCK}")).join(weights, ["conv_id", "block"]).drop("block")
    own = parts.select("pid", *name).distinct().join(facts, name)
    result = written(weighted.groupBy("pid").cogroup(own.groupBy("pid")).applyInArrow(lambda t, f: second_pass(t, f, width), SECOND_PASS), "second-pass")
    facts_of = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "shared", "before"]
    joined = (result.where("kind = 'part'").groupBy("conv_id", "depth")
              .agg(*[F.max(c).alias(c) for c in ("parent_conv_id", "n_convs", "n_children", "before")], F.sum("n_leaves").alias("n_leaves"),
                   F.sum("shared").alias("shared")).select(*facts_of))
    saved = F.col("shared") - (F.col("n_convs") - 1) * F.col("before")
    nodes = result.where("kind = 'node'").select(*facts_of).unionByName(joined).select(*facts_of[:-2], saved.alias("saved_tokens"))
    return nodes, result.where("kind = 'end'").select("member", "conv_id", "depth")


def prefix_trie(conversations: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of the conversations as they are, see :func:`trie`.

    Turns are ordered by turn, null first, ties by a digest of role and text; repeated rows are turns of their own.  A null
    role or text is empty.  Rows of a null conv_id belong to no conversation and are left out; other columns are not read;
    an empty table gives no node, not even a root.  Turns are equal if 128 bits of digest of (role, text) are.
    """
    return trie(*sequences(conversations), width)


def rebuilt_trie(conversations: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of the conversations as :func:`rebuilt` makes them; otherwise as :func:`prefix_trie`.

    A conversation left without turns is a member of the root.  Negative ids keep Spark's remainder, which has their sign.
    """
    return trie(*rebuilt(conversations), width)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv_id, depth, member) rows as rows of at most PIECE members, comma-joined."""
    for batch in batches:
        conv, depth, member = (batch.column(c).to_numpy() for c in ("conv_id", "depth", "member"))
        if not len(conv):
            continue
        start = np.flatnonzero(np.concatenate([[True], (conv[1:] != conv[:-1]) | (depth[1:] != depth[:-1])]))
        cut = np.unique(np.concatenate([np.arange(a, b, PIECE) for a, b in zip(start, np.append(start[1:], len(conv)))]))
        text = [",".join(map(str, member[a:b].tolist())) for a, b in zip(cut, np.append(cut[1:], len(conv)))]
        yield pa.RecordBatch.from_arrays([pa.array(conv[cut]), pa.array(depth[cut]), pa.array(member[cut]), pa.array(text)],
                                         ["conv_id", "depth", "first", "members"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of each node's pieces in order, fed piece by piece."""
    at, state = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([state.hexdigest()])],
                                          ["conv_id", "depth", "ends_sha256"])

    for batch in batches:
        conv, depth, sha = [], [], []
        for c, d, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "depth", "members"))):
            if at != (c, d):
                if at is not None:
                    conv.append(at[0]), depth.append(at[1]), sha.append(state.hexdigest())
                at, state = (c, d), hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        if conv:
            yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(depth, pa.int64()), pa.array(sha)], ["conv_id", "depth", "ends_sha256"])
    if at is not None:
        yield done()


def ends_digest(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256): the hash of each node's ending members, in order and comma-joined.

    Members are dealt by range and packed into rows of PIECE first; a hash must then read one node's rows in order, as a stream.
    """
    order = ["conv_id", "depth", "member"]
    packed = map_arrow(ends.repartitionByRange(*order).sortWithinPartitions(*order), _pieces, "conv_id long, depth long, first long, members string")
    return map_arrow(packed.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first"), _hashed,
                     "conv_id long, depth long, ends_sha256 string")


def digest(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """The nodes with ``ends_sha256``, that of the empty string where no conversation ends."""
    none: Column = F.lit(NOTHING)
    return (nodes.join(ends_digest(ends), ["conv_id", "depth"], "left")
            .select(*nodes.columns, F.coalesce("ends_sha256", none).alias("ends_sha256")))
