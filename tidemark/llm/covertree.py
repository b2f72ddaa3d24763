"""Embedding near-duplicates by dual traversal of cover trees: exact threshold pairs.

Unit vectors of equal label are dealt into cells around centres of a bounded sample, and cells that are too large into
cells around centres of their own, until they are blocks of bounded size.  Every block gets a cover tree: nested levels of nodes whose radii halve from level to level, each point within its node's covering radius.
Two blocks are compared by walking both trees level by level; a pair of nodes is pruned if its centres are further apart
than the threshold plus both covering radii, and with it all pairs below.  A task returns link counts and a spanning
forest of its links, never the pairs.  Equal vectors are one weighted representative throughout.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bitslice import sound
from tidemark.llm.common import map_arrow, written
from tidemark.llm.components import components
from tidemark.session import ship_package

BLOCK = 1024
CENTRES = 64
#: Times that too large cells are parted again; each time makes up to CENTRES cells of one.
DEPTH = 8
#: Levels end where the radius falls below this share of the threshold distance.
FINEST = 0.25


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def cover_levels(points: np.ndarray, finest: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(centre, parent, radius) of the nodes of each level, the root first and every point as a leaf last.

    Centres are point numbers, parents node numbers of the level above, radii the largest distance to a point below.  A
    node's centre is a node again on the next level (nesting); a level's points lie within half the radius of the level above.
    """
    n = len(points)
    distance = np.sqrt(np.maximum(0, 2 - 2 * points @ points[0]))
    node_of = np.zeros(n, np.int64)
    radius = float(distance.max(initial=0.0))
    levels = [(np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([radius]))]
    reach = distance  # of each point to its node's centre
    while radius > finest and len(levels[-1][0]) < n:
        radius /= 2
        centres, parents = list(levels[-1][0]), list(range(len(levels[-1][0])))
        new_node, new_reach = node_of.copy(), reach.copy()
        open_ = reach > radius
        while open_.any():
            at = int(np.argmax(np.where(open_, reach, -1.0)))
            mine = np.flatnonzero(open_ & (node_of == node_of[at]))
            d = np.sqrt(np.maximum(0, 2 - 2 * points[mine] @ points[at]))
            near = mine[d <= radius]
            near = near if at in near else np.append(near, at)
            new_node[near], new_reach[near] = len(centres), np.sqrt(np.maximum(0, 2 - 2 * points[near] @ points[at]))
            centres.append(at)
            parents.append(int(node_of[at]))
            open_[near] = False
        node_of, reach = new_node, new_reach
        most = np.zeros(len(centres))
        np.maximum.at(most, node_of, reach)
        levels.append((np.array(centres), np.array(parents), most))
    levels.append((np.arange(n), node_of, np.zeros(n)))
    return levels


def dual_traversal(a: np.ndarray, levels_a: list, b: np.ndarray, levels_b: list, least: float) -> np.ndarray:
    """Boolean matrix of the pairs with cosine >= ``least``."""
    limit = np.sqrt(max(0.0, 2 - 2 * least)) + 1e-7
    depth = max(len(levels_a), len(levels_b))
    open_ = np.ones((1, 1), bool)
    for level in range(depth):
        # the shorter tree waits at its last level before the leaves
        ia, ib = (min(level, len(x) - 2) if level < depth - 1 else len(x) - 1 for x in (levels_a, levels_b))
        down = lambda x, i, was: x[i][1] if i != was else np.arange(len(x[i][0]))
        if level:
            open_ = open_[np.ix_(down(levels_a, ia, wa), down(levels_b, ib, wb))]
        wa, wb = ia, ib
        (ca, _, ra), (cb, _, rb) = levels_a[ia], levels_b[ib]
        rows, cols = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
        cosine = a[ca[rows]] @ b[cb[cols]].T
        if level == depth - 1:
            near = cosine >= least
        else:
            near = np.sqrt(np.maximum(0, 2 - 2 * cosine)) <= limit + ra[rows][:, None] + rb[cols][None, :]
        kept = np.zeros_like(open_)
        kept[np.ix_(rows, cols)] = near & open_[np.ix_(rows, cols)]
        open_ = kept
    return open_


def local_roots(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a bipartite link matrix, the smallest row number of the component of each row and column (-1: no link)."""
    none = linked.shape[0]
    row = np.where(linked.any(1), np.arange(none), none)
    while True:
        col = np.where(linked, row[:, None], none).min(0, initial=none)
        new = np.minimum(row, np.where(linked, col[None, :], none).min(1, initial=none))
        if (new == row).all():
            return np.where(row < none, row, -1), np.where(col < none, col, -1)
        row = new


def pack_levels(levels: list) -> list[bytes]:
    return [part.astype(kind).tobytes() for level in levels for part, kind in zip(level, ("<i4", "<i4", "<f8"))]


def unpack_levels(parts: list[bytes]) -> list:
    return [tuple(np.frombuffer(parts[i + k], kind) for k, kind in enumerate(("<i4", "<i4", "<f8"))) for i in range(0, len(parts), 3)]


def around_centres(cells: DataFrame) -> DataFrame:
    """The cells (group, cell, rep, weight, embedding) parted: each vector goes to the nearest of its cell's centres.

    A cell has a centre for every BLOCK vectors, CENTRES at most.  Vectors are salted, so that no task sees a whole cell.
    """
    whole = ["group", "cell"]
    sized = cells.join(cells.groupBy(*whole).agg(F.count("*").alias("size")), whole)
    by_hash = Window.partitionBy(*whole).orderBy(F.xxhash64("rep", "embedding"), "rep")
    centres = (sized.withColumn("nth", F.row_number().over(by_hash)).where(F.col("nth") <= CENTRES)
               .where(F.col("nth") <= F.ceil(F.col("size") / BLOCK)).select(*whole, F.col("embedding").alias("centre"), "size"))
    salts = F.ceil(F.col("size") / (4 * BLOCK)).cast("int")
    salted = sized.withColumn("salt", F.pmod(F.hash("rep"), salts)).select(*whole, "salt", "rep", "weight", "embedding")
    spread = written(centres.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).select(*whole, "salt", "centre"), "covertree-centres")

    def nearest(key: tuple, rows: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({c: [] for c in ("group", "cell", "rep", "weight", "embedding")})
        hubs = unit(np.stack(sorted(map(tuple, around["centre"]))).astype(np.float64))
        hub = np.argmax(unit(np.stack(rows["embedding"].to_numpy()).astype(np.float64)) @ hubs.T, axis=1)
        return rows[["group", "rep", "weight", "embedding"]].assign(cell=[f"{key[1]}{h}." for h in hub.tolist()])[
            ["group", "cell", "rep", "weight", "embedding"]]

    ship_package(cells.sparkSession)
    key = [*whole, "salt"]
    return written(salted.groupBy(*key).cogroup(spread.groupBy(*key)).applyInPandas(nearest, cells.schema), "covertree-cells")


def parted(classes: DataFrame) -> DataFrame:
    """(group, cell, rep, weight, embedding): cells of at most BLOCK vectors, as far as DEPTH times of parting make them."""
    open_, done = classes.select("group", F.lit("").alias("cell"), "rep", "weight", "embedding"), []
    for _ in range(DEPTH):
        cells = around_centres(open_)
        large = cells.groupBy("group", "cell").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK).select("group", "cell")
        large = written(large, "covertree-large")
        if large.isEmpty():
            break
        done.append(cells.join(large, ["group", "cell"], "left_anti"))
        cells = open_ = cells.join(large, ["group", "cell"], "left_semi")
    return written(reduce(DataFrame.unionByName, done, cells), "covertree-parted") if done else cells


def build_blocks(classes: DataFrame, least: float) -> DataFrame:
    """(label, block, root, radius, ids, weights, vectors, tree) of every block of at most about BLOCK vectors."""
    finest = FINEST * float(np.sqrt(max(0.0, 2 - 2 * least)))
    # group: vectors of equal label and length
    kinds = f"group {classes.schema['group'].dataType.simpleString()}"
    cells = parted(classes)
    # what centres could not part is cut by hash
    counts = cells.groupBy("group", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = cells.join(counts, ["group", "cell"]).withColumn("part", F.pmod(F.hash("rep"), F.col("parts")))

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep", kind="stable")
        vectors = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
        points = unit(vectors)
        levels = cover_levels(points, finest)
        return pd.DataFrame([{"group": key[0], "block": f"{key[1]}-{key[2]}", "root": points[0].tolist(), "radius": float(levels[0][2][0]),
                              "ids": rows["rep"].to_numpy(np.int64).tobytes(), "weights": rows["weight"].to_numpy(np.int64).tobytes(),
                              "vectors": points.tobytes(), "tree": pack_levels(levels)}])

    return dealt.groupBy("group", "cell", "part").applyInPandas(
        grow, f"{kinds}, block string, root array<double>, radius double, ids binary, weights binary, vectors binary, tree array<binary>")


def compare(row: dict, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, links, root id) of the linked vectors of a pair of blocks."""
    side = lambda s: (np.frombuffer(row[f"ids{s}"], np.int64), np.frombuffer(row[f"weights{s}"], np.int64),
                      np.frombuffer(row[f"vectors{s}"], np.float64), unpack_levels(row[f"tree{s}"]))
    (ia, wa, va, ta), (ib, wb, vb, tb) = side("a"), side("b")
    linked = dual_traversal(va.reshape(len(ia), -1), ta, vb.reshape(len(ib), -1), tb, least)
    if row["same"]:
        np.fill_diagonal(linked, False)
    rows, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    linked = linked[np.ix_(rows, cols)]
    if row["same"]:
        root, _ = local_roots(linked | np.eye(len(rows), dtype=bool))
        return ia[rows], linked @ wb[cols], ia[rows][root]
    root_a, root_b = local_roots(linked)
    return (np.concatenate([ia[rows], ib[cols]]), np.concatenate([linked @ wb[cols], linked.T @ wa[rows]]),
            np.concatenate([ia[rows][root_a], ia[rows][root_b]]))


def near_vectors(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each vector.

    Vectors link if their labels are equal and not null and their cosine, in double precision, is at least ``least``.
    Vectors that are null, zero, or hold null or non-finite components, and those with a null label or vec_id, link with
    nothing; a null vec_id has a null component and is kept.  Equal vectors link with each other; rows that share a vec_id
    are one node.  Vectors of different length never link.  Other columns are ignored; an empty table gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    usable = sound(F.col("embedding")) & F.exists("embedding", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    fit = rows.where(usable).withColumn("group", F.struct("label", F.size("embedding").alias("length")))
    classes = written(fit.groupBy("group", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "covertree-classes")
    blocks = written(build_blocks(classes, least), "covertree-blocks")
    meta = blocks.select("group", "block", "root", "radius")
    pick = lambda s: meta.select("group", *[F.col(c).alias(c + s) for c in ("block", "root", "radius")])
    dot = F.aggregate(F.zip_with("roota", "rootb", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot))
    limit = float(np.sqrt(max(0.0, 2 - 2 * least)) + 1e-7)
    # pairs of blocks, not of vectors; the root's covering radius prunes whole pairs
    pairs = (pick("a").join(pick("b"), "group").where("blocka <= blockb").where(apart <= F.col("radiusa") + F.col("radiusb") + limit)
             .select("group", "blocka", "blockb", (F.col("blocka") == F.col("blockb")).alias("same")))
    load = lambda s: blocks.select("group", *[F.col(c).alias(c + s) for c in ("block", "ids", "weights", "vectors", "tree")])
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = pairs.repartition(n, "group", "blocka", "blockb").join(load("a"), ["group", "blocka"]).join(load("b"), ["group", "blockb"])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, links, root = compare(batch.slice(i, 1).to_pylist()[0], least)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links.astype(np.int64)), pa.array(root)], ["rep", "links", "root"])

    columns = ["same", *[c + s for s in "ab" for c in ("ids", "weights", "vectors", "tree")]]
    found = written(map_arrow(work.select(*columns), run, "rep long, links long, root long"), "covertree-links")
    component = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    per_class = (classes.join(counted, "rep", "left").join(component, F.col("rep") == F.col("node"), "left")
                 .select("group", "embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                         F.coalesce("component", "rep").alias("component_id")))
    linked = fit.join(per_class, ["group", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
