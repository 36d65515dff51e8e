"""Merkle manifest of a dataset: subtrees per partition value, authentication paths by fractal traversal.

Leaves are numbered within their tree by range-sorted positions and cut into
aligned blocks of ``FAN ** LEVELS`` leaves. The first pass hashes every block to
its root; the roots of the blocks are the leaves of the next layer, until one
node a tree remains, and the trees' roots form one last tree in the same way.
The second pass walks every block with a fractal traversal: for each level it
keeps the run that the current leaf's path goes through (the existing subtree)
and grows, one leaf a step, the run that the path enters next (the desired
one), so that successive authentication paths come out of a memory of a few
runs a level. What lies above a block is the same for all its leaves and is
appended to each path.

A block is the unit of work, so a tree that holds a third of all rows is as
many tasks as its size asks for, and no task or driver sees a tree whole.

Defined cases: nulls are written ``-``; leaves of equal id are ordered by their
digest, null ids come first; equal rows are leaves each; a null or empty text
is a leaf like any other; rows without an id are never tampered with; no rows
give an empty table. The operator reads the named columns only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace, enough

FAN = 8
LEVELS = 3
BLOCK = FAN**LEVELS
#: Characters of a digest in hexadecimal.
HEX = 64
#: Partial trees (one a tree and range of the sort) that are broadcast at most.
BROADCAST_ROWS = 20_000


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def framed(column: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    return F.sha2(F.concat(*(framed(c) for c in columns)), 256)


def height(leaves: int) -> int:
    """Levels of a tree: runs are hashed while more than one node remains."""
    levels = 0
    while leaves > 1:
        leaves = -(-leaves // FAN)
        levels += 1
    return levels


class Run:
    """One run of a level, grown from leaves; partial runs are closed at the end of the block."""

    def __init__(self, level: int):
        self.pending: list[list[str]] = [[] for _ in range(level + 1)]

    def add(self, leaf: str) -> None:
        at, node = 0, leaf
        while True:
            self.pending[at].append(node)
            if at == len(self.pending) - 1 or len(self.pending[at]) < FAN:
                return
            node = digest("".join(self.pending[at]))
            self.pending[at] = []
            at += 1

    def close(self) -> list[str]:
        """The nodes of the run's level."""
        for at in range(len(self.pending) - 1):
            if self.pending[at]:
                self.pending[at + 1].append(digest("".join(self.pending[at])))
                self.pending[at] = []
        return self.pending[-1]


def block_root(leaves: list[str], levels: int) -> str:
    run = Run(levels)
    for x in leaves:
        run.add(x)
    return run.close()[0]


def traverse(leaves: list[str], levels: int) -> Iterator[list[tuple[int, str]]]:
    """For each leaf in turn its path in the block: at every level its place in the run and the others, joined.

    Level k keeps its existing run and a desired one that takes the leaf
    ``FAN ** (k + 1)`` ahead of the current one at every step, so it is ready
    when the path enters it.
    """
    spans = [FAN ** (k + 1) for k in range(levels)]
    existing, desired = [], []
    for k, span in enumerate(spans):
        run = Run(k)
        for x in leaves[:span]:
            run.add(x)
        existing.append(run.close())
        desired.append(Run(k))
    for i in range(len(leaves)):
        path = []
        for k, span in enumerate(spans):
            if i and i % span == 0:
                existing[k], desired[k] = desired[k].close(), Run(k)
            place = i // (span // FAN) % FAN
            run = existing[k]
            path.append((place, "".join(run[:place] + run[place + 1:])))
            if i + span < len(leaves):
                desired[k].add(leaves[i + span])
        yield path


def fold(node: str, path) -> str:
    """The root that a node and its path lead to."""
    for place, others in path:
        node = digest(others[: HEX * place] + node + others[HEX * place:])
    return node


def levels_in_block(total: int) -> int:
    """Levels below a block's root: those of the whole tree if one block holds it."""
    return height(total) if total <= BLOCK else LEVELS


def numbered(ws: Workspace, name: str, rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Adds _tree (a number that orders the values of ``tree``), _total and _at, the place in the tree.

    Rows are range-sorted by tree, ``order`` and a number of their own, so a
    hot tree and even equal rows are spread; places follow from the counts of
    the ranges. Columns of ``rows`` must not begin with an underscore.
    """
    salted = ws.table(f"{name}-rows", rows.withColumn("_salt", F.monotonically_increasing_id()))
    keys = [tree, *order, "_salt"]
    parts = max(enough(salted, 1), salted.rdd.getNumPartitions())
    ranged = ws.table(f"{name}-sorted", salted.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_salt").withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33)
    counts = ranged.groupBy(F.col(tree).alias("_key"), part.alias("_part")).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_key")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ws.narrow_table(f"{name}-counts", counts.select("_key", "_part", "_first", F.min("_first").over(whole).alias("_tree"), F.sum("_n").over(whole).alias("_total"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    ws.drop(f"{name}-rows")
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts
    joined = ranged.join(counts, F.col(tree).eqNullSafe(F.col("_key")) & (part == F.col("_part")))
    return joined.select(*(c for c in ranged.columns if c != "_row"), "_tree", "_total", (F.col("_row") - F.col("_first") + F.col("_before")).alias("_at"))


#: Nodes of a layer: tree, number of the tree's nodes, place, digest.
NODES = "tree long, total long, at long, digest string"
PATH = "array<struct<place:int, others:string>>"


def roots_of(nodes: DataFrame) -> DataFrame:
    """The layer above: one node a block."""

    def run(key, group):
        group = group.sort_by("at")
        total = group["total"][0].as_py()
        root = block_root(group["digest"].to_pylist(), levels_in_block(total))
        return pa.table({"tree": [key[0].as_py()], "total": [-(-total // BLOCK)], "at": [key[1].as_py()], "digest": [root]})

    return nodes.groupBy("tree", F.floor(F.col("at") / BLOCK).alias("block")).applyInArrow(run, NODES)


def paths_of(nodes: DataFrame) -> DataFrame:
    """(tree, at, path) of the nodes of a layer, within their blocks."""

    def run(group):
        group = group.sort_by("at")
        paths = [[{"place": p, "others": o} for p, o in path] for path in traverse(group["digest"].to_pylist(), levels_in_block(group["total"][0].as_py()))]
        kind = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.string())]))
        return pa.table({"tree": group["tree"], "at": group["at"], "path": pa.array(paths, kind)})

    return nodes.groupBy("tree", F.floor(F.col("at") / BLOCK)).applyInArrow(run, f"tree long, at long, path {PATH}")


def climb(ws: Workspace, name: str, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From the blocks' roots of trees (NODES) to (tree, digest) of each tree and (tree, at, path) of each node to its tree's root."""
    layers = [nodes]
    while not layers[-1].filter("total > 1").isEmpty():
        layers.append(ws.narrow_table(f"{name}-{len(layers)}", roots_of(layers[-1].filter("total > 1"))))
    done = layers[0].filter("total = 1")
    for layer in layers[1:]:
        done = done.union(layer.filter("total = 1"))
    empty = F.array().cast(PATH)
    above = None
    for k in range(len(layers) - 1, -1, -1):
        several = paths_of(layers[k].filter("total > 1"))
        if above is not None:
            up = above.select(F.col("tree").alias("_tree"), F.col("at").alias("_block"), F.col("path").alias("_path"))
            several = several.join(up, (F.col("tree") == F.col("_tree")) & (F.floor(F.col("at") / BLOCK) == F.col("_block")), "left")
            several = several.select("tree", "at", F.concat("path", F.coalesce("_path", empty)).alias("path"))
        above = ws.table(f"{name}-paths-{k}", several.union(layers[k].filter("total = 1").select("tree", "at", empty.alias("path"))))
    return ws.narrow_table(f"{name}-done", done.select("tree", "digest")), above


def manifest(rows: DataFrame, ws: Workspace, *, tree_col: str, order_col: str, leaf_col: str, tampered_col: str) -> DataFrame:
    """Adds subroot, root, proof_sha256, folded_root and verified to rows of (tree, order, leaf, tampered leaf or null).

    ``proof_sha256`` is the digest of all siblings from the leaf up to the
    root; ``folded_root`` is what the tampered leaf, else the leaf itself, leads
    to with these siblings, and ``verified`` whether that is the root.
    """
    rows = rows.select(F.col(tree_col).alias("tree"), F.col(order_col).alias("id"), F.col(leaf_col).alias("leaf"), F.col(tampered_col).alias("tampered"))
    rows = ws.table("leaves", numbered(ws, "leaf", rows, "tree", ["id", "leaf"]).select("id", "leaf", "tampered", F.col("_tree").alias("tree"), F.col("_total").alias("total"), F.col("_at").alias("at")))
    blocks = ws.table("blocks", roots_of(rows.select("tree", "total", "at", F.col("leaf").alias("digest"))))
    subroots, to_subroot = climb(ws, "tree", blocks)
    top = numbered(ws, "top", subroots.withColumn("one", F.lit(0)), "one", ["tree"])
    top = ws.narrow_table("top", top.select(F.col("_tree").alias("tree"), F.col("_total").alias("total"), F.col("_at").alias("at"), "digest", F.col("tree").alias("named")))
    top_blocks = ws.table("top-blocks", roots_of(top.select("tree", "total", "at", "digest")))
    root, to_root = climb(ws, "root", top_blocks)
    # a tree's path to the root: within the block of subroots, then above it
    named = paths_of(top.select("tree", "total", "at", "digest")).join(top.select("tree", "at", "named", "digest"), ["tree", "at"])
    above = to_root.select(F.col("tree").alias("_tree"), F.col("at").alias("_block"), F.col("path").alias("_path"))
    named = named.join(above, (F.col("tree") == F.col("_tree")) & (F.floor(F.col("at") / BLOCK) == F.col("_block")))
    named = named.select(F.col("named").alias("_named"), F.col("digest").alias("subroot"), F.concat("path", "_path").alias("_up"), F.col("tree").alias("_top"))
    named = named.join(F.broadcast(root.select(F.col("tree").alias("_root"), F.col("digest").alias("root"))), F.col("_top") == F.col("_root"))  # one row
    upper = to_subroot.join(named, F.col("tree") == F.col("_named")).select("tree", F.col("at").alias("block"), F.concat("path", "_up").alias("path"), "subroot", "root")
    upper = ws.table("upper", upper)

    def run(group, above):
        group = group.sort_by("at")
        leaves, tampered = group["leaf"].to_pylist(), group["tampered"].to_pylist()
        subroot, root = above["subroot"][0].as_py(), above["root"][0].as_py()
        rest = [(x["place"], x["others"]) for x in above["path"][0].as_py()]
        tail = "".join(o for _, o in rest)
        proofs, folded = [], []
        for own, other, path in zip(leaves, tampered, traverse(leaves, levels_in_block(group["total"][0].as_py())), strict=True):
            proofs.append(digest("".join(o for _, o in path) + tail))
            folded.append(fold(fold(own if other is None else other, path), rest))
        n = len(leaves)
        return pa.table({"id": group["id"], "leaf": group["leaf"], "subroot": [subroot] * n, "root": [root] * n, "proof_sha256": proofs, "folded_root": folded, "verified": [x == root for x in folded]})

    kind = rows.schema["id"].dataType.simpleString()
    joined = rows.withColumn("block", F.floor(F.col("at") / BLOCK)).groupBy("tree", "block").cogroup(upper.groupBy("tree", "block"))
    return joined.applyInArrow(run, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
