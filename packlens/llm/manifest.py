"""Merkle manifest of a data set: one tree a group of rows, and one tree over the groups' roots.

Hashes are hex sha256; an inner node is the hash of its children's hex digests, up to `arity` of them. Every tree
is cut into aligned blocks of `height` levels, from the leaves up. A block is built by one task from at most
arity^height digests and stored as one row: its nodes in van Emde Boas order, that is the tree split at half
its height, the upper part first and then each lower part, every part laid out in the same way. Where a node
lies is arithmetic on its depth and index (`address`), so construction and the look-up of siblings read the
same array and no pointers, at any block or page size. Block roots are the leaves of the next round.

Proofs go the other way: from the top block down, each block hands the siblings on the path above it to its children, once
a block and not once a row, and the lowest blocks finish the proofs of their rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, cut, maybe_broadcast
from .ranked import sorted_parts

ARITY = 16
#: Levels of a block above its leaves: at most 16^3 = 4,096 digests meet in one task.
HEIGHT = 3
DIGEST = 32


# ---- the layout of one block


def nodes_in(levels: int, arity: int) -> int:
    """Nodes of a full tree with so many levels."""
    return sum(arity**d for d in range(levels))


def address(levels: int, depth: int, index: np.ndarray, arity: int = ARITY) -> np.ndarray:
    """Places, in the van Emde Boas order of a full tree of `levels` levels, of the nodes `index` at `depth` (the root's is 0)."""
    if levels == 1:
        return np.zeros_like(index)
    upper = levels // 2
    if depth < upper:
        return address(upper, depth, index, arity)
    lower, below = levels - upper, arity ** (depth - upper)
    return nodes_in(upper, arity) + index // below * nodes_in(lower, arity) + address(lower, depth - upper, index % below, arity)


@cache
def _places(levels: int, arity: int) -> list[np.ndarray]:
    return [address(levels, d, np.arange(arity**d), arity) for d in range(levels)]


def levels_for(leaves: int, height: int, arity: int) -> int:
    """Levels of the blocks over so many leaves: full height if there are more than fit into one block."""
    levels = 1
    while arity ** (levels - 1) < leaves and levels <= height:
        levels += 1
    return levels


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def lay_out(leaves: list[str], levels: int, arity: int) -> bytes:
    """The nodes of one block, missing ones zero."""
    out = np.zeros((nodes_in(levels, arity), DIGEST), np.uint8)
    row = leaves
    for depth in range(levels - 1, -1, -1):
        out[_places(levels, arity)[depth][: len(row)]] = np.frombuffer(bytes.fromhex("".join(row)), np.uint8).reshape(-1, DIGEST)
        row = [_h("".join(row[i : i + arity])) for i in range(0, len(row), arity)]
    return out.tobytes()


class Block:
    """Read access to a stored block of `leaves` leaves."""

    def __init__(self, nodes: bytes, leaves: int, levels: int, arity: int):
        self.nodes, self.levels, self.arity = nodes, levels, arity
        self.width = [leaves]
        while len(self.width) < levels:
            self.width.insert(0, -(-self.width[0] // arity))

    def run(self, depth: int, first: int) -> list[str]:
        """Digests of up to arity siblings from index `first` on."""
        at = _places(self.levels, self.arity)[depth][first : min(first + self.arity, self.width[depth])]
        return [self.nodes[p * DIGEST : (p + 1) * DIGEST].hex() for p in at]

    def paths(self) -> list[tuple[list[str], list[str]]]:
        """For each leaf the siblings to its left and to its right, joined, from its level up."""
        out: list[tuple[list[str], list[str]]] = [([], [])]
        for depth in range(1, self.levels):
            below = []
            for parent, (left, right) in enumerate(out):
                run = self.run(depth, parent * self.arity)
                below += [(["".join(run[:i]), *left], ["".join(run[i + 1 :]), *right]) for i in range(len(run))]
            out = below
        return out


# ---- blocks of a whole forest


@dataclass
class Forest:
    """rounds: tables of blocks (tree, block, size, leaves, nodes), the lowest first: size is the number of nodes of the tree on
    the block's lowest level. roots: (tree, root)."""

    rounds: list[DataFrame]
    roots: DataFrame
    arity: int
    height: int


def build(leaves: DataFrame, most: int, label: str, arity: int = ARITY, height: int = HEIGHT) -> Forest:
    """Trees over leaves (tree, pos, size, digest): pos counts from 0 in each tree, size is its number of leaves and most
    the largest size."""
    span = arity**height
    rounds, tops = [], []
    while True:

        def stack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            size, row = int(pdf["size"].iloc[0]), pdf.sort_values("pos")["digest"].tolist()
            return pd.DataFrame({"tree": [key[0]], "block": [key[1]], "size": [size], "leaves": [len(row)], "nodes": [lay_out(row, levels_for(size, height, arity), arity)]})

        keyed = leaves.withColumn("block", F.floor(F.col("pos") / span))
        blocks = keyed.groupBy("tree", "block").applyInPandas(stack, "tree string, block bigint, size bigint, leaves bigint, nodes binary")
        blocks = cut(blocks, f"{label}-{len(rounds)}")
        rounds.append(blocks)
        # the root of a block is the first of its nodes
        up = blocks.select("tree", F.col("block").alias("pos"), F.ceil(F.col("size") / span).alias("size"), F.lower(F.hex(F.substring("nodes", 1, DIGEST))).alias("digest"))
        tops.append(up.filter("size = 1").select("tree", F.col("digest").alias("root")))
        if most <= span:
            return Forest(rounds, reduce(DataFrame.unionByName, tops), arity, height)
        leaves, most = up.filter("size > 1"), -(-most // span)


def paths_down(forest: Forest, above: DataFrame, label: str) -> DataFrame:
    """(tree, block, lefts, rights) for the lowest blocks: what stands left and right of the path on each level above
    them, from above (tree, lefts, rights) for the trees' roots."""
    arity, height, span = forest.arity, forest.height, forest.arity**forest.height
    handed = None
    for level in range(len(forest.rounds) - 1, -1, -1):
        blocks = forest.rounds[level]
        # columns of their own, as the blocks meet themselves below
        own = blocks.filter(F.col("size") <= span).select(F.col("tree").alias("t"), F.col("block").alias("b")).toDF("tree", "block").join(above, "tree")
        here = own if handed is None else own.unionByName(handed)
        if level == 0:
            return cut(here, f"{label}-paths")

        def hand_on(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = []
            for b, up in zip(left.itertuples(), right.itertuples(), strict=False):
                for i, (lo, hi) in enumerate(Block(b.nodes, b.leaves, levels_for(b.size, height, arity), arity).paths()):
                    out.append((b.tree, b.block * span + i, [*lo, *up.lefts], [*hi, *up.rights]))
            return pd.DataFrame(out, columns=["tree", "block", "lefts", "rights"])

        met = blocks.groupBy("tree", "block").cogroup(here.groupBy("tree", "block"))
        handed = cut(met.applyInPandas(hand_on, "tree string, block bigint, lefts array<string>, rights array<string>"), f"{label}-{level}")
    raise AssertionError("a forest has at least one round")


def fold(digest: str, lefts: list[str], rights: list[str]) -> str:
    """The root above a digest with these siblings."""
    for a, b in zip(lefts, rights, strict=True):
        digest = _h(a + digest + b)
    return digest


# ---- data sets


def field(c: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)).cast("binary"), 256)


def placed(rows: DataFrame, order: list[str], label: str) -> tuple[DataFrame, int]:
    """rows with pos (from 0, in their tree by `order`) and size (of the tree), and the largest size."""
    parts = sorted_parts(rows, [F.col("tree"), *[F.col(c).asc_nulls_first() for c in order]], label)
    runs = parts.groupBy("tree", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    by = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = cut(runs.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(by).alias("size")), f"{label}-runs")
    most = runs.agg(F.max("size")).first()[0] or 0
    out = parts.join(maybe_broadcast(runs, runs.count()), ["tree", "part"])
    return out.select(*rows.columns, (F.col("row") + F.col("shift")).alias("pos"), "size"), most


def manifest(
    docs: DataFrame,
    columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id",
    group_col: str = "source",
    text_col: str = "text",
    tampered: Column | None = None,
    arity: int = ARITY,
    height: int = HEIGHT,
) -> DataFrame:
    """One row a row of docs: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves are hashes of `columns`; those of a group ascend by id and make its tree, whose root is subroot; subroots
    ordered by group (null first, then by UTF-8 bytes) make the tree of root. proof_sha256 is the hash of all siblings on
    the way up, folded_root is what they and the row's leaf give, and verified says whether that is root. Where
    `tampered` is true, the leaf to fold is that of the text with A-Z lower-cased.

    Null columns are leaves' `-`; null ids come first in their group, rows with equal ids follow by leaf, and equal rows are
    leaves of their own. Empty and very long texts are hashed whole. Other columns are ignored, whatever their
    names. An empty table gives an empty result. A task holds at most arity^height digests, whatever the size of a group.
    """
    at = [F.col(f"`{c}`") for c in columns]
    changed = [ascii_lower(c) if name == text_col else c for name, c in zip(columns, at, strict=True)]
    changed = F.when(F.coalesce(tampered, F.lit(False)), leaf(changed)) if tampered is not None else F.lit(None).cast("string")
    # null first and all others by their bytes
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit(""))
    leaves = cut(docs.select(tree.alias("tree"), F.col(f"`{id_col}`").alias("id"), leaf(at).alias("digest"), changed.alias("changed")), "leaves")
    rows, most = placed(leaves, ["id", "digest"], "leaves-sorted")
    if most == 0:
        return rows.select(F.col("id").alias(id_col), *[F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], F.lit(True).alias("verified"))
    rows = cut(rows, "leaves-placed")
    groups = build(rows.select("tree", "pos", "size", "digest"), most, "groups", arity, height)

    subroots = groups.roots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("digest"))
    subroots, n = placed(subroots, ["of"], "subroots")
    subroots = cut(subroots, "subroots-placed")
    whole = build(subroots.drop("of"), n, "whole", arity, height)
    top = whole.roots.first()["root"]
    nothing = F.array().cast("array<string>")
    over = paths_down(whole, whole.roots.select("tree", nothing.alias("lefts"), nothing.alias("rights")), "whole")
    ends = _finish(whole, subroots.select("tree", "pos", "digest", F.col("of").alias("id")), over, "id string, lefts array<string>, rights array<string>", _paths)
    above = cut(ends.withColumnRenamed("id", "tree"), "above")

    down = paths_down(groups, above, "groups").join(groups.roots, "tree")
    kind = docs.schema[id_col].dataType.simpleString()
    served = _finish(groups, rows, down, f"id {kind}, digest string, subroot string, proof string, folded string", _proofs)
    return served.select(
        F.col("id").alias(id_col),
        F.col("digest").alias("leaf"),
        "subroot",
        F.lit(top).alias("root"),
        F.col("proof").alias("proof_sha256"),
        F.col("folded").alias("folded_root"),
        (F.col("folded") == top).alias("verified"),
    )


def _paths(own: pd.DataFrame, lefts: list[list[str]], rights: list[list[str]], up) -> pd.DataFrame:
    return pd.DataFrame({"id": own["id"], "lefts": lefts, "rights": rights})


def _proofs(own: pd.DataFrame, lefts: list[list[str]], rights: list[list[str]], up) -> pd.DataFrame:
    proof = [_h("".join(a + b for a, b in zip(x, y, strict=True))) for x, y in zip(lefts, rights, strict=True)]
    start = own["changed"].where(own["changed"].notna(), own["digest"])
    folded = [fold(d, x, y) for d, x, y in zip(start, lefts, rights, strict=True)]
    return pd.DataFrame({"id": own["id"], "digest": own["digest"], "subroot": up.root, "proof": proof, "folded": folded})


def _finish(forest: Forest, rows: DataFrame, over: DataFrame, schema: str, make) -> DataFrame:
    """make(rows of a lowest block, lefts and rights of each, the block's row of `over`), block by block."""
    arity, height, span = forest.arity, forest.height, forest.arity**forest.height
    keys = ["tree", "block"]
    blocks = forest.rounds[0].join(over, keys)

    def serve(_: tuple, own: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        b = next(at.itertuples())
        own = own.sort_values("pos")
        ways = Block(b.nodes, b.leaves, levels_for(b.size, height, arity), arity).paths()
        return make(own, [[*lo, *b.lefts] for lo, _ in ways], [[*hi, *b.rights] for _, hi in ways], b)

    keyed = rows.withColumn("block", F.floor(F.col("pos") / span))
    return keyed.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInPandas(serve, schema)
