"""Nearest neighbours by inner product: vantage-point trees, one for each shard of the vectors.

A tree needs a metric. With M the largest norm in a shard, a vector x becomes (x, sqrt(M^2 - |x|^2)) and a query
q becomes (q, 0): then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the nearest in this Euclidean space are those with the
largest inner product, for vectors of any norm.

Every inner node has a vantage point, the median distance to it parts the points into two children, and
each child keeps the least and the largest distance of its points. A query at distance d from the vantage
point has no point of a child nearer than max(d - largest, least - d). It leaves the child out if `factor` times that
bound is beyond its k-th best distance so far; factor 1 is exact, more prunes more. Equal vectors of a shard are one
point with all their ids, so a vector that a third of all rows share is one point a shard.

Queries visit a tree in blocks. First each goes down to the one leaf that it falls into, which gives its first
k-th best; then the tree is walked once, and at every node only the queries that can't leave it out go on.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Vectors in a shard and queries in a block, at most about so many: a task holds one of each.
SHARD_ROWS = 16_384
BLOCK_ROWS = 2_048
#: Points in a leaf of a tree.
LEAF_POINTS = 128
#: Rounding of matrix products and of norms: what is this close to the bound is scored again term by term.
_SLACK = 1e-9
#: Pairs of a query and a point that are scored at once.
_PAIRS = 1 << 16
#: No id: larger than any.
_NONE = np.iinfo(np.int64).max


class Tree:
    """points: (n, d) distinct vectors; ids: for each of them its ascending ids."""

    def __init__(self, points: np.ndarray, ids: list[np.ndarray], leaf: int = LEAF_POINTS):
        square = np.einsum("ij,ij->i", points, points)
        self.reach = float(square.max())
        lifted = np.hstack([points, np.sqrt(np.maximum(self.reach - square, 0.0))[:, None]])
        self.nodes: list[tuple] = []
        order = self._grow(lifted, np.arange(len(points)), leaf, np.random.default_rng(7))
        at = np.concatenate(order)
        self.points = points[at]
        self.ids = np.concatenate([ids[i] for i in at])
        self.ends = np.cumsum([len(ids[i]) for i in at])

    def _grow(self, lifted: np.ndarray, at: np.ndarray, leaf: int, rng: np.random.Generator) -> list[np.ndarray]:
        """Nodes in depth-first order: (lo, hi, vantage or None, bounds of the two children, second child)."""
        todo, order, filled = [(at, None)], [], 0
        while todo:
            rows, parent = todo.pop()
            here = len(self.nodes)
            if parent is not None:
                self.nodes[parent][4] = here
            if len(rows) <= leaf:
                self.nodes.append([filled, filled + len(rows), None, None, None])
                order.append(rows)
                filled += len(rows)
                continue
            vantage = self._vantage(lifted, rows, rng)
            d = np.sqrt(np.maximum(((lifted[rows] - vantage) ** 2).sum(1), 0.0))
            half = len(rows) // 2
            by = np.argpartition(d, half)
            near, far = by[:half], by[half:]
            bounds = [(d[x].min(), d[x].max()) for x in (near, far)]
            self.nodes.append([filled, filled + len(rows), vantage, bounds, None])
            todo += [(rows[far], here), (rows[near], None)]
        return order

    @staticmethod
    def _vantage(lifted: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Of a few candidates the one whose distances spread most."""
        tried = lifted[rng.choice(rows, min(8, len(rows)), replace=False)]
        seen = lifted[rng.choice(rows, min(128, len(rows)), replace=False)]
        spread = [np.sqrt(np.maximum(((seen - v) ** 2).sum(1), 0.0)).var() for v in tried]
        return tried[int(np.argmax(spread))]

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Arrays (queries, k): the best ids other than the query's own, ties to smaller ids, and their scores; where there
        are fewer, the rest of a row is (_NONE, -inf)."""
        q = len(queries)
        norm = np.einsum("ij,ij->i", queries, queries)
        best_id, best = np.full((q, k), _NONE), np.full((q, k), -np.inf)
        slack = _SLACK * (1.0 + np.sqrt(norm * self.reach))

        def take(rows: np.ndarray, lo: int, hi: int) -> None:
            """The points from lo to hi join the best of these queries."""
            block, step = self.points[lo:hi], max(1, _PAIRS // (hi - lo))
            for part in (rows[i : i + step] for i in range(0, len(rows), step)):
                i, c = np.nonzero((queries[part] @ block.T) >= (best[part, -1] - slack[part])[:, None])
                if not len(i):
                    continue
                # summed from left to right, so that equal vectors have equal scores wherever they lie
                score = np.cumsum(queries[part[i]] * block[c], axis=1)[:, -1]
                # of equal vectors only the k smallest ids other than the query's own can be among its k best
                begin = np.where(c + lo > 0, self.ends[c + lo - 1], 0)
                count = np.minimum(self.ends[c + lo] - begin, k + 1)
                new = self.ids[np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())]
                i, score = np.repeat(part[i], count), np.repeat(score, count)
                others = new != own[i]
                merge(i[others], new[others], score[others])

        def merge(i: np.ndarray, new: np.ndarray, score: np.ndarray) -> None:
            met = np.unique(i)
            i = np.concatenate([np.repeat(met, k), i])
            new, score = np.concatenate([best_id[met].ravel(), new]), np.concatenate([best[met].ravel(), score])
            order = np.lexsort((new, -score, i))
            i, new, score = i[order], new[order], score[order]
            at = np.arange(len(i)) - np.searchsorted(i, i)
            best_id[i[at < k], at[at < k]], best[i[at < k], at[at < k]] = new[at < k], score[at < k]

        def distance(rows: np.ndarray, vantage: np.ndarray) -> np.ndarray:
            return np.sqrt(((queries[rows] - vantage[:-1]) ** 2).sum(1) + vantage[-1] ** 2)

        seen = self._descend(q, distance, take)
        todo = [(0, np.arange(q), np.zeros(q))]
        while todo:
            here, rows, bound = todo.pop()
            # |q' - x'|^2 = |q|^2 + M^2 - 2 score
            reach = np.sqrt(np.maximum(norm[rows] + self.reach - 2 * (best[rows, -1] - slack[rows]), 0.0))
            go = factor * bound <= reach + _SLACK * (1 + reach)
            rows, bound = rows[go], bound[go]
            if not len(rows):
                continue
            lo, hi, vantage, bounds, second = self.nodes[here]
            if vantage is None:
                fresh = rows[seen[rows] != here]
                if len(fresh):
                    take(fresh, lo, hi)
                continue
            d = distance(rows, vantage)
            for child, (least, most) in ((second, bounds[1]), (here + 1, bounds[0])):
                todo.append((child, rows, np.maximum(bound, np.maximum(d - most, least - d))))
        return best_id, best

    def _descend(self, q: int, distance, take) -> np.ndarray:
        """The leaf that each query falls into, with its points taken."""
        seen, todo = np.zeros(q, np.int64), [(0, np.arange(q))]
        while todo:
            here, rows = todo.pop()
            if not len(rows):
                continue
            lo, hi, vantage, bounds, second = self.nodes[here]
            if vantage is None:
                seen[rows] = here
                take(rows, lo, hi)
                continue
            inner = distance(rows, vantage) <= (bounds[0][1] + bounds[1][0]) / 2
            todo += [(here + 1, rows[inner]), (second, rows[~inner])]
        return seen


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, dims, vec) of the rows that take part: an id, and a vector of finite components that aren't all zero."""
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    out = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), vec.alias("vec")).filter(F.col("id").isNotNull() & F.col("vec").isNotNull())
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    return out.filter(F.coalesce(sound, F.lit(False)) & F.exists("vec", lambda x: x != 0)).withColumn("dims", F.size("vec"))


def _shard(n: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(n)).cast("int")


def _merged(pdf: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct vectors and for each of them its ascending ids."""
    vecs = np.vstack(pdf["vec"].to_numpy()).astype(np.float64) + 0.0  # -0.0 becomes 0.0
    raw = np.ascontiguousarray(vecs).view(np.dtype((np.void, vecs.shape[1] * 8))).ravel()
    _, first, inverse = np.unique(raw, return_index=True, return_inverse=True)
    ids = pdf["id"].to_numpy(np.int64)
    order = np.lexsort((ids, inverse))
    groups = np.split(ids[order], np.flatnonzero(np.diff(inverse[order])) + 1)
    return vecs[first], [np.unique(g) for g in groups]


def build_index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row a shard and length of vectors, as a written table: dims, shard, shards, points, rows, tree (pickled).

    Every usable row is in it; rows are dealt to shards by a hash of their id.
    """
    rows = usable(vectors, id_col, vec_col)
    shards = max(1, -(-rows.count() // shard_rows))

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        points, ids = _merged(pdf)
        tree = pickle.dumps(Tree(points, ids), protocol=5)
        return pd.DataFrame({"dims": [key[0]], "shard": [key[1]], "shards": [shards], "points": [len(points)], "rows": [len(pdf)], "tree": [tree]})

    dealt = rows.withColumn("shard", _shard(shards)).groupBy("dims", "shard")
    return cut(dealt.applyInPandas(grow, "dims int, shard int, shards int, points bigint, rows bigint, tree binary"), "vantage")


def search(index: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products with each query, ties to the smaller vec_id.

    factor 1 finds the true k; a larger one leaves out more of a tree. A query's own id is never among its results, nor
    are vectors of another length. Vectors that are null, zero or hold a null or non-finite component take no part, nor do rows
    without an id. Rows that repeat a vec_id count as one where their vectors are equal too; a repeated query is
    answered once for each distinct vector of its id, in ranks of its own. A query with fewer than k others gets them all; empty
    tables give an empty result. Other columns are ignored, whatever their names. Queries meet shards in blocks, a
    shard's tree and a block at a time.
    """
    asked = usable(queries, id_col, vec_col).dropDuplicates(["id", "vec"])
    asked = cut(asked.withColumn("variant", F.xxhash64("vec")), "queries")
    blocks = max(1, -(-asked.count() // BLOCK_ROWS))
    shards = (index.agg(F.max("shards")).first() or [None])[0] or 1
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)).cast("int"))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        held = pickle.dumps((pdf["id"].to_numpy(np.int64), pdf["variant"].to_numpy(np.int64), np.vstack(pdf["vec"].to_numpy())), protocol=5)
        return pd.DataFrame({"dims": [key[0]], "block": [key[1]], "asked": [held]})

    packed = asked.groupBy("dims", "block").applyInPandas(pack, "dims int, block int, asked binary")
    packed = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    trees = index.select("dims", "shard", "tree").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["dims", "shard", "block"]

    def visit(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "variant": [], "vec_id": [], "score": []})
        own, variant, vecs = pickle.loads(right["asked"].iloc[0])
        ids, scores = pickle.loads(left["tree"].iloc[0]).search(own, vecs, k, factor)
        i, j = np.nonzero(scores > -np.inf)
        return pd.DataFrame({"query_id": own[i], "variant": variant[i], "vec_id": ids[i, j], "score": scores[i, j]})

    near = trees.groupBy(*keys).cogroup(packed.groupBy(*keys)).applyInPandas(visit, "query_id bigint, variant bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id", "variant").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, every: int = 20, k: int = 20, factor: float = 1.0, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """search() with the rows whose id `every` divides as queries, against all rows of the same table."""
    index = build_index(vectors, id_col, vec_col, shard_rows)
    return search(index, vectors.filter(F.col(f"`{id_col}`") % every == 0), k, factor, id_col, vec_col)
