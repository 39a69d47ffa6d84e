"""Approximate nearest neighbours: a vantage-point tree per shard, searched by blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 8192, 2048, 64
#: 1 restores exact search; smaller values prune more.
PRUNING_FACTOR = 1.0


def build_tree(ids: np.ndarray, vectors: np.ndarray, copies: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """A vantage-point tree as arrays. Rows of a node are contiguous: the nearer half first.

    Inner products become distances by one more component, sqrt(M^2 - |x|^2) with M the largest
    norm, which is 0 for queries: |q - x|^2 = |q|^2 + M^2 - 2 q.x. A node is (vantage row, start,
    middle, stop, largest distance of the nearer half, least of the farther). Halves go by rank, so
    equal vectors cannot unbalance the tree. Components so large that squares overflow are scaled for the
    distances, by a power of two; scores are always of the vectors themselves.
    """
    original, scale = vectors, shrink(np.abs(vectors).max(initial=0.0))
    vectors = vectors if scale == 1 else vectors * scale
    norms = np.einsum("ij,ij->i", vectors, vectors)
    lifted = np.column_stack([vectors, np.sqrt(np.maximum(norms.max() - norms, 0))])
    order = np.argsort(ids, kind="stable")
    nodes, bounds, stack = [], [], [(0, len(ids))]
    pick = np.random.default_rng(0)
    while stack:
        start, stop = stack.pop()
        if stop - start <= LEAF_ROWS:
            continue
        vantage = order[start + pick.integers(stop - start)]
        away = np.sqrt(((lifted[order[start:stop]] - lifted[vantage]) ** 2).sum(axis=1))
        by = np.argsort(away, kind="stable")
        order[start:stop], away = order[start:stop][by], away[by]
        middle = (start + stop) // 2
        nodes.append((vantage, start, middle, stop))
        bounds.append((away[middle - start - 1], away[middle - start]))
        stack += [(start, middle), (middle, stop)]
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    nodes = np.array(nodes, np.int64).reshape(-1, 4)
    nodes[:, 0] = place[nodes[:, 0]] if len(nodes) else nodes[:, 0]
    copies = np.zeros(len(ids), np.int64) if copies is None else copies
    return {"ids": ids[order], "copies": copies[order], "scale": scale, "vectors": vectors[order], "original": original[order] if scale != 1 else None, "lift": lifted[order, -1], "nodes": nodes, "bounds": np.array(bounds).reshape(-1, 2)}


def shrink(largest: float) -> float:
    """The power of two that vectors with such a largest component are multiplied by before they are squared: 1 unless squares might overflow."""
    return 1.0 if largest < 2.0**400 else 2.0 ** -float(np.frexp(largest)[1])


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last, so that equal vectors score alike everywhere."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


class Search:
    """The k best rows of one tree for a block of queries; all queries that visit a node do so together."""

    def __init__(self, tree: dict[str, np.ndarray], ids: np.ndarray, queries: np.ndarray, k: int, factor: float, copies: np.ndarray | None = None):
        self.tree, self.ids, self.original, self.k, self.factor = tree, ids, queries, k, factor
        self.scale = shrink(np.abs(queries).max(initial=0.0))
        self.queries = queries = queries if self.scale == 1 else queries * self.scale
        self.copies = np.zeros(len(ids), np.int64) if copies is None else copies
        self.node = {(int(n[1]), int(n[3])): i for i, n in enumerate(tree["nodes"])}
        top = (tree["vectors"][:1] ** 2).sum() + tree["lift"][:1].sum() ** 2
        self.base = (queries**2).sum(axis=1) + top
        self.slack = 1e-7 * (1 + np.sqrt(self.base))
        self.best_score = np.full((len(ids), k), -np.inf)
        self.best_id = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.found = np.zeros((len(ids), k), bool)
        self.visit(0, len(tree["ids"]), np.arange(len(ids)))

    def reach(self, rows: np.ndarray) -> np.ndarray:
        """How far from its query a row that still counts may lie, relaxed by the factor."""
        worst = self.worst(rows)
        return np.where(np.isinf(worst), np.inf, self.factor * np.sqrt(np.maximum(self.base[rows] - 2 * np.where(np.isinf(worst), 0, worst), 0)) + self.slack[rows])

    def worst(self, rows: np.ndarray) -> np.ndarray:
        """The scores of the k-th best, scaled as the tree's are; where such a score is beyond doubles, nothing is known."""
        score = self.best_score[rows, -1]
        return score if self.scale * self.tree["scale"] == 1 else np.where(np.isfinite(score), score * self.scale * self.tree["scale"], -np.inf)

    def visit(self, start: int, stop: int, rows: np.ndarray) -> None:
        if not len(rows):
            return
        node = self.node.get((start, stop))
        if node is None:
            self.leaf(start, stop, rows)
            return
        vantage, _, middle, _ = self.tree["nodes"][node]
        near_most, far_least = self.tree["bounds"][node]
        score = self.queries[rows] @ self.tree["vectors"][vantage]
        away = np.sqrt(np.maximum(self.base[rows] - 2 * score, 0))
        nearer = away <= (near_most + far_least) / 2
        self.visit(start, middle, rows[nearer])
        self.visit(middle, stop, rows[~nearer])
        reach = self.reach(rows)
        self.visit(middle, stop, rows[nearer & (far_least - away <= reach)])
        self.visit(start, middle, rows[~nearer & (away - near_most <= reach)])

    def leaf(self, start: int, stop: int, rows: np.ndarray) -> None:
        vectors, ids, copies = (self.tree[x][start:stop] for x in ("vectors", "ids", "copies"))
        scores = self.queries[rows] @ vectors.T
        own = (ids[None, :] == self.ids[rows][:, None]) & (copies[None, :] == self.copies[rows][:, None])
        good = (scores >= (self.worst(rows) - self.slack[rows])[:, None]) & ~own
        q, x = np.nonzero(good)
        if not len(q):
            return
        changed = np.unique(q)
        exact = self.exact(rows[q], start + x)
        who = np.concatenate([rows[q], np.repeat(rows[changed], self.k)])
        score = np.concatenate([exact, self.best_score[rows[changed]].ravel()])
        found = np.concatenate([ids[x], self.best_id[rows[changed]].ravel()])
        real = np.concatenate([np.ones(len(x), bool), self.found[rows[changed]].ravel()])
        order = np.lexsort((found, -score, ~real, who))
        who, score, found, real = who[order], score[order], found[order], real[order]
        first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        rank = np.arange(len(who)) - np.repeat(first, np.diff(np.r_[first, len(who)]))
        keep = rank < self.k
        self.best_score[who[keep], rank[keep]] = score[keep]
        self.best_id[who[keep], rank[keep]] = found[keep]
        self.found[who[keep], rank[keep]] = real[keep]


    def exact(self, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Scores of the vectors themselves. A sum that meets infinities of both signs takes the sign of the scaled one."""
        own = self.tree["vectors"] if self.tree["original"] is None else self.tree["original"]
        with np.errstate(over="ignore", invalid="ignore"):
            score = inner(self.original[queries], own[rows])
        lost = np.isnan(score)
        if lost.any():
            score[lost] = np.sign(inner(self.queries[queries[lost]], self.tree["vectors"][rows[lost]])) * np.inf
        return np.where(np.isnan(score), 0.0, score)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, copy, vector (doubles), dim. Null ids, and vectors that are null, empty, zero or hold null or non-finite components, take no part; copy numbers rows that repeat an id."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda x: x != 0))
    return rows.withColumn("copy", F.row_number().over(Window.partitionBy("vec_id").orderBy("vector")).cast("long")).withColumn("dim", F.size("vector"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = PRUNING_FACTOR) -> DataFrame:
    """The k nearest of vectors for each of queries by inner product: query_id, rank, vec_id, score, query_copy.

    Both are as from usable. A query's own row is no candidate, other rows of its id are; ties go to the
    smaller id; only vectors of the query's length are candidates; with fewer than k all come back.
    Rows are dealt to shards of about SHARD_ROWS vectors. A task gets the vectors of a shard first,
    builds its tree once, and then the queries stream past it in blocks of BLOCK_ROWS: it holds one
    tree and one block whatever the tables' sizes. Empty tables give no rows.
    """
    shards = max(1, -(-vectors.count() // SHARD_ROWS))
    columns = ["dim", "shard", "vec_id", "copy", "vector"]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        tree, key = None, None
        for batch in batches:
            runs = (batch[["dim", "shard", "asks"]].diff() != 0).any(axis=1).cumsum()
            for _, run in batch.groupby(runs, sort=False):
                if (mine := (run.dim.iloc[0], run.shard.iloc[0])) != key:
                    held, tree, key = [], None, mine
                if not run.asks.iloc[0]:
                    held.append(run[["vec_id", "copy", "vector"]])
                    continue
                if held:
                    rows = pd.concat(held)
                    tree, held = build_tree(rows.vec_id.to_numpy(np.int64), np.stack(rows.vector.to_numpy()), rows["copy"].to_numpy(np.int64)), []
                for at in range(0, len(run) if tree else 0, BLOCK_ROWS):
                    some = run[at : at + BLOCK_ROWS]
                    ids, copies = some.vec_id.to_numpy(np.int64), some["copy"].to_numpy(np.int64)
                    found = Search(tree, ids, np.stack(some.vector.to_numpy()), k, factor, copies)
                    good = found.found
                    n = good.sum(axis=1)
                    yield pd.DataFrame({"query_id": np.repeat(ids, n), "query_copy": np.repeat(copies, n), "vec_id": found.best_id[good], "score": found.best_score[good]})

    own = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", "copy"), F.lit(shards)).cast("int")).select(*columns, F.lit(0).alias("asks"))
    asked = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select(*columns, F.lit(1).alias("asks"))
    dealt = own.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("dim", "shard", "asks")
    found = dealt.mapInPandas(search, "query_id long, query_copy long, vec_id long, score double")
    best = Window.partitionBy("query_id", "query_copy").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_copy")


#: Brute force, for the 20 nearest of every twentieth vector.
NEAREST_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x, row_number() OVER (PARTITION BY vec_id ORDER BY embedding::DOUBLE[]) AS copy FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, q.copy AS query_copy, c.vec_id, list_inner_product(q.x, c.x) AS score
  FROM v q JOIN v c ON (q.vec_id <> c.vec_id OR q.copy <> c.copy) AND len(q.x) = len(c.x) WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score, query_copy FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, query_copy ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored) WHERE rank <= 20
"""
