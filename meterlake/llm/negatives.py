"""Hard negatives by inner product, with candidates discarded early on the leading principal components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterlake.llm.common import materialize

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: A negative's score is between LOW / 100 and HIGH / 100 of its positive's.
LOW, HIGH = 80, 100
SHARD_ROWS, BLOCK_ROWS, ANCHOR_ROWS, PAIRS = 16_384, 1024, 512, 1 << 16
#: Shares of the components after which candidates are discarded.
STAGES = (0.125, 0.375)
#: Squared lengths below this keep every product, and a hundred times it, a whole 64-bit number, and one of doubles exact.
LONGEST = 2.0**52


def usable(embeddings: DataFrame) -> DataFrame:
    """uid, vec_id, label, vector (whole numbers), dim: the rows that take part, written once so that uid stays.

    Rows with a null label, a null vector, or a null or non-finite component take no part, and neither
    do vectors of a length of 2^26 or more after scaling, whose scores may not fit 64 bits. Null ids do: they
    come last among ties and are no anchors. uid tells rows that repeat an id, or are equal, apart.
    """
    whole = F.transform(F.col("embedding"), lambda x: F.floor(x.cast("double") * SCALE))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < 2.0**44))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    rows = embeddings.where(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))).select("vec_id", moved.alias("label"), whole.alias("vector"))
    return materialize(rows.where(square < LONGEST).select(F.monotonically_increasing_id().alias("uid"), "vec_id", "label", "vector", F.size("vector").alias("dim")), "vectors")


def rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors the orthogonal matrix of their principal axes, leading ones first.

    Second moments are sums over all rows: each task adds up its own, and a row of the sum per length and
    axis comes to the driver, as many numbers as the matrices have that go back.
    """

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, some in batch.groupby("dim"):
                if dim:
                    x = np.stack(some.vector.to_numpy()).astype(np.float64)
                    sums[dim] = sums.get(dim, 0) + x.T @ x
        for dim, total in sums.items():
            yield pd.DataFrame({"dim": dim, "axis": np.arange(dim), "part": list(total)})

    parts = rows.select("dim", "vector").mapInPandas(moments, "dim int, axis int, part array<double>").select("dim", "axis", F.posexplode("part").alias("other", "x"))
    total = parts.groupBy("dim", "axis", "other").agg(F.sum("x").alias("x")).groupBy("dim", "axis").agg(F.sort_array(F.collect_list(F.struct("other", "x"))).x.alias("xs"))
    found: dict[int, np.ndarray] = {}
    for r in total.collect():
        found.setdefault(r.dim, np.zeros((r.dim, r.dim)))[r.axis] = r.xs
    return {dim: np.linalg.eigh((m + m.T) / 2)[1][:, ::-1] for dim, m in found.items()}


class Rows:
    """Vectors of one length: whole numbers, rotated ones, and how long the rest is after each stage."""

    def __init__(self, frame: pd.DataFrame, rotation: np.ndarray | None, dim: int):
        self.uid, self.id, self.none, self.label = (frame[c].to_numpy() for c in ("uid", "id", "none", "label"))
        self.vectors = np.stack(frame.vector.to_numpy()).astype(np.int64).reshape(len(frame), dim)
        self.turned = self.vectors.astype(np.float64) @ (np.eye(dim) if rotation is None else rotation)
        self.stops = sorted({max(1, round(dim * s)) for s in STAGES} - {0}) if dim else []
        tail = np.sqrt(np.maximum(np.cumsum(self.turned[:, ::-1] ** 2, axis=1)[:, ::-1], 0))
        self.length = tail[:, 0] if dim else np.zeros(len(frame))
        self.rest = [tail[:, m] if m < dim else np.zeros(len(frame)) for m in self.stops]


class Best:
    """The k best of each query: by score, then id (null last)."""

    def __init__(self, queries: int, k: int):
        self.score = np.full((queries, k), np.iinfo(np.int64).min)
        self.id, self.none, self.full = np.zeros((queries, k), np.int64), np.ones((queries, k), bool), np.zeros((queries, k), bool)

    def add(self, who: np.ndarray, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        if not len(who):
            return
        k, changed = self.score.shape[1], np.unique(who)
        old = self.full[changed]
        who = np.concatenate([who, np.repeat(changed, k)[old.ravel()]])
        score, ids, none = (np.concatenate([new, kept[changed][old]]) for new, kept in ((score, self.score), (ids, self.id), (none, self.none)))
        order = np.lexsort((ids, none, -score, who))
        who, score, ids, none = who[order], score[order], ids[order], none[order]
        first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        rank = np.arange(len(who)) - np.repeat(first, np.diff(np.r_[first, len(who)]))
        keep = rank < k
        for kept, new in ((self.score, score), (self.id, ids), (self.none, none), (self.full, True)):
            kept[who[keep], rank[keep]] = new if new is True else new[keep]


def survivors(anchors: Rows, rows: Rows, part: slice, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, row, score) of the wanted pairs whose product lies in an anchor's [low, high].

    Products of the leading components come first. What the rest can add or take is at most the product of
    the rests' lengths, and slack for rounding; pairs whose bounds miss [low, high] are discarded, stage by
    stage. Those that stay are verified with products of whole numbers.
    """
    slack = 1e-6 + 1e-10 * anchors.length[:, None] * rows.length[part][None, :]
    done, known, alive = 0, np.zeros(wanted.shape), wanted
    pairs: tuple[np.ndarray, np.ndarray] | None = None
    for stop, mine, theirs in zip(rows.stops, anchors.rest, rows.rest):
        if pairs is None:
            known += anchors.turned[:, done:stop] @ rows.turned[part, done:stop].T
            room = mine[:, None] * theirs[part][None, :] + slack
            alive = alive & (known + room >= low[:, None]) & (known - room <= high[:, None])
            if alive.sum() * 8 < alive.size:
                pairs = np.nonzero(alive)
        else:
            q, x = pairs
            known[q, x] += np.einsum("ij,ij->i", anchors.turned[q, done:stop], rows.turned[part][x, done:stop])
            room = mine[q] * theirs[part][x] + slack[q, x]
            stay = (known[q, x] + room >= low[q]) & (known[q, x] - room <= high[q])
            pairs = q[stay], x[stay]
        done = stop
    q, x = np.nonzero(alive) if pairs is None else pairs
    vectors = rows.vectors[part]
    for at in range(0, len(q), PAIRS):
        some, other = q[at : at + PAIRS], x[at : at + PAIRS]
        score = np.einsum("ij,ij->i", anchors.vectors[some], vectors[other])
        stay = (score >= low[some]) & (score <= high[some])
        yield some[stay], other[stay] + part.start, score[stay]


def positives_of(anchors: Rows, rows: Rows, best: Best) -> None:
    """Adds to best the rows of an anchor's label, its own row left out."""
    for start in range(0, len(rows.uid), BLOCK_ROWS):
        part = slice(start, start + BLOCK_ROWS)
        wanted = (anchors.label[:, None] == rows.label[part][None, :]) & (anchors.uid[:, None] != rows.uid[part][None, :])
        low = np.where(best.full[:, -1], best.score[:, -1].astype(np.float64), -np.inf)
        for q, x, score in survivors(anchors, rows, part, wanted, low, np.full(len(low), np.inf)):
            best.add(q, score, rows.id[x], rows.none[x])


def negatives_of(anchors: Rows, positive: np.ndarray, given: np.ndarray, rows: Rows, best: Best) -> None:
    """Adds to best, whose queries are anchors times positives, the rows of other labels in the range of each positive's score."""
    count = positive.shape[1]
    for start in range(0, len(rows.uid), BLOCK_ROWS):
        part = slice(start, start + BLOCK_ROWS)
        floors = np.where(best.full[:, -1], best.score[:, -1], np.iinfo(np.int64).min).reshape(-1, count)
        least = np.maximum(-(-LOW * positive // 100), floors)
        low = np.where(given, least, np.inf).min(axis=1)
        high = np.where(given, HIGH * positive // 100, -np.inf).max(axis=1)
        wanted = anchors.label[:, None] != rows.label[part][None, :]
        for q, x, score in survivors(anchors, rows, part, wanted, low, high):
            for k in range(count):
                fits = given[q, k] & (LOW * positive[q, k] <= 100 * score) & (100 * score <= HIGH * positive[q, k]) & (score >= floors[q, k])
                best.add(q[fits] * count + k, score[fits], rows.id[x[fits]], rows.none[x[fits]])


def _past_shards(rows: DataFrame, asked: DataFrame, shards: int, rotation: dict[int, np.ndarray], search, schema: str) -> DataFrame:
    """Streams anchors, in blocks of ANCHOR_ROWS, past each shard of rows; a task holds one shard and one block whatever the tables' sizes."""
    columns = ["shard", "dim", "uid", F.coalesce("vec_id", F.lit(0)).alias("id"), F.col("vec_id").isNull().alias("none"), "label", "vector"]
    none = F.lit(None).cast("array<long>").alias("scores")
    own = rows.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int")).select(*columns, none, F.lit(0).alias("asks"))
    queries = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select(*columns, ("scores" if "scores" in asked.columns else none), F.lit(1).alias("asks"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        shard, key = None, None
        for batch in batches:
            for _, some in batch.groupby((batch[["dim", "shard", "asks"]].diff() != 0).any(axis=1).cumsum(), sort=False):
                mine = (int(some.dim.iloc[0]), some.shard.iloc[0])
                if mine != key:
                    held, shard, key = [], None, mine
                if not some.asks.iloc[0]:
                    held.append(some)
                    continue
                if held:
                    shard, held = Rows(pd.concat(held), rotation.get(mine[0]), mine[0]), []
                for at in range(0, len(some) if shard is not None else 0, ANCHOR_ROWS):
                    block = some[at : at + ANCHOR_ROWS]
                    yield search(Rows(block, rotation.get(mine[0]), mine[0]), block, shard)

    dealt = own.unionByName(queries).repartition(shards, "shard").sortWithinPartitions("dim", "shard", "asks", "uid")
    return dealt.mapInPandas(run, schema)


def hard_negatives(embeddings: DataFrame, every: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; see usable for the rows that take part.

    Anchors are rows whose vec_id is divisible by every; their positives are the POSITIVES nearest other rows
    of their label, and each positive's negatives the NEGATIVES nearest rows of other labels whose score is
    LOW to HIGH percent of the positive's. Only vectors of one length are compared. An anchor or positive
    without such rows gives none; rows that repeat an id are anchors each; ties go to the smaller id. An
    empty table gives no rows. Every anchor is compared with every shard of SHARD_ROWS rows, so the work grows
    with anchors times rows; what a shard returns is at most POSITIVES or POSITIVES * NEGATIVES rows an anchor.
    """
    rows = usable(embeddings)
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    rotation = rotations(rows)
    anchors = rows.where(F.col("vec_id") % every == 0)

    def near(block: Rows, frame: pd.DataFrame, shard: Rows) -> pd.DataFrame:
        best = Best(len(frame), POSITIVES)
        positives_of(block, shard, best)
        q, k = np.nonzero(best.full)
        return pd.DataFrame({"uid": block.uid[q], "positive": best.id[q, k], "none": best.none[q, k], "score": best.score[q, k]})

    found = _past_shards(rows, anchors, shards, rotation, near, "uid long, positive long, none boolean, score long")
    nearest = Window.partitionBy("uid").orderBy(F.col("score").desc(), "none", "positive")
    first = found.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= POSITIVES)
    # at most POSITIVES structs an anchor
    lists = materialize(first.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("place", F.when(~F.col("none"), F.col("positive")).alias("positive"), "score"))).alias("list")), "positives")
    asked = anchors.join(lists, "uid")

    def hard(block: Rows, frame: pd.DataFrame, shard: Rows) -> pd.DataFrame:
        score, given = np.zeros((len(frame), POSITIVES), np.int64), np.zeros((len(frame), POSITIVES), bool)
        for k, some in enumerate(frame.scores):
            score[k, : len(some)], given[k, : len(some)] = some, True
        best = Best(len(frame) * POSITIVES, NEGATIVES)
        negatives_of(block, score, given, shard, best)
        q, k = np.nonzero(best.full)
        return pd.DataFrame({"uid": block.uid[q // POSITIVES], "place": q % POSITIVES + 1, "negative": best.id[q, k], "none": best.none[q, k], "score": best.score[q, k]})

    told = _past_shards(rows, asked.withColumn("scores", F.col("list.score")), shards, rotation, hard, "uid long, place int, negative long, none boolean, score long")
    order = Window.partitionBy("uid", "place").orderBy(F.col("score").desc(), "none", "negative")
    ranked = told.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEGATIVES)
    named = ranked.join(asked.select("uid", F.col("vec_id").alias("anchor_id"), "list"), "uid")
    mine = F.element_at("list", F.col("place"))
    return named.select(
        "anchor_id", mine.positive.alias("positive_id"), "rank", F.when(~F.col("none"), F.col("negative")).alias("negative_id"), mine.score.alias("positive_score"), F.col("score").alias("negative_score")
    )


#: Brute force.
NEGATIVES_SQL = """
WITH numbered AS (SELECT *, row_number() OVER () AS uid FROM embeddings),
v AS (
  SELECT uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS x
  FROM numbered WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
scored AS (
  SELECT a.uid, a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CASE WHEN len(a.x) = 0 THEN 0 ELSE list_inner_product(a.x, r.x)::BIGINT END AS score
  FROM v a JOIN v r ON a.uid <> r.uid AND len(a.x) = len(r.x) WHERE a.vec_id % 100 = 0),
positives AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS place FROM scored WHERE same) WHERE place <= 5),
pairs AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.uid, p.place ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM positives p JOIN scored s ON s.uid = p.uid AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM pairs WHERE rank <= 5
"""
