"""MinHash near-duplicates with tensored banding; candidates are verified on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import materialize
from meterlake.llm.components import connected_components
from meterlake.llm.words import Hashes, mix, shingle_hashes, whole_numbers, word_hashes

#: Two collections of BANDS bands, ROWS minhashes each. Table (i, j) is keyed by band i of the one and
#: band j of the other: BANDS^2 tables of 2 * ROWS minhashes from 2 * BANDS * ROWS in all. A pair of
#: likeness s is missed with probability 1 - (1 - (1 - s^ROWS)^BANDS)^2: 0.0006 at 0.8, 0.00001 at 0.9.
BANDS, ROWS = 8, 2
#: Shingles of a block of unplaced and of all members of a star, when those are compared.
BLOCK_A, BLOCK_B = 1 << 19, 1 << 21
#: Rows that share a key and meet in one task what is joined to it; that of a key of more is copied.
SPREAD_ROWS = 256

SIGNED = "doc_id long, print long, n_shingles long, high long, low long, bands array<long>"


def _seeds() -> np.ndarray:
    return mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """The 2 * BANDS band values of each non-empty set of hashes."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.zeros((len(sets), 2 * BANDS), np.uint64)
    for k, seed in enumerate(_seeds()):
        hashed = flat * seed
        hashed ^= hashed >> np.uint64(32)
        out[:, k // ROWS] = mix(out[:, k // ROWS] + np.minimum.reduceat(hashed, starts))
    return out


def shingle_set(text: str | None, cache: Hashes, n: int) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(text, cache), n))


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits, as two numbers: the same for equal sets."""
    raw = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def signed_documents(docs: DataFrame, n: int) -> DataFrame:
    """SIGNED, a row per document, print being the hash of its text; without shingles high, low and bands are null."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = Hashes()
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch[at : at + 500]
                sets = [shingle_set(text, cache, n) for text in part.text]
                full = [k for k, s in enumerate(sets) if len(s)]
                high, low, bands = ([None] * len(sets) for _ in range(3))
                for k, row in zip(full, band_keys([sets[k] for k in full]).view(np.int64) if full else ()):
                    (high[k], low[k]), bands[k] = digest(sets[k]), row
                yield pd.DataFrame({"doc_id": whole_numbers(part.doc_id), "print": part.print, "n_shingles": [len(s) for s in sets], "high": pd.array(high, "Int64"), "low": pd.array(low, "Int64"), "bands": bands})

    return docs.select(F.col("doc_id").cast("string"), "text", F.xxhash64("text").alias("print")).mapInPandas(sign, SIGNED)


def set_classes(signed: DataFrame) -> DataFrame:
    """cls, high, low, rep, print, bands: one row per distinct set, numbered; rep is the smallest doc_id that has it, print tells that row's text."""
    first = F.min(F.struct("doc_id", "print")).alias("first")
    rows = signed.where("high is not null and doc_id is not null").groupBy("high", "low").agg(first, F.first("bands").alias("bands"))
    numbered = rows.select(F.monotonically_increasing_id().alias("cls"), "high", "low", F.col("first.doc_id").alias("rep"), F.col("first.print").alias("print"), "bands")
    return materialize(numbered, "minhash-classes")


def grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The frames of equal keys from batches that are sorted by them."""
    held: list[pd.DataFrame] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        key = batch[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), len(batch)]
        for start, stop in zip(cuts, cuts[1:]):
            this = tuple(key[start])
            if held and this != last:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(batch[start:stop])
            last = this
    if held:
        yield pd.concat(held, ignore_index=True)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    return int((large[np.minimum(at, len(large) - 1)] == small).sum())


def star_candidates(classes: DataFrame) -> DataFrame:
    """(leader, cls): every class with the first class of each table bucket that it shares. A bucket of n gives n - 1 rows, not n^2."""
    halves = classes.select("rep", "cls", F.slice("bands", 1, BANDS).alias("one"), F.slice("bands", BANDS + 1, BANDS).alias("two"))
    keys = F.flatten(F.transform("one", lambda x, i: F.transform("two", lambda y, j: F.xxhash64(x, y, i * BANDS + j))))
    rows = halves.select("rep", "cls", F.explode(keys).alias("key"))
    first = rows.groupBy("key").agg(F.min(F.struct("rep", "cls")).alias("first"), F.count("*").alias("n")).where("n > 1").select("key", F.col("first.cls").alias("leader"))
    return rows.join(first, "key").where("cls <> leader").select("leader", "cls").distinct()


def full_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(cls, shingles) of the classes in wanted (rep, print, cls), from whole texts; one row per class, however often its text is repeated."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = Hashes()
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch[at : at + 500]
                yield pd.DataFrame({"cls": part.cls, "shingles": [shingle_set(text, cache, n).tobytes() for text in part.text]})

    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("print"))
    mine = texts.join(wanted.select(F.col("rep").alias("doc_id"), "print", "cls"), ["doc_id", "print"]).dropDuplicates(["doc_id", "print", "cls"])
    return mine.select("cls", "text").mapInPandas(build, "cls long, shingles binary")


class Spread:
    """Joins of rows with what there is once per key, without one task for a key of many rows.

    Keys of more than SPREAD_ROWS rows are listed with their number of lots; there is one for every
    SPREAD_ROWS rows at most, and Spark broadcasts the list only if it is small as written. Rows of such
    a key are dealt to lots by their column of, and what is joined to it is copied once per lot.
    """

    def __init__(self, rows: DataFrame, key: str, of: str):
        self.key, self.of = key, of
        sizes = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > SPREAD_ROWS)
        self.hot = materialize(sizes.select(key, F.ceil(F.col("n") / SPREAD_ROWS).cast("int").alias("lots")), "minhash-hot")

    def join(self, rows: DataFrame, once: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
        lots = F.coalesce("lots", F.lit(1))
        dealt = rows.join(self.hot, self.key, "left").withColumn("lot", F.pmod(F.xxhash64(self.of), lots).cast("int")).drop("lots")
        copies = once.join(self.hot, self.key, "left").withColumn("lot", F.explode(F.sequence(F.lit(0), lots - 1))).drop("lots")
        return dealt.join(copies, [self.key, "lot", *also]).drop("lot")


def verified(pairs: DataFrame, sets: DataFrame, stars: Spread) -> DataFrame:
    """pairs (leader, cls) with common, n_leader, n_cls, from full sets."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            one = [np.frombuffer(x, np.uint64) for x in batch.one]
            two = [np.frombuffer(x, np.uint64) for x in batch.two]
            yield pd.DataFrame({"leader": batch.leader, "cls": batch.cls, "common": [_common(a, b) for a, b in zip(one, two)], "n_leader": [*map(len, one)], "n_cls": [*map(len, two)]})

    with_both = stars.join(pairs.join(sets.withColumnRenamed("shingles", "two"), "cls"), sets.select(F.col("cls").alias("leader"), F.col("shingles").alias("one")))
    return with_both.select("leader", "cls", "one", "two").mapInPandas(count, "leader long, cls long, common long, n_leader long, n_cls long")


def completed(judged: DataFrame, roots: DataFrame, sets: DataFrame, stars: Spread, percent: int) -> DataFrame:
    """Further links (a, b) between members of one star that lie in different components.

    A link that no leader shows joins two members of a star, of which one at least is not in the
    leader's component (unplaced). Unplaced members are compared with the members of another component
    whose distance to the leader differs by at most the threshold's distance and whose size allows a
    link: Jaccard distance is a metric, so no other can be linked. Members lie in cells of that distance
    and size ratio; only neighbouring cells with different components meet, in blocks of bounded size, and
    only their members' sets are read.
    """
    slack = 1 - percent / 100 + 1e-9
    near = judged.select("leader", "cls", (1 - F.col("common") / (F.col("n_leader") + F.col("n_cls") - F.col("common"))).alias("away"), F.col("n_cls").alias("size"))
    root = roots.select(F.col("node").alias("cls"), "root")
    home = near.select("leader").distinct().join(root.select(F.col("cls").alias("leader"), F.col("root").alias("home")), "leader", "left")
    member = near.join(root, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    member = (
        stars.join(member, home)
        .withColumn("unplaced", F.col("root") != F.coalesce("home", "leader"))
        .withColumn("ring", F.floor(F.col("away") / slack).cast("int"))
        .withColumn("scale", F.floor(F.log(F.col("size").cast("double")) / float(-np.log(percent / 100 - 1e-9))).cast("int"))
        .drop("home")
    )
    member = materialize(member, "stars")
    loose = lambda c: F.when(F.col("unplaced"), F.col(c))
    cells = materialize(
        member.groupBy("leader", "ring", "scale").agg(
            F.sum("size").alias("all"), F.sum(loose("size")).alias("loose"), F.min("root").alias("low"), F.max("root").alias("high"), F.min(loose("root")).alias("low_a"), F.max(loose("root")).alias("high_a")
        ),
        "star-cells",
    )
    beside = F.array(F.lit(-1), F.lit(0), F.lit(1))
    asking = cells.where("loose > 0").select("leader", F.col("ring").alias("ring_a"), F.col("scale").alias("scale_a"), "loose", "low_a", "high_a")
    asking = asking.withColumn("ring", F.explode(F.transform(beside, lambda k: F.col("ring_a") + k))).withColumn("scale", F.explode(F.transform(beside, lambda k: F.col("scale_a") + k)))
    meeting = asking.join(cells.select("leader", "ring", "scale", "all", "low", "high"), ["leader", "ring", "scale"]).where(F.least("low", "low_a") < F.greatest("high", "high_a"))
    meeting = materialize(
        meeting.select("leader", "ring_a", "scale_a", F.col("ring").alias("ring_b"), F.col("scale").alias("scale_b"), F.ceil(F.col("loose") / BLOCK_A).cast("int").alias("na"), F.ceil(F.col("all") / BLOCK_B).cast("int").alias("nb")), "star-meetings"
    )

    def side(letter: str, own: str, other: str) -> tuple[DataFrame, F.Column, F.Column]:
        """Members with the meetings of their cell, the block they fall into, and all blocks of the other side."""
        at = meeting.withColumn("ring", F.col(f"ring_{letter}")).withColumn("scale", F.col(f"scale_{letter}"))
        return stars.join(member, at, ("ring", "scale")), F.pmod(F.xxhash64("cls"), F.col(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1))

    block = ["leader", "ring_a", "scale_a", "ring_b", "scale_b", "a", "b"]
    columns = ["leader", "cls", "away", "size", "root", *block[1:5]]
    rows_a, own_a, all_b = side("a", "na", "nb")
    rows_b, own_b, all_a = side("b", "nb", "na")
    side_a = rows_a.where("unplaced").select(*columns, own_a.alias("a"), all_b.alias("b"), F.lit(0).alias("side"))
    side_b = rows_b.select(*columns, all_a.alias("a"), own_b.alias("b"), F.lit(1).alias("side"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in grouped(batches, block):
            one, two = (group[group.side == k] for k in (0, 1))
            if not len(one) or not len(two):
                continue
            sets_b = [np.frombuffer(x, np.uint64) for x in two.shingles]
            known, flat = np.unique(np.concatenate(sets_b), return_inverse=True)
            starts = np.cumsum([0, *map(len, sets_b[:-1])])
            away, size, root_b, cls_b = (two[c].to_numpy() for c in ("away", "size", "root", "cls"))
            links = []
            for cls, d, n, r, raw in zip(one.cls, one.away, one["size"], one.root, one.shingles):
                possible = (root_b != r) & (np.abs(away - d) <= slack) & (100 * np.minimum(size, n) >= percent * np.maximum(size, n))
                if not possible.any():
                    continue
                mine = np.frombuffer(raw, np.uint64)
                at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                mark = np.zeros(len(known), np.int64)
                mark[at[known[at] == mine]] = 1
                common = np.add.reduceat(mark[flat], starts)
                hit = possible & (100 * common >= percent * (n + size - common))
                links += [(cls, x) for x in cls_b[hit]]
            yield pd.DataFrame(links, columns=["a", "b"])

    blocks = side_a.unionByName(side_b).join(sets, "cls")
    return blocks.repartition(*block).sortWithinPartitions(*block).mapInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document; links are Jaccard >= percent / 100 on sets of n-word shingles.

    A-Z are lower-cased and words are runs of other than ASCII white space; a text of fewer than n
    words is one shingle. Null, empty and blank texts have no shingles, link with nothing and are
    kept. component_id is the smallest doc_id that links reach. Rows that repeat a doc_id are nodes
    of their own and linked if their sets are alike; a row with a null doc_id leads no component, and
    is kept if it is alone. Only doc_id and text are read. Equal sets, by a digest of 128 bits, are one
    class from the first step on, so groups of copies cost one row; nothing is collected.
    """
    signed = materialize(signed_documents(docs, n), "minhash")
    classes = set_classes(signed)
    pairs = materialize(star_candidates(classes), "minhash-pairs")
    involved = pairs.select("cls").unionByName(pairs.select(F.col("leader").alias("cls"))).distinct()
    sets = materialize(full_sets(docs, classes.select("rep", "print", "cls").join(involved, "cls"), n), "minhash-sets")
    stars = Spread(pairs, "leader", "cls")
    judged = materialize(verified(pairs, sets, stars), "minhash-judged")
    direct = judged.where(f"100 * common >= {percent} * (n_leader + n_cls - common)").select(F.col("leader").alias("a"), F.col("cls").alias("b"))
    roots = connected_components(direct)
    more = materialize(completed(judged, roots, sets, stars, percent), "minhash-more")
    # roots stand for their members, so only what the further links join is solved again
    name = roots.select("node", "root")
    joined = (
        more.join(name.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
        .join(name.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
        .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    )
    upper = connected_components(joined).select(F.col("node").alias("root"), F.col("root").alias("top"))
    placed = classes.select("cls", "high", "low", "rep").join(name.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    groups = placed.groupBy("root").agg(F.min("rep").alias("rep")).join(upper, "root", "left").withColumn("top", F.coalesce("top", "root"))
    lowest = groups.groupBy("top").agg(F.min("rep").alias("component_id"))
    found = Spread(placed, "root", "cls").join(placed, groups.select("root", "top").join(lowest, "top").select("root", "component_id")).select("high", "low", "component_id")
    out = signed.select("doc_id", "n_shingles", "high", "low").join(found, ["high", "low"], "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with all their columns, of which one of each near-duplicate component stays: that of the smallest doc_id.

    Rows that repeat a doc_id and text are one document; rows with a null doc_id all stay.
    """
    kept = near_duplicates(docs, n, percent).where("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.select(F.struct("*").alias("d"), docs["doc_id"].alias("id"), F.xxhash64(docs["text"]).alias("print"))
    staying = rows.where("id is not null").join(kept, F.col("id") == F.col("kept_id"), "left_semi").dropDuplicates(["id", "print"])
    return staying.unionByName(rows.where("id is null")).select("d.*")


#: All links by brute force, then their components.
NEAR_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reached AS (SELECT doc_id, doc_id AS other FROM sizes UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(least(d.doc_id, c.low), d.doc_id) AS component_id, coalesce(least(d.doc_id, c.low), d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS low FROM reached GROUP BY doc_id) c USING (doc_id)
"""
