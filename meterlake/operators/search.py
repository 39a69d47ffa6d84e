"""Search for substrings by an index of trigrams that leaves few texts to read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.session import new_folder

#: Trigrams go to slots of so many bits. A block is so many texts (a power of two), and a page of the texts' files.
SLOT_BITS, BLOCK_ROWS = 15, 8
#: Blocks of a row of the posting table; a multiple of 8.
CHUNK_BLOCKS = 512
#: Rows of the posting table that a task hands over at once.
PIECE = 4096
#: A part of the index holds about so many bytes of texts.
PART_BYTES = 1 << 26
#: So many blocks come to the driver, as so many ranges that a scan skips pages by; more blocks are joined instead.
MAX_BLOCKS, MAX_RANGES = 10_000, 128


@dataclass
class TrigramIndex:
    """Texts in blocks, and for each slot of trigrams the blocks that hold one of it."""

    texts: str
    postings: str
    key: str
    text: str


def slots_of(text: str) -> np.ndarray:
    """The slots of a lower-cased text's trigrams of characters, each once; none for fewer than three characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < 3:
        return np.empty(0, np.int32)
    # 21 bits a character: three fill a number, of which a product's upper bits are the slot
    packed = codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:]
    mixed = (packed ^ (packed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique((mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int32))


POSTINGS = "slot int, part int, chunk int, first long, bits binary"


def bitmaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """POSTINGS for rows of block, low: for every slot that a chunk of blocks has, a bit for each of its blocks, from first on."""
    part, chunk = TaskContext.get().partitionId(), 0
    held = np.zeros((1 << SLOT_BITS, CHUNK_BLOCKS), bool)
    for batch in batches:
        blocks, low = batch.block.to_numpy(np.int64), batch.low.to_numpy()
        at = 0
        while at < len(batch):
            # a task may read parts of several files in any order: a chunk ends where a block lies before its first or too far behind it
            away = blocks[at:] - blocks[at]
            outside = (away < 0) | (away >= CHUNK_BLOCKS)
            stop = at + int(outside.argmax()) if outside.any() else len(batch)
            wide = int(away[: stop - at].max()) + 1
            held[:, :wide] = False
            for block, text in zip(away[: stop - at], low[at:stop]):
                held[slots_of(text), block] = True
            slots = np.flatnonzero(held[:, :wide].any(axis=1))
            for k in range(0, len(slots), PIECE):
                some = slots[k : k + PIECE]
                bits = np.packbits(held[some, :wide], axis=1)
                yield pd.DataFrame({"slot": some.astype(np.int32), "part": np.int32(part), "chunk": np.int32(chunk), "first": blocks[at], "bits": [b.tobytes() for b in bits]})
            at, chunk = stop, chunk + 1


def build_index(rows: DataFrame, key: str, text: str, folder: str | None = None) -> TrigramIndex:
    """Writes the texts in blocks, as they lie, and the posting table; null texts hold nothing.

    The posting table has a bit for each slot and block, in one row for a slot and a chunk of CHUNK_BLOCKS blocks,
    and is sorted by slot, so that a search reads the few row groups of its slots. Texts are not shuffled;
    nothing comes to the driver but their size.
    """
    spark = rows.sparkSession
    folder = folder or new_folder(spark, "trigrams")
    # an id tells the task in its upper bits, so blocks of one task follow one another and tasks do not share any
    blocks = rows.select(key, text).withColumn("block", F.floor(F.monotonically_increasing_id() / BLOCK_ROWS))
    paged = {"parquet.page.row.count.limit": BLOCK_ROWS, "parquet.page.size.row.check.min": BLOCK_ROWS, "parquet.block.size": 1 << 23}
    blocks.select("block", key, text).write.options(**paged).parquet(f"{folder}/texts")
    texts = spark.read.parquet(f"{folder}/texts")
    parts = max(1, -(-int(texts.agg(F.sum(F.octet_length(text))).first()[0] or 0) // PART_BYTES))
    low = texts.select("block", F.lower(text).alias("low")).where("low IS NOT NULL")
    held = low.mapInPandas(bitmaps, POSTINGS)
    held.repartitionByRange(parts, "slot", "part", "chunk").sortWithinPartitions("slot").write.option("parquet.block.size", 1 << 20).parquet(f"{folder}/postings")
    return TrigramIndex(f"{folder}/texts", f"{folder}/postings", key, text)


def candidate_blocks(spark: SparkSession, index: TrigramIndex, needle: str) -> DataFrame | None:
    """The blocks that hold every slot of the needle's trigrams; None for fewer than three characters, of which the index knows nothing."""
    # lower-cased as the texts are
    wanted = slots_of(spark.range(1).select(F.lower(F.lit(needle)).alias("low")).first().low).tolist()
    if not wanted:
        return None

    def common(chunk: pd.DataFrame) -> pd.DataFrame:
        """A chunk has at most a row for each wanted slot."""
        if len(chunk) < len(wanted):
            return pd.DataFrame({"block": np.empty(0, np.int64)})
        bits = np.bitwise_and.reduce([np.frombuffer(b, np.uint8) for b in chunk.bits])
        return pd.DataFrame({"block": np.flatnonzero(np.unpackbits(bits)) + chunk["first"].iloc[0]})

    # an OR of equalities reaches the scan; Spark would push a long IN as its least and greatest value only
    held = spark.read.schema(POSTINGS).parquet(index.postings).where(_any([F.col("slot") == s for s in wanted]))
    return held.groupBy("part", "chunk").applyInPandas(common, "block long").distinct()


def _any(conditions: list[Column]) -> Column:
    """Any of many conditions, as a balanced tree."""
    while len(conditions) > 1:
        conditions = [reduce(lambda a, b: a | b, conditions[k : k + 2]) for k in range(0, len(conditions), 2)]
    return conditions[0]


def ranges_of(blocks: list[int], most: int = MAX_RANGES) -> list[tuple[int, int]]:
    """At most so many ranges that hold all sorted blocks, the widest gaps left out."""
    gaps = sorted((k for k in range(1, len(blocks)) if blocks[k] - blocks[k - 1] > 1), key=lambda k: blocks[k - 1] - blocks[k])
    cuts = [0, *sorted(gaps[: most - 1]), len(blocks)]
    return [(blocks[a], blocks[b - 1]) for a, b in zip(cuts, cuts[1:])]


def holding(spark: SparkSession, index: TrigramIndex, needle: str) -> DataFrame:
    """key of every text that holds the needle, whatever the case: the index leaves blocks to read, the exact test decides.

    A needle of fewer than three characters is looked for in all texts, the empty one is in every text but null.
    """
    texts = spark.read.parquet(index.texts)
    hit = F.contains(F.lower(F.col(index.text)), F.lower(F.lit(needle)))
    blocks = candidate_blocks(spark, index, needle)
    if blocks is not None:
        near = sorted(r.block for r in blocks.limit(MAX_BLOCKS + 1).collect())
        if not near:
            return texts.where("false").select(index.key)
        if len(near) <= MAX_BLOCKS:
            texts = texts.where(_any([F.col("block").between(a, b) for a, b in ranges_of(near)]))
        else:
            texts = texts.join(blocks, "block", "left_semi")
    return texts.where(hit).select(index.key)
