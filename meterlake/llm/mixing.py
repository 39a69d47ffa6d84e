"""Mixing sources to target weights with a low-discrepancy schedule. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterlake.llm.common import WORD, materialize

#: Period of the schedule's points, and the odd integer nearest to that period divided by the golden ratio.
PERIOD, GOLDEN = 2**31, 1327217885
MAX_EPOCHS = 3
BLOCK_WORDS = 64
SLOTS_PER_CHUNK = 8192
#: Points of a cell of the circle; chunks that one task makes, up to this many tasks.
CELL, CHUNKS_PER_TASK, MAX_TASKS = 2**19, 8, 50_000


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets per source: sid, source, source_size, weight, target.

    ``sizes`` has (source, source_size). Sources are numbered by code point, null last, and weigh
    1, 2, 3, repeating. All sources share the sum of sizes by weight; a target stops at max_epochs
    times the source's size and the excess goes to the others by weight. Sorting by size per weight
    makes that one pass: a source is capped if its cap is at most its share of what the sources
    capped before it have left. One row per source, so the windows here see only sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    capped = F.col("cap") * F.sum("weight").over(onward) <= F.col("weight") * left
    return (
        sizes.withColumn("sid", F.row_number().over(by_name).cast("long"))
        .withColumn("weight", (F.col("sid") - 1) % 3 + 1)
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped", capped)
        .withColumn("spare", F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything))
        .withColumn("share", F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything))
        .withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("spare") / F.col("share")))
        .select("sid", "source", "source_size", "weight", "target", "total")
    )


def slot_schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The schedule: slot, sid, rank (from 0; the source's block that the slot takes).

    Slot i falls on the point i * GOLDEN mod PERIOD; the cumulative targets cut the circle of points
    into one arc per source. Arcs are listed under the cells of the circle that they touch, so a slot
    meets the arcs of its own cell: one row per source and one per cell in all. Ranks are counts per
    (chunk of slots, source), summed over the chunks, plus the place within the chunk, so that no task
    orders all slots of a source. A source takes as many blocks as its target needs: ranks beyond are
    left out, and what the points have not given (a few blocks at most) follows after the last slot.
    """
    spark = targets.sparkSession
    total = targets.agg(F.max("total")).first()[0] or 0
    slots = -(-total // block_words)
    chunks = -(-slots // SLOTS_PER_CHUNK)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    arc = F.round(F.col("target") / F.col("total") * PERIOD).cast("long")
    arcs = (
        targets.where(F.col("total") > 0)
        .withColumn("hi", F.sum(arc).over(Window.orderBy("sid")))
        .withColumn("lo", F.col("hi") - arc)
        .withColumn("hi", F.when(F.col("sid") == F.max("sid").over(everything), F.lit(PERIOD)).otherwise(F.col("hi")))
        .where("lo < hi")
        .select("sid", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / CELL), F.floor((F.col("hi") - 1) / CELL))).alias("cell"))
    )
    # each chunk is a row of a range that many tasks share; its slots are made where it lies
    made = spark.range(0, chunks, 1, max(1, min(-(-chunks // CHUNKS_PER_TASK), MAX_TASKS))).withColumnRenamed("id", "chunk")
    placed = (
        made.select("chunk", F.explode(F.sequence(F.col("chunk") * SLOTS_PER_CHUNK, F.least(F.lit(slots), (F.col("chunk") + 1) * SLOTS_PER_CHUNK) - 1)).alias("slot"))
        .withColumn("point", (F.col("slot") % PERIOD) * GOLDEN % PERIOD)
        .withColumn("cell", F.floor(F.col("point") / CELL))
        .join(arcs, "cell")
        .where("lo <= point and point < hi")
        .select("chunk", "slot", "sid")
    )
    counts = placed.groupBy("chunk", "sid").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select("chunk", "sid", "base")
    within = F.row_number().over(Window.partitionBy("chunk", "sid").orderBy("slot")) - 1
    need = targets.select("sid", F.ceil(goal_of(targets) / block_words).alias("need"))
    # merge joins: by the size of the chunks before they are exploded, Spark would broadcast the slots
    given = placed.withColumn("within", within).join(bases.hint("merge"), ["chunk", "sid"]).select("slot", "sid", (F.col("base") + F.col("within")).alias("rank"))
    given = given.join(need, "sid").where("rank < need").select("slot", "sid", "rank")
    had = counts.groupBy("sid").agg(F.sum("n").alias("n"))
    short = need.join(had, "sid", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < need")
    added = short.select("sid", F.explode(F.sequence(F.col("n"), F.col("need") - 1)).alias("rank"))
    return given.unionByName(added.select((F.lit(slots) + F.col("rank")).alias("slot"), "sid", "rank"))


def goal_of(targets: DataFrame) -> Column:
    """Whole words that a source gives."""
    return F.round(targets["target"]).cast("long")


def shuffled_blocks(docs: DataFrame, targets: DataFrame, block_words: int = BLOCK_WORDS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Pieces of every source's shuffled stream: doc_id, source, size, tag, copy, sid, epoch, block, start, length.

    A source's stream is its documents in the md5 order of their tags, once per epoch in another order, laid end to end,
    cut into blocks of block_words and ended at the source's goal. Offsets are sums per (source, epoch,
    first three digits of the md5) plus the sum within, so a source with a third of all rows is spread
    over 4,096 groups.
    """
    digest = F.md5(F.concat_ws(":", F.col("epoch").cast("string"), F.col("tag")))
    needed = F.least(F.lit(max_epochs), F.ceil(F.col("goal") / F.col("source_size"))).cast("int")
    read = (
        docs.where("size > 0")
        .join(targets.select("sid", F.col("source").alias("of"), "source_size", goal_of(targets).alias("goal")), F.col("source").eqNullSafe(F.col("of")))
        .where("goal > 0")
        .select("doc_id", "source", "size", "tag", "copy", "sid", "source_size", "goal", F.explode(F.sequence(F.lit(0), needed - 1)).alias("epoch"))
        .withColumn("digest", digest)
        .withColumn("bucket", F.substring("digest", 1, 3))
    )
    sums = read.groupBy("sid", "epoch", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("sid", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("sid", "epoch", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    inner = Window.partitionBy("sid", "epoch", "bucket").orderBy("digest", "copy").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        read.withColumn("inner", F.sum("size").over(inner))
        .join(bases, ["sid", "epoch", "bucket"])
        .withColumn("first", F.col("epoch") * F.col("source_size") + F.col("base") + F.col("inner") - F.col("size"))
        .withColumn("end", F.least(F.col("first") + F.col("size"), "goal"))
        .where("first < end")
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / block_words), F.floor((F.col("end") - 1) / block_words))))
    )
    low: Column = F.greatest(F.col("first"), F.col("block") * block_words)
    high: Column = F.least(F.col("end"), (F.col("block") + 1) * block_words)
    return placed.select("doc_id", "source", "size", "tag", "copy", "sid", "epoch", "block", (low - F.col("first")).alias("start"), (high - low).alias("length"))


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def tag_of(doc_id: Column, text: Column) -> Column:
    """What tells documents of a source apart: an md5 of id and text, so that rows that repeat an id, or have none, do not share one."""
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")))))


def numbered(rows: DataFrame) -> DataFrame:
    """rows with copy, which numbers those that agree in source and tag."""
    return rows.withColumn("copy", F.row_number().over(Window.partitionBy("source", "tag").orderBy("doc_id")))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text; null: 0), tag, copy (numbers rows that agree in source, id and text)."""
    return numbered(docs.select(docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), words_of(docs["text"]).alias("size"), tag_of(docs["doc_id"], docs["text"]).alias("tag")))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, max_epochs: int = MAX_EPOCHS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(measured documents, targets, mixture); the mixture has a row per piece: slot, doc_id, source, size, tag, copy, epoch, start, length.

    Every source gives its target, rounded to whole words. Null and empty texts have size 0 and are never taken. Null sources are one source, the last.
    Repeated rows count once each. An empty table gives three empty results. Only doc_id, text and
    source are read, so further columns may have any name. Reruns agree: nothing is random.
    """
    sized = materialize(measured(docs), "mix-sizes")
    targets = materialize(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), max_epochs), "mix-targets")
    pieces = shuffled_blocks(sized, targets, block_words, max_epochs)
    schedule = slot_schedule(targets, block_words).withColumnRenamed("rank", "block")
    # both sides grow with the words of the corpus: neither may be broadcast
    mixture = pieces.join(schedule.hint("merge"), ["sid", "block"]).select("slot", "doc_id", "source", "size", "tag", "copy", "epoch", "start", "length")
    return sized, targets, mixture


def mix_summary(docs: DataFrame, block_words: int = BLOCK_WORDS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words that the mixture takes, repeats counted)."""
    sized, targets, mixture = mix(docs, block_words, max_epochs)
    keys = ["doc_id", "source", "size", "tag", "copy"]
    taken = sized.select(*keys, F.lit(0).cast("long").alias("length")).unionByName(mixture.select(*keys, "length")).groupBy(*keys).agg(F.sum("length").alias("taken"))
    goals = targets.select(F.col("source").alias("of"), "source_size", "target")
    return taken.join(goals, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "size", "source_size", "target", "taken")


def _row_key() -> Column:
    """What tells measured documents apart, without nulls."""
    return F.concat_ws("|", F.col("tag"), F.col("copy").cast("string"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")))


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mixture as documents with the same columns: a row for every time that a document is taken.

    A source's last document may be taken in part: then its text is the words taken, with single
    spaces, and n_chars, where there is such a column, their length.
    """
    _, _, mixture = mix(docs, block_words, max_epochs)
    took = mixture.withColumn("key", _row_key()).groupBy("key", "epoch").agg(F.min("start").alias("start"), F.sum("length").alias("length"), F.first("size").alias("size"))
    whole = docs.select(F.struct("*").alias("d"), docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), words_of(docs["text"]).alias("size"), tag_of(docs["doc_id"], docs["text"]).alias("tag"))
    keyed = numbered(whole).withColumn("key", _row_key()).select("d", "key")
    part = F.array_join(F.slice(F.regexp_extract_all("d.text", F.lit(f"({WORD})")), F.col("start").cast("int") + 1, F.col("length").cast("int")), " ")
    out = keyed.join(took, "key").withColumn("cut", F.col("length") < F.col("size")).withColumn("text", F.when(F.col("cut"), part).otherwise(F.col("d.text")))
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("cut"), F.length("text")).otherwise(F.col("d.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*(changed[c].alias(c) if c in changed else F.col("d")[c].alias(c) for c in docs.columns))
