"""Repeated passages across documents, by sparse suffix arrays over words.

Every run of MIN_WORDS words belongs to one suffix: that at the minimiser of its first window, the
one of WINDOW successive GRAM-word runs that has the least hash. Suffixes are sorted by the hash of
their first CORE words, which lie within the run (MIN_WORDS = WINDOW - 1 + CORE), so equal runs belong
to equal cores, which sort side by side. Cores that one document alone holds are dropped; the others
are extended to the left and right to every run of MIN_WORDS words that the suffix stands for, and
these are sorted and compared with the first document that holds them. So no partner is left out,
however many documents share a core, and rows grow with the words of shared passages, not with pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterlake.llm.common import WORD, materialize
from meterlake.llm.words import Hashes, mix, word_hashes

MIN_WORDS, GRAM, WINDOW = 50, 8, 20
CORE = MIN_WORDS - WINDOW + 1

_SPAN = re.compile(WORD)


def _doubled(words: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of all runs of 1, 2, 4, 8, 16 and 32 words, each from two halves."""
    out, n = {1: words}, 1
    while n < 32:
        h = out[n]
        out[2 * n] = mix(h[: max(0, len(h) - n)]) + h[n:]
        n *= 2
    return out


def _run_hashes(runs: dict[int, np.ndarray], at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the size words from each position on."""
    total, offset = np.zeros(len(at), np.uint64), 0
    for n in (32, 16, 8, 4, 2, 1):
        if size & n:
            total = mix(total) + runs[n][at + offset]
            offset += n
    return mix(total)


def run_cores(runs: dict[int, np.ndarray]) -> np.ndarray:
    """The core hash that each run of MIN_WORDS words of a text belongs to, in turn; none for texts that are shorter."""
    count = len(runs[1]) - MIN_WORDS + 1
    if count < 1:
        return np.empty(0, np.uint64)
    grams = mix(runs[GRAM])
    at = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)[:count].argmin(axis=1) + np.arange(count)
    own = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return np.repeat(_run_hashes(runs, at[own], CORE), np.diff(np.append(own, count)))


def with_first(rows: DataFrame, name: str, keep_keys: bool = True) -> DataFrame:
    """The rows (key, doc, numbers) whose key a document of smaller id has too, and the first such document as first; key is 0 unless kept.

    Rows are range-partitioned by (key, doc) and sorted there, so one key that a third of all documents
    hold is spread over many partitions; a task keeps one key and its first document in memory. What
    a partition's first key lacks is known from the last keys of the ones before: two rows per
    partition, whose number Spark's settings bound, come to the driver, and one goes back by a join.
    """
    others = [c for c in rows.columns if c not in ("key", "doc")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        opening = key = first = None
        for batch in batches:
            if not len(batch):
                continue
            keys, docs = batch.key.to_numpy(), batch.doc.to_numpy()
            opening = int(keys[0]) if opening is None else opening
            begins = np.append(key is None or keys[0] != key, keys[1:] != keys[:-1])
            at = np.maximum.accumulate(np.where(begins, np.arange(len(keys)), -1))
            firsts = np.where(at < 0, docs[0] if first is None else first, docs[at])
            key, first = int(keys[-1]), int(firsts[-1])
            edge = keys == opening
            keep = edge | (docs > firsts)
            shown = keys[keep] if keep_keys else np.int64(0)
            yield batch[keep].assign(kind=edge[keep].astype(np.int32), part=np.int32(part), key=shown, first=firsts[keep])
        if key is not None:
            yield pd.DataFrame([{"kind": kind, "part": part, "key": k, "doc": first, "first": first} | dict.fromkeys(others, 0) for kind, k in ((2, key), (3, opening))])

    schema = "kind int, part int, first long, " + ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    spread = rows.repartitionByRange("key", "doc").sortWithinPartitions("key", "doc")
    near = materialize(spread.mapInPandas(run, schema), name)
    edges = near.where("kind >= 2").select("kind", "part", "key", "first").collect()
    begun: dict[int, int] = {}
    for r in edges:
        if r.kind == 2:
            begun[r.key] = min(begun.get(r.key, r["first"]), r["first"])
    known = [(r.part, begun[r.key]) for r in edges if r.kind == 3 and r.key in begun]
    earliest = rows.sparkSession.createDataFrame(known, "part int, earliest long")
    # one row per partition at most, and that number is bounded
    found = near.where("kind < 2").join(F.broadcast(earliest), "part", "left")
    first = F.when(F.col("kind") == 1, F.least("first", "earliest")).otherwise(F.col("first"))
    return found.withColumn("first", first).where("first < doc").select(*rows.columns, "first")


def text_print(text: F.Column) -> F.Column:
    """31 bits of a text's hash."""
    return F.shiftrightunsigned(F.xxhash64(text), 33)


def core_rows(docs: DataFrame, *keys: str) -> DataFrame:
    """(key, keys): every distinct core of every text."""

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = Hashes()
        for batch in batches:
            for start in range(0, len(batch), 500):
                part = batch[start : start + 500]
                found = [np.unique(run_cores(_doubled(word_hashes(text, cache, lower=False)))) for text in part.text]
                sizes = list(map(len, found))
                yield pd.DataFrame({"key": np.concatenate(found).view(np.int64)} | {k: np.repeat(part[k].to_numpy(np.int64), sizes) for k in keys})

    return docs.select(*keys, "text").mapInPandas(keep, "key long, " + ", ".join(f"{k} long" for k in keys))


def shared_cores(docs: DataFrame) -> DataFrame:
    """(doc, print, keys): the cores of a document that another one holds too; print tells the texts of one id apart and is null where there is one.

    An array is no longer than its text: the texts of an id that has several get theirs each for itself.
    """
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("doc"), "text")
    later = with_first(materialize(core_rows(rows, "doc"), "suffixes"), "suffix-cores")
    both = later.select("doc", "key").unionByName(later.select(F.col("first").alias("doc"), "key").distinct())
    several = materialize(rows.select("doc", text_print(F.col("text")).alias("print")).distinct().groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc"), "suffix-ids")
    none = F.lit(None).cast("long").alias("print")
    if several.isEmpty():
        return both.groupBy("doc").agg(F.collect_set("key").alias("keys")).select("doc", none, "keys")
    one = both.join(several, "doc", "left_anti").groupBy("doc").agg(F.collect_set("key").alias("keys")).select("doc", none, "keys")
    texts = rows.join(several, "doc", "left_semi").withColumn("print", text_print(F.col("text"))).dropDuplicates(["doc", "print"])
    own = core_rows(texts, "doc", "print").join(both.join(several, "doc", "left_semi").distinct(), ["doc", "key"])
    return one.unionByName(own.groupBy("doc", "print").agg(F.collect_set("key").alias("keys")))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc, print, at, first): every run of MIN_WORDS words of a text, from word at on, that the earlier document first holds.

    print tells texts of one doc_id apart; while runs are sorted, it and at are one number.
    """

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = Hashes()
        for batch in batches:
            for start in range(0, len(batch), 500):
                part = batch[start : start + 500]
                keys, ats = [], []
                for text, shared in zip(part.text, part["keys"]):
                    runs = _doubled(word_hashes(text, cache, lower=False))
                    at = np.flatnonzero(np.isin(run_cores(runs).view(np.int64), shared))
                    ats.append(at.astype(np.int32))
                    keys.append(_run_hashes(runs, at, MIN_WORDS).view(np.int64))
                sizes = list(map(len, ats))
                yield pd.DataFrame({"key": np.concatenate(keys), "doc": np.repeat(part.doc_id.to_numpy(np.int64), sizes), "print": np.repeat(part.print.to_numpy(np.int64), sizes), "at": np.concatenate(ats)})

    cores = shared_cores(docs).withColumnRenamed("print", "of")
    texts = docs.where("text is not null").select("doc_id", "text", text_print(F.col("text")).alias("print"))
    texts = texts.join(cores, (F.col("doc_id") == F.col("doc")) & (F.col("of").isNull() | (F.col("of") == F.col("print")))).select("doc_id", "text", "print", "keys")
    rows = materialize(texts.mapInPandas(hashed, "key long, doc long, print long, at int"), "suffix-runs")
    rows = rows.select("key", "doc", F.shiftleft("print", 32).bitwiseOR(F.col("at").cast("long")).alias("place"))
    at = F.col("place").bitwiseAND(0xFFFFFFFF).cast("int").alias("at")
    return with_first(rows, "suffix-firsts", keep_keys=False).select("doc", F.shiftright("place", 32).alias("print"), at, "first")


def passages(docs: DataFrame) -> DataFrame:
    """(doc, print, start, words, of): the repeated runs of a text, merged where they touch, and the documents that hold them first."""
    text = Window.partitionBy("doc", "print").orderBy("at")
    rows = repeated_runs(docs).repartition("doc").withColumn("new", (F.col("at") - F.lag("at").over(text) > MIN_WORDS).cast("int"))
    rows = rows.withColumn("stretch", F.sum(F.coalesce("new", F.lit(0))).over(text.rowsBetween(Window.unboundedPreceding, 0)))
    words = F.max("at") - F.min("at") + MIN_WORDS
    return rows.groupBy("doc", "print", "stretch").agg(F.min("at").cast("long").alias("start"), words.cast("long").alias("words"), F.collect_set("first").alias("of")).drop("stretch")


def _cut(text: str, spans: list[tuple[int, int]]) -> tuple[str, int, list[tuple[int, int]]]:
    """text without the words of the spans (start, stop), how many these are, and the merged spans."""
    merged: list[list[int]] = []
    for start, stop in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], stop)
        else:
            merged.append([start, stop])
    begins = [m.start() for m in _SPAN.finditer(text)] + [len(text)]
    pieces, at = [], 0
    for start, stop in merged:
        pieces.append(text[at : begins[start]])
        at = begins[min(stop, len(begins) - 1)]
    pieces.append(text[at:])
    return "".join(pieces), sum(b - a for a, b in merged), [(a, b - a) for a, b in merged]


def without_repeats(docs: DataFrame, described: bool = True) -> DataFrame:
    """The documents, each with all its columns, and without passages that an earlier document has.

    A passage is a match of at least MIN_WORDS words (runs of other than ASCII white space, compared
    by 64-bit hashes of MIN_WORDS words in turn) with a document of smaller doc_id; it stays where its
    first holder has it. Added: removed_words, removed (start and length in words of what was cut, in
    the old text) and kept_in (ids of the first holders of such passages). n_chars, where there is such a column, is
    counted anew for changed texts. Null, empty and short texts and rows with a null doc_id come back
    unchanged; repeats inside one document are no matches; rows that repeat a doc_id and text count
    as one document and are cut alike. Nothing is capped; whole texts are read. If not described, only
    the documents' own columns come back; else columns of theirs that are called as the added ones are left out.
    """
    cut = passages(docs).groupBy("doc", "print").agg(F.collect_list(F.struct("start", "words", "of")).alias("cuts")).withColumnRenamed("print", "at")

    @F.pandas_udf("text string, removed_words long, removed array<struct<start: long, words: long>>, kept_in array<long>")
    def apply(texts: pd.Series, cuts: pd.Series) -> pd.DataFrame:
        rows = []
        for text, mine in zip(texts, cuts):
            left, n, removed = _cut(text, [(c["start"], c["start"] + c["words"]) for c in mine])
            rows.append((left, n, [{"start": a, "words": b} for a, b in removed], sorted({i for c in mine for i in c["of"]})))
        return pd.DataFrame(rows, columns=["text", "removed_words", "removed", "kept_in"])

    whole = docs.select(F.struct("*").alias("d"), text_print(docs["text"]).alias("print"))
    joined = whole.join(cut, (F.col("d.doc_id") == F.col("doc")) & (F.col("print") == F.col("at")), "left")
    changed = F.col("cuts").isNotNull()
    plain = joined.where(~changed).select("d", F.col("d.text").alias("text"), F.lit(0).cast("long").alias("removed_words"), F.array().cast("array<struct<start: long, words: long>>").alias("removed"), F.array().cast("array<long>").alias("kept_in"))
    edited = joined.where(changed).withColumn("r", apply("d.text", "cuts")).select("d", "r.text", "r.removed_words", "r.removed", "r.kept_in")
    out = plain.unionByName(edited)
    chars = F.when(F.col("removed_words") > 0, F.length("text").cast(dict(docs.dtypes).get("n_chars", "long"))).otherwise(F.col("d.n_chars")) if "n_chars" in docs.columns else None
    added = ["removed_words", "removed", "kept_in"] if described else []
    columns = [F.col("text") if c == "text" else chars.alias(c) if c == "n_chars" else F.col("d")[c].alias(c) for c in docs.columns if c not in added]
    return out.select(*columns, *added)


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text, removed_words, removed, kept_in for every document; see without_repeats."""
    return without_repeats(docs.select("doc_id", "text"))
