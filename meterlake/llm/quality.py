"""Document quality by the votes of labelled neighbours in a latent-semantic space."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.langid import held_out

#: Hashed terms of three families: words, shapes of words, distances to a word's last occurrence.
WORD_TERMS, SHAPE_TERMS, GAP_TERMS = 2048, 1024, 8
TERMS = WORD_TERMS + SHAPE_TERMS + GAP_TERMS
#: How much a family counts; each has unit length before.
WEIGHTS = np.repeat([0.5, 1.0, 1.0], [WORD_TERMS, SHAPE_TERMS, GAP_TERMS]).astype(np.float32)
#: The bound of the labelled sample, documents per label, and of the space that it spans.
SAMPLE_PER_LABEL, LATENT = 1024, 48
NEIGHBOURS, POWER, THRESHOLD = 15, 8, 0.7
BLOCK, CACHE_WORDS = 256, 200_000

_MARKS = re.compile(r"\w+")


def shape_of(word: str) -> str:
    """Case, whether it has digits, and all that is neither letter nor digit."""
    case = "T" if len(word) == 1 else "U" if word.isupper() else "l" if word.islower() else "T" if word[:1].isupper() and word[1:].islower() else "m"
    return case + ("0" if any(map(str.isdigit, word)) else "") + _MARKS.sub("", word)


class Codes(dict):
    """A word's hash, A-Z lower-cased, above the term of its shape; emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        shape = xxhash.xxh64_intdigest(shape_of(word.decode("utf-8", "replace"))) % SHAPE_TERMS
        value = self[word] = (xxhash.xxh64_intdigest(word.lower()) >> 12) * SHAPE_TERMS + shape
        return value


def term_shares(text: str | None, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """(terms, square roots of their shares in their family) of a whole text: every family with words has unit length. Null and blank texts have none."""
    words = text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    code = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
    word = code // SHAPE_TERMS
    order = np.argsort(word, kind="stable")
    away = np.diff(order)
    gap = np.zeros(len(words), np.int64)
    again = np.flatnonzero(np.diff(word[order]) == 0)
    gap[order[again + 1]] = np.minimum(1 + np.ceil(np.log2(away[again])).astype(np.int64), GAP_TERMS - 1)
    terms = np.concatenate([word % WORD_TERMS, WORD_TERMS + code % SHAPE_TERMS, WORD_TERMS + SHAPE_TERMS + gap])
    counts = np.bincount(terms, minlength=TERMS)
    some = np.flatnonzero(counts)
    return some, np.sqrt(counts[some] / len(words)).astype(np.float32)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """How many of all documents have words, and in how many each term occurs. TERMS + 1 sums come to the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, seen = Codes(), np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            for text in batch.text:
                terms, _ = term_shares(text, codes)
                seen[terms] += 1
                seen[TERMS] += len(terms) > 0
        yield pd.DataFrame({"term": np.arange(TERMS + 1), "n": seen})

    sums = docs.select("text").mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(TERMS + 1)
    for r in sums:
        found[r.term] = r.n
    return int(found[TERMS]), found[:TERMS]


def labelled_sample(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term shares, labels, weights of votes) of at most per_label documents with words for each label.

    Only ids that are not held out are drawn, by a hash; of rows that repeat an id one teaches, and the
    label of an id with several is the one that most have. The ids, at most twice per_label, are joined
    by broadcast, so texts do not move; only term shares come to the driver. A vote weighs what a label's
    share among all labels is over its share in the sample, so that scores follow the labels as they come.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.avg(F.col("quality").cast("double")) >= 0.5).cast("int").alias("label"))
    total = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    drawn = [known.where(F.col("label") == k).orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id").limit(per_label) for k in sorted(total)]
    if not drawn:
        return np.empty((0, TERMS), np.float32), np.empty(0), np.empty(0)
    ids = drawn[0] if len(drawn) == 1 else drawn[0].unionByName(drawn[1])

    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = Codes()
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch[at : at + 64]
                found = [term_shares(x, codes) for x in part.text]
                yield pd.DataFrame({"doc_id": part.doc_id, "label": part.label, "terms": [t.astype(np.int32) for t, _ in found], "shares": [s for _, s in found]})

    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(F.col("doc_id").cast("string").alias("doc_id"), "label", "text")
    one = rows.mapInPandas(shares, "doc_id string, label int, terms array<int>, shares array<float>").where(F.size("terms") > 0).groupBy("doc_id").agg(F.min(F.struct("label", "terms", "shares")).alias("r"))
    held = sorted(one.select("doc_id", "r.*").collect(), key=lambda r: r.doc_id)
    matrix = np.zeros((len(held), TERMS), np.float32)
    for k, r in enumerate(held):
        matrix[k, r.terms] = r.shares
    label = np.array([r.label for r in held], np.float64)
    weight = np.array([total[int(k)] / max(1, (label == k).sum()) for k in label])
    return matrix, label, weight


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at unit length; zero rows stay."""
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


class Votes:
    """Latent vectors of labelled documents; a document's score is the share of label 1 among its nearest, by similarity."""

    def __init__(self, matrix: np.ndarray, labels: np.ndarray, weights: np.ndarray, idf: np.ndarray):
        self.labels, self.weights, self.scale = labels, weights, (WEIGHTS * idf).astype(np.float32)
        # leading right singular vectors by subspace iteration from a fixed start: the same rows give the same space
        weighted = matrix * self.scale
        base = np.random.default_rng(0).normal(size=(TERMS, min(LATENT, max(1, len(matrix))))).astype(np.float32)
        for _ in range(12 if len(matrix) else 0):
            base = np.linalg.qr(weighted.T @ (weighted @ base))[0]
        self.base = base
        self.vectors = unit(weighted @ base)
        self.prior = float((labels * weights).sum() / weights.sum()) if len(labels) else 0.5

    def score(self, matrix: np.ndarray) -> np.ndarray:
        """Scores of rows of term shares: exact cosines with all labelled vectors; rows without terms, or far from all, get the share of label 1 among all labels."""
        k = min(NEIGHBOURS, len(self.labels))
        if not k:
            return np.full(len(matrix), self.prior)
        cosines = unit((matrix * self.scale) @ self.base) @ self.vectors.T
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        votes = np.maximum(np.take_along_axis(cosines, near, axis=1), 0).astype(np.float64) ** POWER * self.weights[near]
        mass = votes.sum(axis=1)
        told = (votes * self.labels[near]).sum(axis=1) / np.where(mass > 0, mass, 1)
        return np.clip(np.where((mass > 0) & matrix.any(axis=1), told, self.prior), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame) -> Votes:
    """The vote from the labels of documents that are not held out and the document frequencies of all."""
    documents, frequencies = document_frequencies(docs)
    idf = np.log1p(documents / (1 + frequencies)) / np.log1p(1 + documents)
    idf[WORD_TERMS + SHAPE_TERMS :] = 1
    return Votes(*labelled_sample(docs, labels), idf)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, from whole texts; see Votes.

    Null, empty and blank texts get the share of label 1 among the labels, 0.5 if there are none;
    equal texts score alike, so do repeated rows. Other columns are not read. An empty table gives no rows. The
    model, of a bounded size, is broadcast; the texts are scanned twice and never shuffled.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, labels))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        votes, codes = model.value, Codes()
        for texts in batches:
            out = np.empty(len(texts))
            for at in range(0, len(texts), BLOCK):
                part = texts.iloc[at : at + BLOCK]
                matrix = np.zeros((len(part), TERMS), np.float32)
                for k, text in enumerate(part):
                    terms, shares = term_shares(text, codes)
                    matrix[k, terms] = shares
                out[at : at + BLOCK] = votes.score(matrix)
            yield pd.Series(out)

    scored = docs.select("doc_id", held_out().alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
