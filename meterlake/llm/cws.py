"""Document fingerprints by consistent weighted sampling of words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterlake.llm.common import materialize
from meterlake.llm.words import MIX_A, Hashes, mix, whole_numbers, word_hashes

SAMPLES = 64
#: Bits of a sample that go into the signature, and rows that are sampled at once.
ID_BITS, SAMPLE_ROWS = 12, 1024
#: Documents and characters that are fingerprinted together.
CHUNK_DOCS, CHUNK_CHARS = 1024, 4_000_000


def _gamma_quantiles(bits: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of 2^bits steps: 1 - (1 + x) e^-x, inverted by interpolation."""
    x = np.geomspace(1e-7, 60, 1 << 18)
    return np.interp((np.arange(1 << bits) + 0.5) / (1 << bits), -np.expm1(np.log1p(x) - x), x).astype(np.float32)


class Sampler:
    """Signatures whose collision rate is the generalised Jaccard likeness of weighted words.

    For word w with weight S and sample k, r and c are Gamma(2, 1) and b is uniform, all from a hash
    of (w, k); t = floor(ln S / r + b) and ln a = ln c - r (t - b + 1). Sample k is the (w, t) of the
    least a. A word and weight's samples are one number each: the leading bits of ln a in an
    order-preserving form, then ID_BITS of a hash of (w, t).
    """

    def __init__(self):
        self.words = Hashes()
        self.r = _gamma_quantiles(16)
        self.log_c = np.log(self.r)
        self.steps = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64))

    def _samples(self, word: np.ndarray, weight: np.ndarray) -> np.ndarray:
        draw = mix(word[:, None] + self.steps[None, :])
        r = self.r[draw & np.uint64(0xFFFF)]
        b = (draw >> np.uint64(40)).astype(np.float32) * np.float32(2**-24)
        t = np.floor(np.log(weight).astype(np.float32)[:, None] / r + b)
        value = (self.log_c[(draw >> np.uint64(16)) & np.uint64(0xFFFF)] - r * (t - b + 1)).view(np.int32)
        value = (value ^ ((value >> 31) | np.int32(-(2**31)))).view(np.uint32)
        ident = (draw + t.astype(np.uint64) * MIX_A) * MIX_A
        low = np.uint32((1 << ID_BITS) - 1)
        return (value & ~low) | ((ident >> np.uint64(64 - ID_BITS)).astype(np.uint32))

    def signatures(self, texts: list[str]) -> list[np.ndarray]:
        """One array of SAMPLES small numbers per text; an empty one for texts without words.

        Each distinct (word, weight) of the texts is sampled once.
        """
        counted = [np.unique(word_hashes(x, self.words), return_counts=True) for x in texts]
        full = [k for k, (w, _) in enumerate(counted) if len(w)]
        out = [np.empty(0, np.uint16)] * len(texts)
        if not full:
            return out
        word = np.concatenate([counted[k][0] for k in full])
        weight = np.concatenate([counted[k][1] for k in full])
        _, first, place = np.unique(mix(word + weight.astype(np.uint64) * MIX_A), return_index=True, return_inverse=True)
        table = np.empty((len(first), SAMPLES), np.uint32)
        for at in range(0, len(first), SAMPLE_ROWS):
            some = first[at : at + SAMPLE_ROWS]
            table[at : at + SAMPLE_ROWS] = self._samples(word[some], weight[some])
        stop = 0
        for k in full:
            start, stop = stop, stop + len(counted[k][0])
            out[k] = (table[place[start:stop]].min(axis=0) & np.uint32((1 << ID_BITS) - 1)).astype(np.uint16)
        return out


def as_string(signature: np.ndarray) -> str:
    return "".join(f"{x:03x}" for x in signature.tolist())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal samples: an estimate of the sum of lesser weights over the sum of greater. Two empty texts are alike, an empty and another are not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as many first characters of the following text, or all of these."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _described(sampler: Sampler, rows: list[tuple[str | None, str, str]]) -> pd.DataFrame:
    """RESULT for (doc_id, text, following text)."""
    changed = [edited(a, b) for _, a, b in rows]
    same = {t: k for k, t in enumerate(dict.fromkeys([x for _, a, b in rows for x in (a, b)] + changed))}
    prints = sampler.signatures(list(same))
    of = lambda t: prints[same[t]]
    return pd.DataFrame(
        {
            "doc_id": whole_numbers([i for i, _, _ in rows]),
            "n_chars": [len(a) for _, a, _ in rows],
            "edited_sha256": [hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed],
            "fingerprint": [as_string(of(a)) for _, a, _ in rows],
            "edited_fingerprint": [as_string(of(c)) for c in changed],
            "near_edited": [likeness(of(a), of(c)) for (_, a, _), c in zip(rows, changed)],
            "near_next": [likeness(of(a), of(b)) for _, a, b in rows],
        }
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """RESULT per document: its fingerprint, and how near its edited text and the next document come to it.

    The next document is the one with the next smaller doc_id, after the smallest the largest. Null
    texts are empty; nulls among the ids come last; rows of one id go by a hash of their texts, so that repeated rows stand side by side; a single row is
    its own next. Only doc_id and text are read. Documents are range-partitioned by id once; within
    a partition the next row is at hand, and only the last row of each partition is finished in a
    second step with the first of the following one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler, part = Sampler(), TaskContext.get().partitionId()
        waiting: tuple[str | None, str] | None = None
        head, chars = None, 0
        rows: list[tuple[str | None, str, str]] = []

        def done() -> pd.DataFrame:
            out = _described(sampler, rows).assign(part=part, first_text=None, last_text=None)
            rows.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.doc_id, batch.text):
                chars += len(text)
                if waiting is None:
                    head = text
                else:
                    rows.append((*waiting, text))
                waiting = (doc_id, text)
                if len(rows) >= CHUNK_DOCS or chars >= CHUNK_CHARS and rows:
                    yield done()
                    chars = 0
        if rows:
            yield done()
        if waiting is not None:
            yield _described(sampler, [(waiting[0], "", "")]).assign(part=part, first_text=[head], last_text=[waiting[1]])

    names = [c.split()[0] for c in f"{RESULT}, part int, first_text string, last_text string".split(", ")]
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("at"))
    # the hash parts the rows of one id, or of none, among several tasks
    order = [F.col("at").desc_nulls_last(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    first = materialize(dealt.mapInPandas(run, f"{RESULT}, part int, first_text string, last_text string"), "cws")

    ends = first.where("last_text is not null").select("doc_id", "part", "first_text", "last_text")
    # one row per partition
    by_part = Window.orderBy("part")
    following = ends.select("part", F.coalesce(F.lead("part").over(by_part), F.first("part").over(by_part)).alias("next"))
    heads = ends.select(F.col("part").alias("next"), F.col("first_text").alias("following"))
    last = ends.select(F.col("doc_id").cast("string").alias("doc_id"), "part", "last_text").join(following, "part").join(heads, "next").select("doc_id", "last_text", "following")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler = Sampler()
        for batch in batches:
            if len(batch):
                yield _described(sampler, list(zip(batch.doc_id, batch.last_text, batch.following)))

    columns = names[:-3]
    return first.where("last_text is null").select(*columns).unionByName(last.mapInPandas(finish, RESULT))
