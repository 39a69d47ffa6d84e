"""Language identification with a convolutional network over bytes, trained and applied in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WINDOW, EMBED, WIDTHS, FILTERS = 128, 6, (2, 3, 4), 8
#: The bound of the training sample: documents per language, windows per document.
TRAIN_DOCS, TRAIN_WINDOWS = 256, 6
EPOCHS, BATCH, RATE = 5, 128, 0.01
UNDETERMINED = "und"

#: Bytes of letters, or of parts of letters outside ASCII: how much a window has to say.
_LETTER = np.array([chr(b).isalpha() and b < 128 or b >= 128 for b in range(256)], np.float32)


class ByteNet:
    """Byte embedding, filters of several widths, maximum over positions, softmax."""

    def __init__(self, classes: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        shapes = {"embed": (256, EMBED), "out": (len(WIDTHS) * FILTERS, classes), "bias": (classes,)}
        for w in WIDTHS:
            shapes |= {f"conv{w}": (w * EMBED, FILTERS), f"shift{w}": (FILTERS,)}
        self.p = {k: (rng.normal(0, 1 if k == "embed" else s[0] ** -0.5, s) if len(s) > 1 else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}

    def _patches(self, windows: np.ndarray, w: int) -> np.ndarray:
        """(windows, positions, w * EMBED)."""
        e = self.p["embed"][windows]
        n, length, _ = e.shape
        return np.lib.stride_tricks.sliding_window_view(e.reshape(n, -1), w * EMBED, axis=1)[:, ::EMBED]

    def forward(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        """Probabilities, pooled features, and per width the positions of the maxima with the patches."""
        pooled, trace = [], []
        for w in WIDTHS:
            patches = self._patches(windows, w)
            n, positions, size = patches.shape
            values = (patches.reshape(-1, size) @ self.p[f"conv{w}"]).reshape(n, positions, FILTERS)
            pooled.append(values.max(axis=1) + self.p[f"shift{w}"])
            trace.append((values, patches))
        features = np.maximum(np.concatenate(pooled, axis=1), 0)
        scores = features @ self.p["out"] + self.p["bias"]
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        return scores / scores.sum(axis=1, keepdims=True), features, trace

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        probabilities, features, trace = self.forward(windows)
        error = probabilities
        error[np.arange(len(labels)), labels] -= 1
        error /= len(labels)
        g = {"out": features.T @ error, "bias": error.sum(axis=0), "embed": np.zeros_like(self.p["embed"])}
        back = (error @ self.p["out"].T) * (features > 0)
        rows = np.arange(len(labels))[:, None]
        for k, (w, (values, patches)) in enumerate(zip(WIDTHS, trace)):
            d = back[:, k * FILTERS : (k + 1) * FILTERS]
            at = values.argmax(axis=1)
            g[f"shift{w}"] = d.sum(axis=0)
            g[f"conv{w}"] = np.einsum("nf,nfd->df", d, patches[rows, at])
            into = (d[:, :, None] * self.p[f"conv{w}"].T[None]).reshape(len(labels), FILTERS, w, EMBED)
            np.add.at(g["embed"], windows[rows[:, :, None], at[:, :, None] + np.arange(w)], into)
        return g

    def train(self, windows: np.ndarray, labels: np.ndarray, seed: int = 0) -> ByteNet:
        """Adam over shuffled batches; the same rows give the same weights."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), BATCH):
                step += 1
                for k, g in self.gradients(windows[order[at : at + BATCH]], labels[order[at : at + BATCH]]).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.p[k] -= (RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def windows_of(raw: bytes) -> np.ndarray:
    """The whole of raw as rows of WINDOW bytes, the last filled with zeros."""
    rows = max(1, -(-len(raw) // WINDOW))
    return np.frombuffer(raw.ljust(rows * WINDOW, b"\0"), np.uint8).reshape(rows, WINDOW)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame) -> tuple[list[str], ByteNet | None]:
    """Languages and the network learned from text and lang of documents that are not held out.

    The sample is bounded: of each language at most TRAIN_DOCS documents, the first by a hash of id and text,
    each text of an id once, with TRAIN_WINDOWS passages of WINDOW characters each. Null langs and texts teach nothing. One
    count per language comes to the driver, which has to hold a network of as many classes anyway.
    """
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return [], None
    # about twice as many as are kept pass the rate; only these, as passages, are shuffled
    rate = F.element_at(F.create_map(*(F.lit(x) for r in counts for x in (r.lang, 2 * TRAIN_DOCS / r["count"]))), F.col("lang"))
    drawn = known.withColumn("at", F.pmod(F.xxhash64(F.lit("langid"), "doc_id", "text"), F.lit(1 << 52))).where(F.col("at") < rate * float(1 << 52))
    start = lambda i: F.pmod(F.xxhash64("doc_id", i), F.greatest(F.length("text") - WINDOW, F.lit(1))) + 1
    passages = F.transform(F.sequence(F.lit(0), F.lit(TRAIN_WINDOWS - 1)), lambda i: F.substring(F.col("text"), start(i).cast("int"), F.lit(WINDOW)))
    once = drawn.groupBy("lang", "at").agg(F.min(passages).alias("passages"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("at"))
    rows = once.withColumn("rank", rank).where(F.col("rank") <= TRAIN_DOCS).select("lang", "at", "passages").collect()
    rows.sort(key=lambda r: (r.at, r.lang))
    languages = sorted({r.lang for r in rows})
    samples = [(windows_of(x.encode())[0], languages.index(r.lang)) for r in rows for x in sorted(set(r.passages)) if x.strip()]
    if not samples:
        return [], None
    return languages, ByteNet(len(languages)).train(np.stack([x for x, _ in samples]), np.array([y for _, y in samples]))


def predictor(languages: list[str], net: ByteNet | None):
    """A column function from a text to (lang_pred, score), over all windows of the whole text.

    A text's probabilities are those of its windows, weighted by their bytes of letters. Null texts,
    texts without a letter, and all texts if nothing was learned, are 'und' with score 0.
    """

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            totals = np.zeros((len(texts), max(1, len(languages))))
            held: list[tuple[int, np.ndarray]] = []

            def flush() -> None:
                owner = np.repeat([k for k, _ in held], [len(w) for _, w in held])
                windows = np.concatenate([w for _, w in held])
                for at in range(0, len(windows), 512):
                    part = windows[at : at + 512]
                    weight = _LETTER[part].sum(axis=1)[:, None]
                    np.add.at(totals, owner[at : at + 512], net.forward(part)[0] * weight)
                held.clear()

            for k, text in enumerate(texts):
                if net is not None and isinstance(text, str) and any(map(str.isalpha, text)):
                    held.append((k, windows_of(text.encode("utf-8", "surrogatepass"))))
                    if sum(len(w) for _, w in held) > 4096:
                        flush()
            if held:
                flush()
            mass = totals.sum(axis=1)
            some = mass > 0
            names = [languages[b] if ok else UNDETERMINED for b, ok in zip(totals.argmax(axis=1), some)]
            yield pd.DataFrame({"lang_pred": names, "score": np.where(some, totals.max(axis=1) / np.where(some, mass, 1), 0.0)})

    return predict


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; see fit and predictor.

    Only doc_id, text and, for training, lang are read. Repeated rows are predicted alike; an empty
    table gives no rows.
    """
    predict = predictor(*fit(docs))
    return docs.select("doc_id", held_out().alias("held_out"), predict(docs["text"]).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def accepted(docs: DataFrame, min_score: float = 0.3) -> DataFrame:
    """The documents, with all their columns, whose language is determined with at least min_score."""
    predict = predictor(*fit(docs))
    judged = docs.select(F.struct("*").alias("doc"), predict(docs["text"]).alias("p"))
    return judged.where((F.col("p.lang_pred") != UNDETERMINED) & (F.col("p.score") >= min_score)).select("doc.*")
