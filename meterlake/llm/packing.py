"""Packing documents into token sequences by lexical retrieval: BM25 neighbours of a seed fill its window."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import materialize
from meterlake.llm.words import mix, whole_numbers

LENGTH, END_ID = 2048, 1
K1, B = 1.2, 0.75
#: Neighbours of a seed are put in order in lots of RETRIEVED, until the window is full or no document shares a term.
RETRIEVED = 64
#: Documents are dealt to shards by this many of their weightiest terms, of those that COMMON documents hold.
DEALT_TERMS, COMMON = 4, 64
#: A shard is closed at this many documents or tokens.
SHARD_DOCS, SHARD_TOKENS = 1024, 1 << 20
#: Runs that a worker remembers from task to task; beyond these it starts anew. Documents and bytes that are tokenized together.
KNOWN_RUNS, TOKENIZED_DOCS, PIECE_BYTES = 1_000_000, 2000, 1 << 20
#: New runs are merged together over this many bytes of text: many at once cost much less than a few.
MERGED_BYTES = 8 << 20
#: The rank of a pair that does not merge.
NO_MERGE = 0xFFFF
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class LetterMerges:
    """The tokenizer's merges for runs of letters, applied to many runs at once.

    Runs of one length are a matrix of ids. Every round merges, in each row, the leftmost pair of
    least rank, so that all rows still at work stay of one length; a row without a pair is done.
    Pairs are found in a hash table with linear probing.
    """

    def __init__(self, model: dict):
        vocab = model["vocab"]
        shown = _byte_letters()
        end = model["end_of_word_suffix"]
        self.inner = np.array([vocab[c] for c in shown], np.uint16)
        self.last = np.array([vocab[c + end] for c in shown], np.uint16)
        self.keys = np.full(1 << 18, 0xFFFFFFFF, np.uint32)
        self.ranks = np.full(1 << 18, NO_MERGE, np.uint16)
        self.merged = np.zeros(1 << 18, np.uint16)
        for rank, pair in enumerate(model["merges"]):
            one, two = pair.split(" ") if isinstance(pair, str) else pair
            key = vocab[one] << 16 | vocab[two]
            at = (key * 0x9E3779B1 & 0xFFFFFFFF) >> 14
            while self.keys[at] != 0xFFFFFFFF:
                at = (at + 1) & 0x3FFFF
            self.keys[at], self.ranks[at], self.merged[at] = key, rank, vocab[one + two]

    def _find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Places of pairs in the table; of unknown pairs, empty places."""
        key = one.astype(np.uint32) << np.uint32(16) | two
        at = ((key * np.uint32(0x9E3779B1)) >> np.uint32(14)).astype(np.int32)
        seen = self.keys[at]
        open_ = np.flatnonzero((seen != key) & (seen != 0xFFFFFFFF))
        while len(open_):
            step = (at.flat[open_] + 1) & 0x3FFFF
            at.flat[open_] = step
            seen = self.keys[step]
            open_ = open_[(seen != key.flat[open_]) & (seen != 0xFFFFFFFF)]
        return at

    def encode(self, runs: list[bytes]) -> list[bytes]:
        """16-bit ids of each run, given as UTF-8 of letters in lower case."""
        out: list[bytes] = [b""] * len(runs)
        lengths = np.array([len(r) for r in runs])
        for n in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == n)
            raw = np.frombuffer(b"".join(runs[k] for k in rows), np.uint8).reshape(len(rows), n)
            ids = np.concatenate([self.inner[raw[:, :-1]], self.last[raw[:, -1:]]], axis=1)
            places = self._find(ids[:, :-1], ids[:, 1:])
            while len(rows):
                ranks = self.ranks[places]
                least = ranks.argmin(axis=1) if ids.shape[1] > 1 else np.zeros(len(rows), np.int64)
                lines = np.arange(len(rows))
                live = ranks[lines, least] != NO_MERGE if ids.shape[1] > 1 else np.zeros(len(rows), bool)
                flat, size = ids[~live].tobytes(), 2 * ids.shape[1]
                for j, k in enumerate(rows[~live].tolist()):
                    out[k] = flat[j * size : (j + 1) * size]
                rows, ids, places, least = rows[live], ids[live], places[live], least[live]
                if not len(rows):
                    break
                lines = np.arange(len(rows))
                ids[lines, least] = self.merged[places[lines, least]]
                keep = np.ones(ids.shape, bool)
                keep[lines, least + 1] = False
                ids = ids[keep].reshape(len(rows), -1)
                keep = np.ones(places.shape, bool)
                keep[lines, least] = False
                places = places[keep].reshape(len(rows), -1)
                left = np.flatnonzero(least > 0)
                places[left, least[left] - 1] = self._find(ids[left, least[left] - 1], ids[left, least[left]])
                right = np.flatnonzero(least < ids.shape[1] - 1)
                places[right, least[right]] = self._find(ids[right, least[right]], ids[right, least[right] + 1])
        return out


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


#: What the fast path knows how to do; any other tokenizer encodes whole texts itself.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PIECES_OF = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

#: Classes of bytes. ODD words go to the tokenizer as they are.
SPACE, LETTER, DIGIT, OTHER, ODD = range(5)
#: Bytes of the longest run that is looked up by its bytes.
RUN_BYTES = 24


def _byte_classes() -> np.ndarray:
    """ASCII by kind; leading bytes of U+00C0 to U+017F and continuation bytes as letters; control characters and what lies beyond as odd."""
    out = np.full(256, ODD, np.uint8)
    out[33:127] = OTHER
    out[[9, 10, 11, 12, 13, 32]] = SPACE
    out[ord("a") : ord("z") + 1] = LETTER
    out[ord("0") : ord("9") + 1] = DIGIT
    out[0x80:0xC0] = out[0xC3:0xC6] = LETTER
    return out


_CLASSES = _byte_classes()
#: Lower case of code points below U+0180, each of two bytes as those are; U+0130 has none of one letter and stays.
_LOWER = np.array([ord(c) if len(c := chr(k).lower()) == 1 else k for k in range(0x180)], np.uint16)


@cache
def _loaded(path: str) -> tuple:
    """The tokenizer, and its merges if its rules are those of the fast path; once per worker."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    if tokenizer.get_vocab_size() > 1 << 16:
        raise ValueError("ids must fit 16 bits")
    whole = json.loads(tokenizer.to_str())
    model, steps = whole["model"], (whole["pre_tokenizer"] or {}).get("pretokenizers", [{}, {}])
    known = (
        whole["normalizer"] == NORMALIZER
        and [steps[0].get("pattern"), steps[0].get("behavior"), steps[0].get("invert")] == [{"Regex": PIECES_OF}, "Removed", True]
        and [s.get("type") for s in steps] == ["Split", "ByteLevel"]
        and not (steps[1]["add_prefix_space"] or steps[1]["use_regex"])
        and model["type"] == "BPE"
        and model["end_of_word_suffix"]
        and not (model["dropout"] or model["continuing_subword_prefix"] or model["byte_fallback"] or model["ignore_merges"])
        and all(t["special"] and t["content"].startswith("<|") for t in whole["added_tokens"])
    )
    return tokenizer, LetterMerges(model) if known else None


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of the runs (start, size), one run after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class WordTokenizer:
    """Ids of whole texts; each distinct run of letters, digit or run of marks is merged once.

    The tokenizer drops white space, lower-cases, and merges within runs of letters, single digits,
    runs of marks and the English contractions. Runs are found in the bytes of many texts at once and
    told apart by their bytes. Letters are those of ASCII and U+00C0 to U+017F, of which each has a
    lower case of one letter (but U+0130) and nothing to compose. A word that holds any other
    character, a contraction or a run above RUN_BYTES goes to the tokenizer itself, and so does a
    whole text that might hold a special token.
    """

    def __init__(self, path: str):
        self.tokenizer, self.merges = _loaded(path)
        self._forget()

    def _forget(self) -> None:
        # hashes of known runs in order, and the number of each; starts and sizes in the pool go by numbers
        self.keys, self.numbers = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.starts = self.sizes = np.empty(0, np.int64)
        self.pool = np.empty(0, np.uint16)
        self.odd: dict[bytes, int] = {}
        self.known = 0
        # runs and odd words that have numbers but no ids yet
        self.new: list[tuple[np.ndarray, list[bytes], bool]] = []

    def _numbered(self, found: list[bytes], odd: bool) -> np.ndarray:
        """Numbers for new runs or odd words; _merge gives them ids."""
        numbers = np.arange(self.known, self.known + len(found), dtype=np.int32)
        self.known += len(found)
        self.new.append((numbers, found, odd))
        return numbers

    def _merge(self) -> None:
        """Ids for all that is new, at once."""
        if not self.new:
            return
        ids: list[bytes] = [b""] * (self.known - len(self.starts))
        for odd in (False, True):
            lots = [(n, found) for n, found, o in self.new if o == odd]
            words = [w for _, found in lots for w in found]
            if words:
                made = self._whole([w.decode() for w in words]) if odd else self.merges.encode(words)
                for k, x in zip(np.concatenate([n for n, _ in lots]).tolist(), made):
                    ids[k - len(self.starts)] = x
        sizes = np.array([len(x) // 2 for x in ids], np.int64)
        self.starts = np.append(self.starts, len(self.pool) + np.cumsum(sizes) - sizes)
        self.sizes = np.append(self.sizes, sizes)
        self.pool = np.append(self.pool, np.frombuffer(b"".join(ids), np.uint16))
        self.new = []

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("H", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _lowered(raw: bytes) -> np.ndarray:
        """The bytes in lower case; letters beyond ASCII by code point."""
        out = np.frombuffer(raw.lower(), np.uint8)
        lead = np.flatnonzero((out >= 0xC3) & (out <= 0xC5))
        if len(lead):
            out = out.copy()
            low = _LOWER[(out[lead].astype(np.uint16) & 0x1F) << 6 | out[lead + 1] & 0x3F]
            out[lead], out[lead + 1] = 0xC0 | low >> 6, 0x80 | low & 0x3F
        return out

    @staticmethod
    def _classes(text: np.ndarray) -> np.ndarray:
        """A class per byte; all of a word that the fast path does not know is ODD."""
        kind = _CLASSES[text]
        strange = [np.flatnonzero(kind == ODD)]
        lead = np.flatnonzero((text == 0xC3) | (text == 0xC4))
        after = text[lead + 1]
        strange.append(lead[np.where(text[lead] == 0xC3, (after == 0x97) | (after == 0xB7), after == 0xB0)])
        quote = np.flatnonzero(text == ord("'"))
        if len(quote):
            after, then = text[quote + 1], text[np.minimum(quote + 2, len(text) - 1)]
            strange.append(quote[np.isin(after, list(b"stmd")) | (then == ord("e")) & ((after == ord("r")) | (after == ord("v"))) | (after == ord("l")) & (then == ord("l"))])
        cuts = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        runs = np.diff(cuts) > RUN_BYTES
        strange.append(cuts[:-1][runs & (kind[cuts[:-1]] != SPACE)])
        strange = np.concatenate(strange)
        if len(strange):
            gaps = np.flatnonzero(kind == SPACE)
            begin = gaps[np.unique(np.searchsorted(gaps, strange)) - 1] + 1
            kind[_spans(begin, gaps[np.searchsorted(gaps, begin)] - begin)] = ODD
        return kind

    def _piece(self, text: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the units of a text that begins and ends with a space, and each one's number."""
        kind = self._classes(text)
        cuts = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)) + 1
        size = np.diff(np.append(cuts, len(text)))
        real = kind[cuts] != SPACE
        cuts, size = cuts[real], size[real]
        odd = kind[cuts] == ODD
        numbers = np.empty(len(cuts), np.int32)
        if odd.any():
            words = [raw[a : a + n] for a, n in zip(cuts[odd].tolist(), size[odd].tolist())]
            new = [w for w in dict.fromkeys(words) if w not in self.odd]
            self.odd.update(zip(new, self._numbered(new, odd=True).tolist()))
            numbers[odd] = [self.odd[w] for w in words]
        plain = np.flatnonzero(~odd)
        at, n = cuts[plain], size[plain]
        # eight bytes from every position on, then up to RUN_BYTES of every run
        eight = np.append(text, np.zeros(RUN_BYTES, np.uint8)).astype(np.uint64)
        for k in (1, 2, 4):
            eight[:-k] |= eight[k:] << np.uint64(8 * k)
        parts = []
        for k in range(0, RUN_BYTES, 8):
            left = np.clip(n - k, 0, 8).astype(np.uint64)
            parts.append(np.where(left > 0, eight[at + k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * np.maximum(left, np.uint64(1)))), np.uint64(0)))
        key = mix(mix(mix(parts[0]) + parts[1]) + parts[2])
        distinct, first, place = np.unique(key, return_index=True, return_inverse=True)
        if not all((p[first][place] == p).all() for p in parts):
            raise ValueError("two runs of equal hashes in one piece")
        where = np.searchsorted(self.keys, distinct)
        missing = np.flatnonzero(np.append(self.keys, np.uint64(0))[where] != distinct) if len(self.keys) else np.arange(len(distinct))
        if len(missing):
            run = first[missing]
            lower = text.tobytes()
            new = self._numbered([lower[a : a + m] for a, m in zip(at[run].tolist(), n[run].tolist())], odd=False)
            at_key = where[missing]
            self.keys, self.numbers = np.insert(self.keys, at_key, distinct[missing]), np.insert(self.numbers, at_key, new)
            where = np.searchsorted(self.keys, distinct)
        numbers[plain] = self.numbers[where][place]
        return cuts, numbers

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 16-bit ids of each text, END_ID last; null is empty."""
        end = array("H", [END_ID]).tobytes()
        if self.merges is None:
            return [x + end for x in self._whole([t or "" for t in texts])]
        raw = [b"" if not t or "<|" in t else t.encode("utf-8", "replace") for t in texts]
        special = [k for k, t in enumerate(texts) if t and "<|" in t]
        whole = dict(zip(special, self._whole([texts[k] for k in special])))
        buffer = b"\n".join([b"", *raw, b""])
        begins = np.cumsum([1, *(len(r) + 1 for r in raw)])
        ids, units, counts, lot, at, merged = [], [], [], [], 0, 0
        while at < len(buffer) - 1:
            stop = len(buffer)
            if stop - at > PIECE_BYTES and (gap := _GAP.search(buffer, at + PIECE_BYTES)):
                stop = gap.end()
            piece = buffer[at:stop]
            found, numbers = self._piece(self._lowered(piece), piece)
            units.append(found + at)
            lot.append(numbers)
            at = stop - 1
            if at - merged >= MERGED_BYTES or at >= len(buffer) - 1:
                self._merge()
                for numbers in lot:
                    counts.append(self.sizes[numbers])
                    ids.append(self.pool[_spans(self.starts[numbers], counts[-1])])
                lot, merged = [], at
                if self.known > KNOWN_RUNS:
                    self._forget()
        flat = np.concatenate(ids).tobytes() if ids else b""
        total = np.append(0, np.cumsum(np.concatenate(counts))) if counts else np.zeros(1, np.int64)
        bounds = 2 * total[np.searchsorted(np.concatenate(units), begins)] if units else np.zeros(len(begins), np.int64)
        return [whole[k] + end if k in whole else flat[a:b] + end for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist()))]


@cache
def _word_tokenizer(path: str) -> WordTokenizer:
    """One per worker, so that its tasks share the runs that they have met."""
    return WordTokenizer(path)


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id as a string, ids): one row per document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = _word_tokenizer(path)
        for batch in batches:
            for at in range(0, len(batch), TOKENIZED_DOCS):
                part = batch[at : at + TOKENIZED_DOCS]
                yield pd.DataFrame({"doc_id": part.doc_id, "ids": tokenizer.encode(list(part.text))})

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, ids binary")


def counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 16-bit ids of a document, in order, and how often each occurs. Stable sorts of 16-bit numbers are radix sorts."""
    ordered = np.sort(ids, kind="stable")
    edge = np.ones(len(ids), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=edge[1:])
    at = np.flatnonzero(edge)
    often = np.empty(len(at), np.int64)
    often[:-1] = at[1:] - at[:-1]
    often[-1:] = len(ids) - at[-1:]
    return ordered[at], often


def token_statistics(tokens: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Documents that hold every id, its inverse document frequency, and the mean length of documents. One number per id comes to the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(1 << 16, np.int64)
        docs = length = 0
        for batch in batches:
            for raw in batch.ids:
                ids = np.frombuffer(raw, "<u2")
                held[counted(ids)[0]] += 1
                docs, length = docs + 1, length + len(ids)
        some = np.flatnonzero(held)
        yield pd.DataFrame({"id": [*some, -1, -2], "n": [*held[some], docs, length]})

    rows = tokens.select("ids").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    found = {r.id: r.n for r in rows}
    docs = found.get(-1, 0)
    held = np.zeros(1 << 16)
    for i, n in found.items():
        if i >= 0:
            held[i] = n
    return held, np.log1p((docs - held + 0.5) / (held + 0.5)).astype(np.float32), found.get(-2, 0) / max(docs, 1)


def dealt(tokens: DataFrame, held: np.ndarray, idf: np.ndarray) -> DataFrame:
    """The rows of tokens, range-partitioned and sorted by their weightiest common terms, so that documents that share them meet.

    Rows of equal terms are parted by doc_id and ids, so a term of many documents is spread.
    """
    names = [f"t{k}" for k in range(DEALT_TERMS)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tops = np.full((len(batch), DEALT_TERMS), -1, np.int32)
            for top, raw in zip(tops, batch.ids):
                terms, often = counted(np.frombuffer(raw, "<u2"))
                mine = (terms != END_ID) & (held[terms] >= COMMON)
                terms, often = terms[mine], often[mine]
                best = terms[np.argsort(-idf[terms] * often * (K1 + 1) / (often + K1), kind="stable")[:DEALT_TERMS]]
                top[: len(best)] = best
            yield batch.assign(**{name: tops[:, k] for k, name in enumerate(names)})

    keyed = tokens.mapInPandas(run, "doc_id string, ids binary, " + ", ".join(f"{n} int" for n in names)).withColumn("print", F.xxhash64("ids"))
    by = [*names, "doc_id", "print"]
    return keyed.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "ids")


class Shard:
    """A BM25 inverted index over a shard's documents; it hands out each document once."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        self.docs = docs
        found = [counted(d) for d in docs]
        term = np.concatenate([t for t, _ in found])
        owner = np.repeat(np.arange(len(docs)), [len(t) for t, _ in found])
        often = np.concatenate([n for _, n in found]).astype(np.float64)
        norm = (K1 * (1 - B + B * np.array([len(d) for d in docs], np.float64) / max(mean_length, 1)))[owner]
        weight = idf[term] * often * (K1 + 1) / (often + norm)
        self.queries = [t[t != END_ID] for t, _ in found]
        order = np.argsort(term, kind="stable")
        order = order[term[order] != END_ID]
        self.posted_term, self.posted_doc, self.posted_weight = term[order], owner[order], weight[order]
        self.unused = np.ones(len(docs), bool)
        self._index()

    def _index(self) -> None:
        """Drops the postings of used documents."""
        left = self.unused[self.posted_doc]
        self.posted_term, self.posted_doc, self.posted_weight = self.posted_term[left], self.posted_doc[left], self.posted_weight[left]
        self.starts = np.searchsorted(self.posted_term, np.arange((1 << 16) + 1))
        self.indexed = np.count_nonzero(self.unused)

    def neighbours(self, seed: int) -> Iterator[int]:
        """Unused documents that share a term with the seed, by falling BM25 score for all of its terms; ties in shard order."""
        if 4 * np.count_nonzero(self.unused) < 3 * self.indexed:
            self._index()
        terms = self.queries[seed]
        at = _spans(self.starts[terms], self.starts[terms + np.uint16(1)] - self.starts[terms])
        scores = np.bincount(self.posted_doc[at], self.posted_weight[at], minlength=len(self.docs)) * self.unused
        found = np.flatnonzero(scores)
        while len(found):
            least = np.partition(scores[found], len(found) - RETRIEVED)[len(found) - RETRIEVED] if len(found) > RETRIEVED else 0
            lot = found[scores[found] >= least]
            yield from lot[np.argsort(-scores[lot], kind="stable")].tolist()
            found = found[scores[found] < least]

    def order(self) -> list[int]:
        """All documents in packing order. A document that overflows a window is the seed of the next."""
        out: list[int] = []
        filled, next_free, seed = 0, 0, None

        def take(doc: int) -> None:
            nonlocal filled
            self.unused[doc] = False
            out.append(doc)
            filled += len(self.docs[doc])

        while len(out) < len(self.docs):
            if seed is None:
                while not self.unused[next_free]:
                    next_free += 1
                seed = next_free
                take(seed)
            window = filled // LENGTH
            if filled % LENGTH:
                for doc in self.neighbours(seed):
                    take(doc)
                    if filled // LENGTH > window:
                        break
            seed = out[-1] if filled // LENGTH > window and filled % LENGTH and len(self.docs[out[-1]]) > 0 and out[-1] != seed else None
        return out


def sequence_starts(total: int, length: int = LENGTH) -> np.ndarray:
    """Starts of the sequences of a shard of total tokens: full windows, then the rest as powers of two, which need no padding."""
    starts = list(range(0, total - total % length, length))
    at = total - total % length
    for bit in reversed(range(length.bit_length() - 1)):
        if (total - at) >> bit:
            starts.append(at)
            at += 1 << bit
    return np.array(starts, np.int64)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def pack(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """PIECES: every id of every document, in exactly one piece of a sequence of at most LENGTH ids.

    A document's ids are the tokenizer's for its whole text (null: none), then END_ID. Document
    frequencies and the mean length are taken over all documents. Documents are dealt to tasks by their
    weightiest terms and shards are runs of a task's documents; sequences do not cross shards, and a shard's last tokens
    are cut into powers of two, so that no sequence is padded. A seed is scored against every unused
    document of its shard by all of its terms. Rows that repeat a doc_id are documents of their own;
    null ids stay null; ties go by shard order. Texts of any length are taken whole. Only doc_id and
    text are read; an empty table gives no rows. ids is null unless asked for. A tokenizer file whose
    rules the fast path does not know is used as it is, text by text.
    """
    tokens = materialize(tokenized(docs, tokenizer or default_tokenizer()), "pack-tokens")
    held, idf, mean_length = token_statistics(tokens)

    def place(names: list[str | None], ids: list[np.ndarray], first_sequence: int) -> tuple[pd.DataFrame, int]:
        order = Shard(ids, idf, mean_length).order()
        lengths = np.array([len(ids[k]) for k in order])
        begins = np.cumsum(lengths) - lengths
        starts = sequence_starts(int(lengths.sum()))
        cuts = np.union1d(begins, starts)
        doc = np.searchsorted(begins, cuts, side="right") - 1
        sequence = np.searchsorted(starts, cuts, side="right") - 1
        size = np.diff(np.append(cuts, lengths.sum()))
        start = cuts - begins[doc]
        parts = [ids[order[d]][s : s + n].astype("<u4") for d, s, n in zip(doc, start, size)]
        frame = pd.DataFrame(
            {
                "doc_id": whole_numbers([names[order[d]] for d in doc]),
                "start": start,
                "length": size,
                "ids_crc32": [zlib.crc32(p.tobytes()) for p in parts],
                "doc_tokens": lengths[doc],
                "sequence_id": first_sequence + sequence,
                "offset": cuts - starts[sequence],
                "ids": [p.astype(np.int32) for p in parts] if with_ids else [None] * len(parts),
            }
        )
        return frame, first_sequence + len(starts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sequence = TaskContext.get().partitionId() << 36
        names: list[str | None] = []
        ids: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for name, raw in zip(batch.doc_id, batch.ids):
                names.append(name)
                ids.append(np.frombuffer(raw, "<u2"))
                held += len(ids[-1])
                if len(ids) >= SHARD_DOCS or held >= SHARD_TOKENS:
                    frame, sequence = place(names, ids, sequence)
                    yield frame
                    names, ids, held = [], [], 0
        if ids:
            yield place(names, ids, sequence)[0]

    return dealt(tokens, held, idf).mapInPandas(run, PIECES)
