"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1 in DIMENSIONS dimensions, drawn from a seed and its code point; the
gap between words has one too. A trigram abc of letters and gaps is bound as rr(a) * r(b) * c, r being a rotation by one
place and * the product by dimension: an almost orthogonal vector for each trigram that no table has to hold. A text's
profile bundles (adds) the vectors of all its trigrams. A language's prototype bundles all documents of the language,
and a text gets the language whose prototype has the largest cosine with the text's profile.

Letters are Unicode's, in lower case; everything else is a gap. Learning takes one pass over the whole texts of all
documents with a language that aren't held out (crc32(doc_id as text) mod 4 is 2): tasks count trigrams per language and
send one vector of DIMENSIONS numbers per language on; neither texts nor trigrams leave the tasks. Scoring reads only
texts and prototypes, 8 kB a language; more than MOST languages are refused.

score is the cosine, or 0 where it is negative. Null texts and texts without a letter are 'und' with score 0, and so is
every text where no language was learned. Of equal cosines the language that comes first in UTF-8 is taken. Null doc_id
is not held out, repeated rows get equal results, and an empty table gives no rows. Columns beyond doc_id, text and lang
are not read.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import held_out
from .shared import chunks, small_batches

DIMENSIONS = 1024
SEED = 20_231
NARROW = 128  # letters with a direct table of trigrams; texts with more kinds of letters sort their trigrams
MOST = 10_000
CHUNK = 1 << 18
_OWN: dict[str, "Trigrams"] = {}


def letter_vector(point: int) -> np.ndarray:
    """The vector of a code point; 0 is the gap."""
    return np.random.default_rng([SEED, point]).integers(0, 2, DIMENSIONS, np.int8) * 2 - 1


def trigram_vector(a: int, b: int, c: int) -> np.ndarray:
    return np.roll(letter_vector(a), 2) * np.roll(letter_vector(b), 1) * letter_vector(c)


def letters() -> np.ndarray:
    """For each code point its letter in lower case, 0 where it is none."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for point in range(sys.maxunicode + 1):
        if unicodedata.category(chr(point))[0] == "L":
            table[point] = ord(low) if len(low := chr(point).lower()) == 1 else point
    return table


class Trigrams:
    """Numbers and vectors of the trigrams that a worker has met."""

    def __init__(self):
        self.letters = letters()
        self.clear()

    def clear(self):
        self.small = np.zeros(sys.maxunicode + 1, np.uint8)  # a letter's number; 0 is the gap, NARROW any letter beyond
        self.met = 1
        self.direct = np.full(NARROW**3, -1, np.int32)
        self.sorted = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.vectors = np.zeros((0, DIMENSIONS), np.int8)
        self.each: dict[int, np.ndarray] = {}

    def _letter(self, point: int) -> np.ndarray:
        if point not in self.each:
            self.each[point] = letter_vector(point)
        return self.each[point]

    def _new(self, keys: np.ndarray) -> np.ndarray:
        """Numbers for trigrams that have none; keys hold three code points of 21 bits."""
        first = len(self.vectors)
        mask = (1 << 21) - 1
        made = [np.roll(self._letter(k >> 42), 2) * np.roll(self._letter(k >> 21 & mask), 1) * self._letter(k & mask) for k in keys.tolist()]
        self.vectors = np.concatenate((self.vectors, np.array(made, np.int8).reshape(-1, DIMENSIONS)))
        keys_, numbers = np.concatenate((self.sorted[0], keys)), np.concatenate((self.sorted[1], first + np.arange(len(keys))))
        by = np.argsort(keys_)
        self.sorted = keys_[by], numbers[by]
        return first + np.arange(len(keys))

    def _lookup(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of distinct keys."""
        at = np.searchsorted(self.sorted[0], keys)
        at[at == len(self.sorted[0])] = 0
        known = self.sorted[0][at] == keys if len(self.sorted[0]) else np.zeros(len(keys), bool)
        out = self.sorted[1][at] if len(self.sorted[0]) else np.zeros(len(keys), np.int64)
        if not known.all():
            out[~known] = self._new(keys[~known])
        return out

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number and text of every trigram of these texts."""
        if len(self.vectors) > 50_000:
            self.clear()
        points = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "replace"), np.uint32)
        edge = np.zeros(len(points), np.int64)
        edge[np.cumsum([0, *(len(t) + 1 for t in texts)])] = 1
        text = np.cumsum(edge) - 1
        low = self.letters[points]
        keep = (low > 0) | (edge > 0)
        keep[1:] |= low[:-1] > 0  # one gap behind each word
        low, text = low[keep], text[keep]
        a, b, c = low[:-2], low[1:-1], low[2:]
        real = np.flatnonzero(b > 0)
        text = text[1:-1][real]
        a, b, c = a[real], b[real], c[real]
        new = np.unique(low[(self.small[low] == 0) & (low > 0)])
        if len(new):
            self.small[new] = np.minimum(self.met + np.arange(len(new)), NARROW)
            self.met += len(new)
        x, y, z = (self.small[v].astype(np.int64) for v in (a, b, c))
        narrow = (x < NARROW) & (y < NARROW) & (z < NARROW)
        cell = np.where(narrow, (x * NARROW + y) * NARROW + z, 0)
        out = np.where(narrow, self.direct[cell], -1).astype(np.int64)
        left = np.flatnonzero(out < 0)
        if len(left):
            keys, of = np.unique(a[left].astype(np.int64) << 42 | b[left].astype(np.int64) << 21 | c[left], return_inverse=True)
            out[left] = self._lookup(keys)[of]
            near = left[narrow[left]]
            self.direct[cell[near]] = out[near]
        return out, text


def trigrams() -> Trigrams:
    if "own" not in _OWN:
        _OWN["own"] = Trigrams()
    return _OWN["own"]


def profiles(texts: list[str]) -> np.ndarray:
    """A row for each text: the sum of the vectors of its trigrams."""
    own = trigrams()
    number, text = own.of(texts)
    used = np.flatnonzero(np.bincount(number, minlength=1))
    place = np.zeros(len(own.vectors) + 1, np.int64)
    place[used] = np.arange(len(used))
    n = np.bincount(text * len(used) + place[number], minlength=len(texts) * len(used)).reshape(len(texts), len(used))
    return n.astype(np.float32) @ own.vectors[used].astype(np.float32)


def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, text to one row of lang and the bundle of its texts per task."""
    own, total = trigrams(), {}
    for batch in batches:
        for part, texts in chunks(batch, "text", CHUNK):
            lang = part.column("lang").cast(pa.string()).dictionary_encode()
            each = lang.indices.to_numpy()
            number, text = own.of(texts.to_pylist())
            wide = len(own.vectors)
            n = np.bincount(each[text].astype(np.int64) * wide + number, minlength=len(lang.dictionary) * wide).reshape(len(lang.dictionary), -1) if wide else np.zeros((len(lang.dictionary), 0))
            for i, name in enumerate(lang.dictionary.to_pylist()):
                used = np.flatnonzero(n[i])
                bundle = n[i, used].astype(np.float64) @ own.vectors[used].astype(np.float64)  # whole numbers below 2**53: exact
                total[name] = total.get(name, 0.0) + bundle
    yield from summed(total)


def summed(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lang, vector in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([np.asarray(vector, np.float64)], pa.list_(pa.float64()))], ["lang", "bundle"])


def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = {}
    for batch in batches:
        for lang, bundle in zip(batch.column("lang").to_pylist(), batch.column("bundle")):
            total[lang] = total.get(lang, 0.0) + bundle.values.to_numpy()
    yield from summed(total)


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """The bundle of every language of the documents that aren't held out; 8 parts of a row per language come to the driver."""
    known = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out()).select(F.col("lang").cast("string"), "text")
    few = known.select("lang").distinct().limit(MOST + 1).count()
    if few > MOST:
        raise ValueError(f"more than {MOST} languages")
    parts = known.mapInArrow(bundles, "lang string, bundle array<double>").repartition(8).mapInArrow(add, "lang string, bundle array<double>")
    total: dict[str, np.ndarray] = {}
    for row in parts.toLocalIterator():
        total[row["lang"]] = total.get(row["lang"], 0.0) + np.array(row["bundle"])
    return {lang: total[lang] for lang in sorted(total, key=str.encode) if total[lang].any()}


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-12)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    spark = docs.sparkSession
    small_batches(spark)
    learned = learn(docs)
    names = list(learned)
    rows = np.array(list(learned.values())).reshape(-1, DIMENSIONS)
    model = spark.sparkContext.broadcast((names, rows))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rows = model.value
        languages = unit(rows).astype(np.float32)
        for batch in batches:
            for part, texts in chunks(batch, "text", CHUNK):
                found = profiles(texts.to_pylist())
                none = ~found.any(axis=1) | (not names)
                lang, cosine = np.array(["und"] * len(found), object), np.zeros(len(found))
                if names:
                    near = unit(found) @ languages.T
                    best = near.argmax(axis=1)
                    lang = np.where(none, "und", np.array(names, object)[best])
                    cosine = np.where(none, 0.0, np.clip(near[np.arange(len(best)), best], 0, 1))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(cosine.astype(np.float64))], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double")
