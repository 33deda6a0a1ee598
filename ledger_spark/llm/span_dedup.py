"""Substring dedup by sliding spans of sentences.

A text is cut into sentences at ends of sentences (with any closing quotes) and lines. A sentence of more than `longest`
words is cut again where its words say: of every `longest` words in a row without a start of a sentence, the one whose
hash with the word before is smallest (the last of equal ones) starts a piece. So no piece is longer, and a passage is
cut alike in all hosts but within `longest` words of its ends. A span starts (or ends) at every sentence and takes as
many consecutive ones as give at least `least_sentences` sentences and `least_words` words. Spans' 128-bit hashes meet
over all documents. The first occurrence, by doc_id and place, stays; sentences covered by any other occurrence go.

A passage's first common cut is among its first `longest` words, and a span from there ends `least_words + longest - 1`
words later at most. With the defaults (10 and 20) that is `longest` words before the end of any passage of over 50 words,
wherever it stands: each holds common spans from its first to its last common cut. Ordinary short lines that recur never
make one. Words are what white space parts.

Null and empty texts have no sentences and stay as they are (null becomes empty). A null doc_id comes before any other.
Rows of one doc_id are ordered by a hash of their texts; rows that repeat both are one document, cut alike. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import chunks, materialize, small_batches, text_bytes
from .wordhash import SEEDS, mix, span_hashes, words

SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LINE = np.isin(np.arange(256), [0x0A, 0x0D])
NO_ID = -(1 << 63)
STOPS = ".!?\u2026\u203c\u203d\u3002\uff01\uff0e\uff1f\uff61\u0964\u0965\u061f\u06d4\u0589\u037e\u1362"
CLOSERS = "\"')]}*_\u00bb\u203a\u2019\u201d\u300d\u300f\u3011\uff09"


def _ending(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, chars: str) -> np.ndarray:
    """Bytes of the character of `chars` that each of data[start:end] ends with, 0 if none."""
    out = np.zeros(len(ends), np.int64)
    for char in chars:
        code = char.encode()
        at = np.flatnonzero((ends - starts >= len(code)) & (data[ends - 1] == code[-1]))
        for k in range(2, len(code) + 1):
            at = at[data[ends[at] - k] == code[-k]]
        out[at] = len(code)
    return out


def closed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether words end with a stop, behind which quotes and brackets may close."""
    at, to = np.arange(len(ends)), ends.copy()
    while len(at):
        size = _ending(data, starts[at], to[at], CLOSERS)
        to[at] -= size
        at = at[(size > 0) & (to[at] > starts[at])]
    out = to > starts
    out[out] = _ending(data, starts[out], to[out], STOPS) > 0
    return out


def cuts(hashes: np.ndarray, new: np.ndarray, longest: int) -> np.ndarray:
    """Whether a word starts a piece: of every `longest` words in a row that start no sentence, the last of those whose
    pair with the word before has the smallest hash."""
    out = np.zeros(len(new), bool)
    n = len(new) - longest + 1
    if n <= 0:
        return out
    value = np.zeros(len(new), np.uint64)
    value[1:] = mix(hashes[:-1] * np.uint64(0x9FB21C651E98DF25) + hashes[1:])
    count = np.concatenate(([0], np.cumsum(new)))
    at = np.flatnonzero(count[longest:] == count[:n])
    best, where = value[at], at.copy()
    for k in range(1, longest):
        other = value[at + k]
        less = other <= best
        best[less], where[less] = other[less], at[less] + k
    out[where] = True
    return out


def sentences(texts: pa.Array, longest: int) -> tuple[np.ndarray, ...]:
    """Of all words: start, end; first word of every sentence (n + 1); first sentence of every text (n + 1)."""
    data, offsets = text_bytes(texts)
    starts, ends, first = words(data, offsets, SPACE)
    n = len(starts)
    new = np.zeros(n + 1, bool)
    new[first] = True
    if n:
        lines = np.concatenate(([0], np.cumsum(LINE[data])))
        new[1:n] |= (lines[starts[1:]] > lines[ends[:-1]]) | closed(data, starts[:-1], ends[:-1])
        new[:n] |= cuts(span_hashes(data, starts, ends), new[:n], longest)
    begin = np.append(np.flatnonzero(new[:n]), n)
    return data, starts, ends, begin, np.searchsorted(begin, first)


def spans(begin: np.ndarray, first: np.ndarray, least_sentences: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """From and to (exclusive) of every span, as sentences: the shortest from each start and the shortest to each end."""
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a < least_sentences:
            continue
        at = begin[a : b + 1]
        k = np.arange(b - a)
        to = np.maximum(np.searchsorted(at, at[:-1] + least_words), k + least_sentences)
        ok = to <= b - a
        out.append(np.stack((k[ok], to[ok])) + a)
        back = np.minimum(np.searchsorted(at, at[1:] - least_words, "right") - 1, k + 1 - least_sentences)
        ok = back >= 0
        out.append(np.stack((back[ok], k[ok] + 1)) + a)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.concatenate(out, axis=1)
    packed = np.unique(both[0] << 32 | both[1])
    return packed >> 32, packed & 0xFFFFFFFF


def later(place: list[np.ndarray], hashes: list[np.ndarray]) -> np.ndarray:
    """Whether a span stands after another of the same hashes in this batch: whatever comes first in the whole table, such
    a span is a repeat. Spans of one place (rows that repeat doc_id and text) are all kept."""
    out = np.zeros(len(hashes[0]), bool)
    order = np.argsort(hashes[0], kind="stable")
    equal = hashes[0][order[1:]] == hashes[0][order[:-1]]
    at = order[np.append(equal, False)[: len(order)] | np.insert(equal, 0, False)[: len(order)]]
    if len(at):
        at = at[np.lexsort([x[at] for x in (*place[::-1], *hashes[::-1])])]
        starts = np.append(True, np.any([x[at[1:]] != x[at[:-1]] for x in hashes], axis=0))
        first = at[np.flatnonzero(starts)][np.cumsum(starts) - 1]
        out[at] = np.any([x[at] != x[first] for x in place], axis=0)
    return out


def covered(of: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The fewest ranges (of, a, b) that cover the same sentences of the same documents."""
    order = np.lexsort((a, of))
    of, a, b = of[order], a[order], b[order]
    start, reach = (of << 32) + a, np.maximum.accumulate((of << 32) + b)
    new = np.append(True, start[1:] > reach[:-1])[: len(of)]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(of) - 1)[: int(new.sum())]
    return of[new], a[new], reach[last] & 0xFFFFFFFF


def document_spans(docs: DataFrame, longest: int, least_sentences: int, least_words: int) -> DataFrame:
    """row, doc_id, a, b, h1, h2: each document's spans of sentences. Ranges with no h2 are repeats for certain, found
    within a batch of rows, so a span that very many documents hold goes on once a batch; their h1 only spreads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, seen = [], 0
            for part, texts in chunks(batch, "text"):
                data, starts, ends, begin, first = sentences(texts, longest)
                a, b = spans(begin, first, least_sentences, least_words)
                of = np.searchsorted(first, a, "right") - 1
                lanes = [span_hashes(span_hashes(data, starts, ends, seed), begin[a], begin[b], seed) for seed in SEEDS]
                found.append((of + seen, a - first[of], b - first[of], *lanes))
                seen += len(part)
            if not found:
                continue
            of, a, b, h1, h2 = (np.concatenate(x) for x in zip(*found))
            row, doc = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("row", "doc_id"))
            sure = later([doc[of], row[of], a, b], [h1, h2])
            sure_of, sure_a, sure_b = covered(of[sure], a[sure], b[sure])
            of, a, b = (np.concatenate((x[~sure], y)) for x, y in ((of, sure_of), (a, sure_a), (b, sure_b)))
            h1, h2 = (np.concatenate((x[~sure].view(np.int64), row[sure_of])) for x in (h1, h2))
            none = np.arange(len(of)) >= len(of) - len(sure_of)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[of]), pa.array(doc[of]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(h1), pa.array(h2, mask=none)], ["row", "doc_id", "a", "b", "h1", "h2"]
            )

    return docs.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, a int, b int, h1 long, h2 long")


def repeated_spans(found: DataFrame) -> DataFrame:
    """doc_id, row, a, b of every occurrence of a span but its first, those found within batches as ranges."""
    place = F.struct(F.col("doc_id"), F.col("row"), F.col("a"), F.col("b"))
    met = found.withColumn("first", F.min(place).over(Window.partitionBy("h1", "h2")))
    return met.filter(F.col("h2").isNull() | (place > F.col("first"))).select("doc_id", "row", "a", "b")


def remove_repeats(docs: DataFrame, longest: int = 10, least_sentences: int = 2, least_words: int = 20) -> DataFrame:
    """doc_id, n_sentences, n_removed, removed (numbers of the sentences that go), text (without them)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.xxhash64("text").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    gone = repeated_spans(document_spans(rows, longest, least_sentences, least_words))
    gone = materialize(gone.groupBy("doc_id", "row").agg(F.collect_set(F.struct("a", "b")).alias("gone")))  # at most the ranges of one text, however often it stands there

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                data, starts, ends, begin, first = sentences(texts, longest)
                raw = data.tobytes()
                _, offsets = text_bytes(texts)
                edges = np.append(starts, len(data))
                out = []
                for i, (doc, spans_) in enumerate(zip(part.column(part.schema.get_field_index("doc_id")).to_pylist(), part.column(part.schema.get_field_index("gone")).to_pylist())):
                    n = int(first[i + 1] - first[i])
                    drop = np.zeros(n + 1, np.int64)
                    for s in spans_ or ():
                        drop[s["a"]] += 1
                        drop[s["b"]] -= 1
                    drop = np.cumsum(drop)[:n] > 0
                    a, b = int(offsets[i]), int(offsets[i + 1])
                    if drop.any():
                        cuts = np.append(np.minimum(edges[begin[first[i] : first[i + 1]]], b), b)
                        text = raw[a : cuts[0]] + b"".join(raw[cuts[k] : cuts[k + 1]] for k in np.flatnonzero(~drop))
                    else:
                        text = raw[a:b]
                    removed = np.flatnonzero(drop)
                    out.append((doc, n, len(removed), removed.tolist(), text.decode()))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["doc_id", "n_sentences", "n_removed", "removed", "text"])

    joined = rows.join(gone.hint("merge"), ["doc_id", "row"], "left").select("doc_id", "text", "gone")
    out = joined.mapInArrow(cut, "doc_id long, n_sentences long, n_removed long, removed array<int>, text string")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
