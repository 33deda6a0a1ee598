"""Attention-based multiple-instance quality classifier.

A document is a bag of passages of `PASSAGE` words; only the document has a label. Every passage is encoded: the shares
of pairs of neighbouring character classes, and how its words repeat, go through one learned layer. A gated attention
(a tanh and a sigmoid branch, multiplied) learns each passage's weight from the documents' labels, and the weighted mean
of the passages' codes is scored by a logistic output.

The model is fitted on all passages of at most `per_class` labelled documents of each label, taken in the order of a hash
of doc_id (their passages, 272 bytes each, come to the driver; of rows that repeat an id one is taken, that of the
smallest hash); scoring reads every passage of every text. Documents
whose crc32(doc_id as text) mod 4 is 2 are held out of fitting.

Null and empty texts are one passage of zeros and get a score like any other. Contradicting labels of a document are
left out. If no document or only one kind is labelled there is nothing to tell apart: every score is then 1, or 0 if
only label 0 was seen. Repeated rows get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import chunks, small_batches, text_bytes
from .wordhash import span_hashes, words

PASSAGE = 100
CLASSES = 8
FEATURES = CLASSES * CLASSES + 4


def _byte_classes() -> np.ndarray:
    """Control and others 0, small letters 1, capitals 2, digits 3, blanks 4, line ends 5, common punctuation 6, beyond ASCII 7."""
    out = np.zeros(256, np.uint8)
    out[97:123], out[65:91], out[48:58], out[128:] = 1, 2, 3, 7
    out[[9, 32]], out[[10, 13]] = 4, 5
    out[[ord(c) for c in ".,;:'\"-()?"]] = 6
    return out


BYTE_CLASSES = _byte_classes()
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (float32 rows), and the n + 1 offsets of the texts in them."""
    data, offsets = text_bytes(texts)
    starts, ends, first = words(data, offsets, SPACE)
    counts = np.diff(first)
    per_text = np.maximum(-(-counts // PASSAGE), 1)
    at = np.concatenate(([0], np.cumsum(per_text)))
    total = int(at[-1])
    out = np.zeros((total, FEATURES), np.float32)
    if not len(starts):
        return out, at
    text_of = np.repeat(np.arange(len(counts)), counts)
    of = at[text_of] + (np.arange(len(starts)) - first[text_of]) // PASSAGE
    begin = np.flatnonzero(np.diff(of, prepend=-1))  # first word of each passage that has words
    used = of[begin]
    spans = np.append(starts[begin], len(data))
    spans[1:] = np.minimum(spans[1:], offsets[np.searchsorted(offsets, spans[:-1], "right")])
    kinds = BYTE_CLASSES[data].astype(np.int64)
    pair = kinds[:-1] * CLASSES + kinds[1:]
    mark = np.zeros(len(data) + 1, np.int64)
    mark[spans[:-1]] = 1
    owner = used[np.maximum(np.cumsum(mark[:-1]) - 1, 0)][: len(pair)]
    out[:, : CLASSES * CLASSES] = np.bincount(owner * CLASSES**2 + pair, minlength=total * CLASSES**2)[: total * CLASSES**2].reshape(total, -1)
    out[:, : CLASSES * CLASSES] /= np.maximum(out[:, : CLASSES * CLASSES].sum(axis=1, keepdims=True), 1)
    hashes = span_hashes(data, starts, ends)
    size = np.maximum(np.bincount(of, minlength=total), 1)
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((hashes, of))
    new = np.ones(len(hashes))
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
    out[:, -4] = np.bincount(of, same, total) / size
    out[:, -3] = np.bincount(of[order], new, total) / size
    out[:, -2] = np.bincount(of, ends - starts, total) / size / 20
    out[:, -1] = np.log1p(size) / 5
    out[np.bincount(of, minlength=total) == 0] = 0
    return out, at


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(w: dict[str, np.ndarray], x: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Scores of bags x[at[i]:at[i + 1]] and what learning needs."""
    h = np.tanh(((x - w["mean"]) / w["scale"]) @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    e = (t * g) @ w["a"]
    peak = np.maximum.reduceat(e, at[:-1])
    size = np.diff(at)
    e = np.exp(e - np.repeat(peak, size))
    alpha = e / np.repeat(np.add.reduceat(e, at[:-1]), size)
    z = np.add.reduceat(alpha[:, None] * h, at[:-1], axis=0)
    return {"h": h, "t": t, "g": g, "alpha": alpha, "z": z, "p": _sigmoid(z @ w["c"] + w["d"])}


def _gradients(w, x, at, y) -> dict[str, np.ndarray]:
    f, size = forward(w, x, at), np.diff(at)
    dp = (f["p"] - y) / len(y)
    dz = np.repeat(dp, size)[:, None] * w["c"]
    dalpha = (dz * f["h"]).sum(axis=1)
    mean = np.repeat(np.add.reduceat(f["alpha"] * dalpha, at[:-1]), size)
    de = f["alpha"] * (dalpha - mean)
    dt, dg = de[:, None] * w["a"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * w["a"] * f["t"] * f["g"] * (1 - f["g"])
    dh = (f["alpha"][:, None] * dz + dt @ w["V"].T + dg @ w["U"].T) * (1 - f["h"] ** 2)
    xs = (x - w["mean"]) / w["scale"]
    return {"W": xs.T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ dp, "d": dp.sum()}


def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 40, rate: float = 0.01, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights by Adam over shuffled batches of bags."""
    rng, every = np.random.default_rng(seed), np.concatenate(bags)
    normal = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    w = {"mean": every.mean(axis=0), "scale": every.std(axis=0) + 0.02, "W": normal(FEATURES, hidden), "b": np.zeros(hidden), "V": normal(hidden, gate), "U": normal(hidden, gate), "a": normal(gate), "c": normal(hidden), "d": np.zeros(())}
    learned = [k for k in w if k not in ("mean", "scale")]
    first, second, step = {k: 0.0 for k in learned}, {k: 0.0 for k in learned}, 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for k in range(0, len(order), 128):
            some, step = order[k : k + 128], step + 1
            x, at = np.concatenate([bags[i] for i in some]), np.concatenate(([0], np.cumsum([len(bags[i]) for i in some])))
            for name, g in _gradients(w, x, at, labels[some]).items():
                g = g + 1e-4 * w[name]
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                w[name] = w[name] - rate * first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    return w


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> dict[str, np.ndarray]:
    """Weights from the labelled documents that aren't held out; {"share": s} where nothing can be told apart."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).filter("quality = most").drop("most")
    sample = None
    for label in (0, 1):
        part = known.filter(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        sample = part if sample is None else sample.unionByName(part)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                x, at = passages(texts)
                bags = [x[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in ("doc_id", "quality")] + [pa.array(bags, pa.binary())], ["doc_id", "quality", "bag"])

    chosen = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))), "doc_id")
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "quality")).alias("r")  # of rows that repeat an id, one
    chosen = chosen.groupBy("doc_id").agg(first).select("doc_id", "r.text", "r.quality")
    rows = chosen.mapInArrow(encode, "doc_id long, quality int, bag binary").collect()  # at most 2 * per_class documents
    rows.sort(key=lambda r: (r["doc_id"], r["bag"]))
    kinds = {r["quality"] for r in rows}
    if len(kinds) < 2:
        return {"share": np.array(0.0 if kinds == {0} else 1.0)}
    return fit([np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES).astype(np.float64) for r in rows], np.array([r["quality"] for r in rows], float))


def scorer(spark: SparkSession, weights: dict[str, np.ndarray]):
    """A column function: the score of whole texts under these weights."""
    held = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        w, out = held.value, []
        if "share" in w:
            return pd.Series(float(w["share"]), texts.index)
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
        for _, part in chunks(batch, "text"):
            x, at = passages(part)
            out.append(forward(w, x.astype(np.float64), at)["p"])
        return pd.Series(np.concatenate(out) if out else [], texts.index, float)

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, keep: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    score = scorer(docs.sparkSession, train(docs, labels))
    scored = docs.select(F.col("doc_id").cast("long"), score("text").alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= keep).cast("int").alias("predicted"))
