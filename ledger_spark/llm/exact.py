"""Exact dedup of a table against minimal perfect hashes over the distinct digests of its history.

The history's distinct digests are dealt to buckets of bounded size. Every bucket has its own minimal perfect hash: a
few levels of bit arrays, where a digest sits at the first level at which no other digest claims its position, and the
rank of its bit is its slot. A slot holds the full digest and the winner's locator. A lookup goes to one slot and
compares all 32 bytes: members are repeats of the history, all others are grouped among themselves. A locator is the
doc_id and the row's number in the scratch table, so that of rows that repeat a doc_id exactly one stays.

Rows are reduced to distinct digests before they meet the index, so a text that makes up a third of the table is one
lookup. Null texts count as empty. A null doc_id is smaller than any other. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import empty_for_null, materialize
from .wordhash import mix

INDEX = "bucket int, slots int, levels array<binary>, digests binary, winners binary, sizes binary"
GAMMA = 1.5
HOT = 1000  # texts that make up more than a thousandth of all rows, so fewer than this many, meet their rows by broadcast


def digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.encode(empty_for_null(text), "UTF-8"), 256))


def bucket_of(digest_: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(digest_), F.lit(buckets)).cast("int")


def _positions(digests: np.ndarray, level: int, size: int) -> np.ndarray:
    lanes = digests.view("<u8").reshape(-1, 4)
    return (mix(lanes[:, 0] + lanes[:, 1] * np.uint64(2 * level + 1) + np.uint64(level)) % np.uint64(size)).astype(np.int64)


def build_levels(digests: np.ndarray) -> list[np.ndarray]:
    """Bit arrays of a minimal perfect hash over distinct digests (n x 32 bytes)."""
    levels, left = [], digests
    while len(left):
        size = max(64, int(GAMMA * len(left)) // 8 * 8 + 8)
        at = _positions(left, len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(np.packbits(alone, bitorder="little"))
        left = left[~alone[at]]
    return levels


def slots_of(digests: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The slot that each digest would have; -1 if no level has a bit for it. Only comparing with the slot's own
    digest tells members from others."""
    out = np.full(len(digests), -1, np.int64)
    open_, base = np.arange(len(digests)), 0
    for k, packed in enumerate(levels):
        bits = np.unpackbits(packed, bitorder="little")
        at = _positions(digests[open_], k, len(bits))
        hit = bits[at] == 1
        rank = np.cumsum(bits, dtype=np.int64)
        out[open_[hit]] = base + rank[at[hit]] - 1
        open_, base = open_[~hit], base + int(rank[-1])
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 32).copy()


def build_index(groups: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket from groups(digest, winner, row, size) of distinct digests."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        digests = _matrix(rows["digest"])
        levels = build_levels(digests)
        order = np.argsort(slots_of(digests, levels))
        packed = [digests[order].tobytes(), rows[["winner", "row"]].to_numpy("<i8")[order].tobytes(), rows["size"].to_numpy("<i8")[order].tobytes()]
        return pd.DataFrame([[key[0], len(rows), [x.tobytes() for x in levels], *packed]], columns=["bucket", "slots", "levels", "digests", "winners", "sizes"])

    return groups.select("digest", "winner", "row", "size", bucket_of("digest", buckets).alias("bucket")).groupBy("bucket").applyInPandas(build, INDEX)


def lookup(groups: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """groups(digest, winner, row, size) with member, old_winner, old_row and old_size: what the slot that holds the
    digest says, else 0."""

    def probe(key: tuple, rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = rows[["digest", "winner", "row", "size"]].copy()
        same, old = np.zeros(len(rows), bool), np.zeros((len(rows), 3), np.int64)
        if len(held) and len(rows):
            own, one = _matrix(rows["digest"]), held.iloc[0]
            slot = slots_of(own, [np.frombuffer(x, np.uint8) for x in one["levels"]])
            kept = np.frombuffer(one["digests"], np.uint8).reshape(-1, 32)
            same = (slot >= 0) & (kept[np.maximum(slot, 0)] == own).all(axis=1)
            old[same, :2] = np.frombuffer(one["winners"], "<i8").reshape(-1, 2)[slot[same]]
            old[same, 2] = np.frombuffer(one["sizes"], "<i8")[slot[same]]
        return out.assign(member=same, old_winner=old[:, 0], old_row=old[:, 1], old_size=old[:, 2])

    schema = "digest binary, winner long, row long, size long, member boolean, old_winner long, old_row long, old_size long"
    keyed = groups.select("digest", "winner", "row", "size", bucket_of("digest", buckets).alias("bucket"))
    return keyed.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(probe, schema)


NO_ID = -(1 << 63)


def grouped(rows: DataFrame) -> DataFrame:
    """digest, winner (largest doc_id) and its row, size."""
    best = F.max(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("winner"), F.col("row_id").alias("row")))
    return rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("size")).select("digest", "best.winner", "best.row", "size")


def buckets_for(rows: int, per_bucket: int = 4096) -> int:
    return max(8, -(-rows // per_bucket))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs.

    The lower half of the doc_id range is the history, whose distinct digests are indexed; the rest arrives after it.
    Of equal texts the row with the largest doc_id stays; of rows that repeat it, one.
    """
    rows = materialize(docs.select(F.col("doc_id").cast("long"), digest().alias("digest"), F.monotonically_increasing_id().alias("row_id")))
    total, low, high = rows.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    buckets = buckets_for(total)
    old = F.coalesce(F.col("doc_id") <= (0 if low is None else (low + high) // 2), F.lit(True))
    history, arrived = grouped(rows.filter(old)), grouped(rows.filter(~old))
    index = materialize(build_index(history, buckets))
    found = lookup(arrived, index, buckets)
    newer = F.greatest(F.struct("winner", "row"), F.struct(F.col("old_winner").alias("winner"), F.col("old_row").alias("row")))
    repeats = found.filter("member").select("digest", newer.alias("best"), (F.col("size") + F.col("old_size")).alias("size"))
    fresh = found.filter("not member").select("digest", F.struct("winner", "row").alias("best"), "size")
    known = history.select("digest", F.struct("winner", "row").alias("best"), "size")
    groups = materialize(known.unionByName(repeats).unionByName(fresh).groupBy("digest").agg(F.max("best").alias("best"), F.max("size").alias("size")))
    hot = F.col("size") * HOT > total
    often = F.broadcast(groups.filter(hot))
    rare = rows.join(often.select("digest"), "digest", "left_anti").join(groups.filter(~hot).hint("merge"), "digest")
    joined = rows.join(often, "digest").unionByName(rare)
    keep = F.nullif(F.col("best.winner"), F.lit(NO_ID))
    return joined.select("doc_id", keep.alias("keep_id"), F.col("size").alias("group_size"), (F.col("row_id") == F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
