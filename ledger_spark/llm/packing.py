"""Packing of documents into sequences of at most `capacity` tokens by swap-based local search.

How many pieces there are of each length, 1 to capacity, is all that packing needs: at most `capacity` numbers, however
many documents. Bins of equal content are one class with a multiplicity. The search starts from one document per bin and raises the sum of squared fills until bins empty: first all
documents of one bin move to another at once, where two bins fit into one; then documents move or are exchanged (one for
one, two for one, one for two) between underfull bins, in a scaled copy of the problem before the problem itself, within
a stated effort: planning takes bounded work at any input size. Spark then deals every piece its place: the rank among pieces of
its length, counted in buckets that rows (not ids) are dealt to, names the bin.

Null and empty texts are documents of no ids and so pieces of length 1 (the closing id 0). A longer text is cut into
full pieces from its end; its first piece takes the rest. Repeated rows are packed as often as they occur. Further
columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import logging
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import chunks, materialize, parallelism, small_batches
from .tokens import encoder

LOG = logging.getLogger(__name__)
Bin = tuple[tuple[int, int], ...]  # (length, copies), longest first
EFFORT = 1_000_000  # pairs of classes that the search for exchanges looks at
SCALE = 4
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the documents' ids, each followed by end_id, in pieces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                ids, ends = encode(texts.to_pylist())
                out: list[tuple] = []
                for doc, a, b in zip(part.column(0).to_pylist(), ends[:-1], ends[1:]):
                    own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    first = (len(own) - 1) % capacity + 1
                    for piece, to in enumerate(range(first, len(own) + 1, capacity)):
                        at = 0 if piece == 0 else to - capacity
                        out.append((doc, piece, at, to - at, zlib.crc32(own[at:to].tobytes())))
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


@lru_cache(1 << 16)
def _fill(bin_: Bin) -> int:
    return sum(a * n for a, n in bin_)


def _changed(bin_: Bin, out: tuple[int, ...], come: tuple[int, ...]) -> Bin:
    items = dict(bin_)
    for x in out:
        items[x] -= 1
    for x in come:
        items[x] = items.get(x, 0) + 1
    return tuple(sorted(((a, n) for a, n in items.items() if n), reverse=True))


def _add(bins: dict[Bin, int], bin_: Bin, n: int):
    bins[bin_] = bins.get(bin_, 0) + n
    if not bins[bin_]:
        del bins[bin_]


def move_all(counts: dict[int, int], capacity: int) -> dict[Bin, int]:
    """From one document per bin, empty bins by moving all that they hold into another one: always the two bins whose
    union raises the sum of squared fills most (by twice the product of their fills), until no two fit into one or the
    tokens need all bins that are left. Classes of one fill are kept together, so a step looks at `capacity` fills."""
    classes = [{} for _ in range(capacity + 1)]
    many = np.zeros(capacity + 1, np.int64)  # bins of each fill
    for length, n in counts.items():
        classes[length][((length, 1),)] = many[length] = n
    fills = np.arange(capacity + 1)
    spare = int(many.sum()) + int(-(many * fills).sum() // capacity)  # bins beyond the least number
    while spare > 0:
        here = np.where(many > 0, fills, 0)
        largest = np.maximum.accumulate(here)
        mate = largest[capacity - fills]
        mate = np.where((mate == fills) & (many < 2), np.append(0, largest)[mate], mate)
        one = int((here * mate).argmax())
        two = int(mate[one])
        if not here[one] * two:
            break
        taker, n = next(iter(classes[one].items()))
        if one == two and n > 1:
            giver, n = taker, n // 2
        else:
            giver, k = next((b, k) for b, k in classes[two].items() if b != taker)
            n = min(n, k)
        n = min(n, spare)
        both = _changed(taker, (), tuple(a for a, k in giver for _ in range(k)))
        for fill, bin_, change in ((one, taker, -n), (two, giver, -n), (one + two, both, n)):
            _add(classes[fill], bin_, change)
            many[fill] += change
        spare -= n
    return {bin_: n for of_fill in classes for bin_, n in of_fill.items()}


@lru_cache(1 << 14)
def _sets(bin_: Bin) -> list[tuple[int, tuple[int, ...]]]:
    """Every choice of one or two documents of a bin: size and lengths, by size."""
    ones = [(a,) for a, _ in bin_]
    twos = [(a, b) for i, (a, n) in enumerate(bin_) for j, (b, _) in enumerate(bin_) if j > i or (i == j and n > 1)]
    return sorted((sum(s), s) for s in ones + twos)


@lru_cache(1 << 14)
def _returns(bin_: Bin, most: int) -> tuple[list[int], list[tuple[int, ...]]]:
    """What a bin can give back, nothing or up to `most` documents: sizes in order, and lengths."""
    sets = [(0, ()), *(s for s in _sets(bin_) if len(s[1]) <= most)]
    return [size for size, _ in sets], [lengths for _, lengths in sets]


def _exchange(giver: Bin, taker: Bin, room: int) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
    """The exchange that sends most tokens from giver to taker: a move, one for one, two for one or one for two."""
    best, most = None, 0
    for size, out in reversed(_sets(giver)):
        if size <= most or most == room:
            break
        sizes, back = _returns(taker, 3 - len(out))
        k = bisect_left(sizes, size - room)
        if k < len(sizes) and size - sizes[k] > most:
            best, most = (size - sizes[k], out, back[k]), size - sizes[k]
    return best


class Effort:
    """How many pairs of classes a search may still look at for an exchange."""

    def __init__(self, left: int = EFFORT):
        self.left = left


def exchange(bins: dict[Bin, int], capacity: int, effort: Effort | None = None) -> dict[Bin, int]:
    """Raise the sum of squared fills by moves and exchanges between underfull bins until none helps, or until there are
    no more bins than tokens need at least. Each step empties the least full bin further into one of the others, that
    which raises the sum most. The sum grows with every step and is bounded, so the search ends; it also ends, with the
    bins as they are, when the effort is spent.

    Takers are tried by what they could gain at most, so that most need no look; a giver that no taker helps is looked
    at again only with bins that came up since."""
    bins = dict(bins)
    spare = sum(bins.values()) + -sum(_fill(b) * n for b, n in bins.items()) // capacity
    step, born, tried = 0, dict.fromkeys(bins, 0), {}
    effort = effort or Effort()
    while spare > 0 and effort.left > 0:
        under = sorted((b for b in bins if _fill(b) < capacity), key=_fill)
        best = None
        for giver in under:
            since = tried.get(giver, -1)
            if since == step:
                continue
            own, hopes = _fill(giver), []
            for taker in under:
                if born[taker] > since and _fill(taker) >= own and (taker != giver or bins[giver] > 1):
                    most = min(own, capacity - _fill(taker))
                    hopes.append((most * (_fill(taker) - own + most), taker))
            for hope, taker in sorted(hopes, key=lambda h: -h[0]):
                if best and hope <= best[0]:
                    break
                effort.left -= 1
                if found := _exchange(giver, taker, capacity - _fill(taker)):
                    gain = found[0] * (_fill(taker) - own + found[0])
                    if best is None or gain > best[0]:
                        best = (gain, taker, *found[1:])
            if best:
                break
            tried[giver] = step
        if best is None:
            break
        step += 1
        _, taker, out, back = best
        n = bins[giver] // 2 if taker == giver else min(bins[giver], bins[taker])
        _add(bins, giver, -n)
        _add(bins, taker, -n)
        for new in (_changed(giver, out, back), _changed(taker, back, out)):
            if not new:
                spare -= n
                continue
            if bins.get(new, 0) < 2:
                born[new] = step
            _add(bins, new, n)
    LOG.info("%d exchanges between %d classes of bins", step, len(bins))
    return bins


def local_search(counts: dict[int, int], capacity: int, effort: int = EFFORT) -> dict[Bin, int]:
    """Classes of bins for documents of these lengths, and how many there are of each.

    Exchanges are searched for in SCALE-th parts first: of every class that many bins together count as one, what is left
    of a class stays as it is, and what is found holds for all of them at once. The parts get finer until a part is a bin.
    So most exchanges are found in a copy of the problem whose size doesn't depend on the number of documents; all
    scales share one effort, which bounds the work."""
    bins, left = move_all(counts, capacity), Effort(effort)
    part = 1
    while max(bins.values(), default=0) >= part * SCALE:
        part *= SCALE
    while part:
        some = exchange({b: n // part for b, n in bins.items() if n >= part}, capacity, left)
        bins = {b: n % part for b, n in bins.items() if n % part}
        for b, n in some.items():
            bins[b] = bins.get(b, 0) + n * part
        part //= SCALE
    return bins


def places(bins: dict[Bin, int]) -> dict[str, np.ndarray]:
    """For every length, which ranks go to which bins: rows (length, rank from, copies, bin, offset) sorted by the
    first two. One row stands for all copies of a length in all bins of a class."""
    rows, taken, sequence = [], {}, 0
    for bin_, n in sorted(bins.items(), reverse=True):
        offset = 0
        for length, copies in bin_:
            rows.append((length, taken.get(length, 0), copies, sequence, offset))
            taken[length] = taken.get(length, 0) + copies * n
            offset += length * copies
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "copies", "sequence", "offset"), table.T))


def plan(pieces: DataFrame, capacity: int) -> dict[str, np.ndarray]:
    """The histogram of lengths (at most `capacity` rows) comes to the driver, and the bins' classes come from it."""
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    return places(local_search(counts, capacity))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece with sequence_id and offset, the pieces' places; every sequence is filled from 0 without gaps."""
    spark = docs.sparkSession
    salt = parallelism(spark)
    pieces = materialize(token_pieces(docs, tokenizer, capacity, end_id).withColumn("bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salt)).cast("int")))
    table = spark.sparkContext.broadcast(plan(pieces, capacity))

    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(own).cast("long") - 1).join(base.hint("merge"), ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        wide = np.int64(1) << 48
        key = t["length"] * wide + t["rank"]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = np.searchsorted(key, length * wide + rank, "right") - 1
            nth = rank - t["rank"][row]
            sequence = t["sequence"][row] + nth // t["copies"][row]
            offset = t["offset"][row] + nth % t["copies"][row] * length
            own = [batch.column(k) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(assign, PIECES + ", sequence_id long, offset long")
