"""N-gram Jaccard self-join: size-banded tiles, bitmap signatures, then exact intersection of sorted arrays.

Texts with one shingle set are one set, told apart by 128 bits of a digest over it. Linked sets share a shingle among
the first n - ceil(t n) + 1 of each in any fixed order. The order here puts frequent shingles last, and is otherwise the
hash's.

1. Per document: set, size, signature, and the prefix in hash order. Shingles of these prefixes are counted over all
   documents. The most frequent ones are listed for every task: all that stand in two prefixes, or in a larger table
   in more, so that the list holds at most MOST_FREQUENT hashes.
2. Prefixes in the final order meet by shingle. A shingle's leader is the smallest set that holds it; sets that share a
   shingle also share its leader. So a set takes a place with each leader once, however many shingles they have in
   common. Sets without shared shingles are done.
3. A leader's sets are a tile. Large ones are cut into bands of size, as linked sets differ in size by the threshold at
   most, and bands into salted parts; each pair of parts is a tile of its own.
4. Three passes over tiles leave less and less: pairs must fit by their sizes and by how many of their prefix shingles
   are shared at all; then by signatures of four to eight bits a shingle (bits that one has and the other lacks bound the
   overlap from above); what still has a partner gets its sorted array, and pairs are intersected exactly. A tile joins
   what it finds linked and returns the links that join two of its groups, at most one less than it has rows.
5. Components over the links of all tiles.

Steps 3 to 5 are done twice. First each set is in one tile only, its smallest leader's, so that a family of near copies
becomes few components with each array sent once. Then all tiles meet, and only pairs of different components that have
not met are compared: every pair that shares a prefix shingle is in one component or has been compared.

No pair leaves a tile before it is known to be linked. A band of more than a tile's rows stands in one tile for each pair
of its parts, so rows of a leader whose band holds k of them are copied k / TILE times; copies without a partner go in
the first two passes, before signatures and arrays are joined.

Null and wordless texts have empty sets and no links. A null doc_id is smaller than any other. Repeated rows are equal
sets, each with its own result row. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import chunks, materialize, small_batches, text_bytes
from .wordhash import lowered, run_hashes, span_hashes, words

SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
MOST_FREQUENT = 1 << 21  # shingles that may come last
TILE, TILE_SHINGLES = 2048, 1 << 21  # rows of a part of a tile, and shingles in all its sets
SEEN = 1_000_000  # sets that a task remembers
NO_ID = -(1 << 63)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text (uint64)."""
    data, offsets = text_bytes(texts)
    data = lowered(data)
    starts, ends, first = words(data, offsets, SPACE)
    hashes = span_hashes(data, starts, ends)
    runs = run_hashes(hashes, width)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        else:
            yield run_hashes(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def set_id(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    both = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(both[:8], "little", signed=True), int.from_bytes(both[8:], "little", signed=True)


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


def signature(shingles: np.ndarray) -> np.ndarray:
    """A bitmap of four to eight bits a shingle, as words of 64; its length is a power of two. Half of it laid over the
    other half is the signature of half the length."""
    size = max(256, 1 << (4 * len(shingles) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(shingles >> np.uint64(16)) & np.uint64(size - 1)] = True
    return np.packbits(bits, bitorder="little").view("<u8")


def document_sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, hi, lo (the set's name), n, sig, low: a document's set, its signature and its prefix in hash order (null
    and empty where the task has seen the set)."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                rows = []
                for s in shingle_sets(texts, width):
                    name = set_id(s)
                    known = name in seen
                    rows.append((*name, len(s), None if known else signature(s).tobytes(), s[: 0 if known else prefix_length(len(s), percent)].view(np.int64)))
                    if len(seen) < SEEN:
                        seen.add(name)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], ["doc_id", "hi", "lo", "n", "sig", "low"])

    return docs.mapInArrow(run, "doc_id long, hi long, lo long, n long, sig binary, low array<long>")


def frequent_shingles(sets: DataFrame, most: int = MOST_FREQUENT) -> np.ndarray:
    """The sorted hashes of shingles in more than f prefixes, f being the smallest power of two that leaves at most `most`
    of them."""
    counts = sets.select(F.explode("low").alias("token")).groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    counts = materialize(counts)
    above = counts.agg(*(F.count_if(F.col("df") > (1 << k)).alias(str(k)) for k in range(48))).first()
    least = next((k for k in range(48) if above[str(k)] <= most), 48)
    return np.sort(counts.filter(F.col("df") > (1 << least)).select("token").toArrow()["token"].to_numpy().view(np.uint64))


def ordered_prefix(shingles: np.ndarray, p: int, last: np.ndarray) -> np.ndarray:
    """The first p of a set where those in `last` come behind all others."""
    for upto in (min(len(shingles), 2 * p + 16), len(shingles)):
        s = shingles[:upto]
        late = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s if len(last) else np.zeros(upto, bool)
        if upto - late.sum() >= p or upto == len(shingles):
            rare = s[~late][:p]
            return rare if len(rare) == p else np.concatenate((rare, s[late][: p - len(rare)]))


def prefixes(docs: DataFrame, width: int, percent: int, last: np.ndarray) -> DataFrame:
    """token, hi, lo: each set's prefix in the final order; a set once per task."""
    held = docs.sparkSession.sparkContext.broadcast(last)

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for _, texts in chunks(batch, "text"):
                tokens, names = [np.zeros(0, np.uint64)], []
                for s in shingle_sets(texts, width):
                    name = set_id(s)
                    if name in seen or not len(s):
                        continue
                    if len(seen) < SEEN:
                        seen.add(name)
                    tokens.append(ordered_prefix(s, prefix_length(len(s), percent), held.value))
                    names.append(name)
                both = np.repeat(np.array(names, np.int64).reshape(-1, 2), [len(t) for t in tokens[1:]], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.concatenate(tokens).view(np.int64), both[:, 0], both[:, 1])], ["token", "hi", "lo"])

    return docs.select("text").mapInArrow(run, "token long, hi long, lo long")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """hi, lo, arr: sorted shingles as bytes, each set once."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for _, texts in chunks(batch, "text"):
                rows = []
                for s in shingle_sets(texts, width):
                    name = set_id(s)
                    if name not in seen:
                        rows.append((*name, s.tobytes()))
                    if len(seen) < SEEN:
                        seen.add(name)
                columns = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], ["hi", "lo", "arr"])

    return docs.select("text").mapInArrow(run, "hi long, lo long, arr binary").dropDuplicates(["hi", "lo"])


def members(docs: DataFrame, unique: DataFrame, width: int, percent: int, last: np.ndarray) -> DataFrame:
    """leader, node, n, s, main: the sets that have a shingle in common with a leader, one row for each of the two; s is
    at least the number of a set's prefix shingles that any other set's prefix holds; main marks its smallest leader."""
    rows = materialize(prefixes(docs, width, percent, last))
    shared = rows.groupBy("token").agg(F.min("hi").alias("leader"), F.max("hi").alias("other")).filter("leader < other").select("token", "leader")
    met = rows.join(shared.hint("merge"), "token").groupBy("leader", "hi", "lo").agg(F.count("*").alias("k"))
    named = met.join(unique.select("hi", "lo", "node", "n").hint("merge"), ["hi", "lo"])
    own = Window.partitionBy("hi", "lo")
    return materialize(named.select("leader", "node", "n", F.sum("k").over(own).alias("s"), (F.col("leader") == F.min("leader").over(own)).alias("main")))


def tiles(rows: DataFrame, percent: int, tile: int | None = None) -> DataFrame:
    """h (the tile), side, one and the columns of rows(leader, node, n, s, c, met): the row once for each tile that it is
    in. A tile pairs side 0 with side 1, or all of its rows with each other where one is true."""
    tile = tile or TILE
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9).cast("int")
    rows = rows.withColumn("band", band)
    parts_of = F.ceil(F.greatest(F.count("*") / tile, F.sum("n") / TILE_SHINGLES)).cast("int")
    sizes = rows.groupBy("leader", "band").agg(F.count("*").alias("k"), F.sum("n").alias("m"), parts_of.alias("parts"))
    total = sizes.groupBy("leader").agg(F.sum("k").alias("total"), F.sum("m").alias("shingles"), F.map_from_entries(F.collect_list(F.struct("band", "parts"))).alias("parts")).filter("total > 1")
    rows = rows.join(total.hint("merge"), "leader")
    parts = lambda d: F.coalesce(F.try_element_at("parts", F.col("band") + d), F.lit(0))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.greatest(parts(0), F.lit(1))).cast("int"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    place = lambda b1, s1, b2, s2, side, one: F.struct(b1.cast("int").alias("b1"), s1.cast("int").alias("s1"), b2.cast("int").alias("b2"), s2.cast("int").alias("s2"), side.cast("int").alias("side"), one.alias("one"))
    b, s = F.col("band"), F.col("part")
    inside = F.transform(upto(parts(0)), lambda j: place(b, F.least(s, j), b, F.greatest(s, j), s > j, s == j))
    above = F.transform(upto(parts(1)), lambda j: place(b, s, b + 1, j, F.lit(0), F.lit(False)))
    below = F.transform(upto(parts(-1)), lambda j: place(b - 1, j, b, s, F.lit(1), F.lit(False)))
    none = F.lit(0)
    whole = F.array(place(none, none, none, none, none, F.lit(True)))
    small = (F.col("total") <= tile) & (F.col("shingles") <= TILE_SHINGLES)
    rows = rows.withColumn("at", F.explode(F.when(small, whole).otherwise(F.concat(inside, above, below))))
    key = F.xxhash64("leader", "at.b1", "at.s1", "at.b2", "at.s2")  # tiles of one hash are one tile with idle pairs
    return rows.select(key.alias("h"), "at.side", "at.one", "node", "n", "s", "c", "met")


def by_tile(rows: DataFrame) -> DataFrame:
    return rows.repartition("h").sortWithinPartitions("h", "n")


def whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one partition, sorted by h, in tables that hold whole tiles."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        h = batch.column(batch.schema.get_field_index("h")).to_numpy()
        if held and h[0] != last:
            yield pa.Table.from_batches(held)
            held = []
        last = h[-1]
        cut = int(np.searchsorted(h, last))
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].combine_chunks().to_numpy(zero_copy_only=False)


def fitting(table: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows, sorted by tile and size, that are to be compared (of different components c, and not both
    met before) and whose sizes allow a link. Those that are d rows apart come together, for every d."""
    h, n, side, one, c, met = (_column(table, x) for x in ("h", "n", "side", "one", "c", "met"))
    live, d = np.arange(len(h)), 0
    while len(live):
        d += 1
        live = live[live + d < len(h)]
        live = live[(h[live] == h[live + d]) & (percent * n[live + d] <= 100 * n[live])]
        ok = (one[live] | (side[live] != side[live + d])) & (c[live] != c[live + d]) & ~(met[live] & met[live + d])
        if ok.any():
            yield live[ok], live[ok] + d


def enough_shared(n: np.ndarray, m: np.ndarray, shared: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes n and m whose prefixes share that many shingles can be linked. What is linked has at least
    `least` shingles in common. In the set whose prefix ends first in the order, shared shingles stand in both prefixes
    or behind its own."""
    behind = np.maximum((percent * n + 99) // 100, (percent * m + 99) // 100) - 1
    least = -(-percent * (n + m) // (100 + percent))
    return shared + behind >= least


class Signatures:
    """Signatures of a table's rows, compared at the length of the shorter one."""

    def __init__(self, column: pa.ChunkedArray):
        each = [np.frombuffer(s, np.uint64) for s in column.to_pylist()]
        self.size = np.array([len(s) for s in each])
        self.levels, self.row = {}, np.zeros(len(each), np.int64)
        for size in np.unique(self.size):
            at = np.flatnonzero(self.size == size)
            self.row[at] = np.arange(len(at))
            self.levels[size] = np.stack([each[k] for k in at])

    def _at(self, rows: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros((len(rows), size), np.uint64)
        for own in np.unique(self.size[rows]):
            some = self.size[rows] == own
            bits = self.levels[own][self.row[rows[some]]]
            while bits.shape[1] > size:
                bits = bits[:, : bits.shape[1] // 2] | bits[:, bits.shape[1] // 2 :]
            out[some] = bits
        return out

    def allow(self, i: np.ndarray, j: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
        """Whether the pairs of rows can be linked, as far as bits tell."""
        out = np.zeros(len(i), bool)
        least = np.minimum(self.size[i], self.size[j])
        for size in np.unique(least):
            at = np.flatnonzero(least == size)
            step = max(1, (1 << 18) // int(size))
            for k in range(0, len(at), step):
                some = at[k : k + step]
                out[some] = may_link(n[i[some]], n[j[some]], self._at(i[some], size), self._at(j[some], size), percent)
        return out


def may_link(n: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes n and m with signatures a and b (rows of uint64) can be linked."""
    most = np.minimum(n - np.bitwise_count(a & ~b).sum(axis=-1, dtype=np.int64), m - np.bitwise_count(b & ~a).sum(axis=-1, dtype=np.int64))
    return 100 * most >= percent * (n + m - most)


def with_partner(rows: DataFrame, percent: int, signed: bool) -> DataFrame:
    """The rows of tiles that have a partner which sizes and shared shingles allow, or (signed) signatures."""

    def run(batches):
        for table in whole_tiles(batches):
            alive, n = np.zeros(len(table), bool), _column(table, "n")
            bits, s = (Signatures(table["sig"]), None) if signed else (None, _column(table, "s"))
            for i, j in fitting(table, percent):
                ok = bits.allow(i, j, n, percent) if signed else enough_shared(n[i], n[j], np.minimum(s[i], s[j]), percent)
                alive[i[ok]] = alive[j[ok]] = True
            yield from table.filter(pa.array(alive)).to_batches()

    return by_tile(rows).mapInArrow(run, by_tile(rows).schema)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted arrays are linked by their exact intersection."""
    if len(x) > len(y):
        x, y = y, x
    same = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * same >= percent * (len(x) + len(y) - same)


def links(rows: DataFrame, percent: int) -> DataFrame:
    """a, b: links that join all that is linked inside each tile of rows(h, side, one, node, n, c, met, sig, arr)."""

    def run(batches):
        for table in whole_tiles(batches):
            node, n, bits = _column(table, "node"), _column(table, "n"), Signatures(table["sig"])
            arrays = [np.frombuffer(a.as_buffer(), np.uint64) for a in table["arr"].combine_chunks()]
            label, found = np.unique(_column(table, "c"), return_inverse=True)[1], []
            for i, j in fitting(table, percent):
                apart = label[i] != label[j]
                i, j = i[apart], j[apart]
                ok = bits.allow(i, j, n, percent)
                for x, y in zip(i[ok].tolist(), j[ok].tolist()):
                    if label[x] != label[y] and linked(arrays[x], arrays[y], percent):
                        label[label == label[y]] = label[x]
                        found.append((node[x], node[y]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else ((), ()))], ["a", "b"])

    return by_tile(rows).mapInArrow(run, "a long, b long")


def with_arrays(rows: DataFrame, docs: DataFrame, unique: DataFrame, width: int) -> DataFrame:
    """rows and the sorted array of each one's set. Only the texts of these sets are read for shingles again."""
    wanted = materialize(rows.select("node").distinct().join(unique.select("node", "hi", "lo", "doc_id").hint("merge"), "node"))
    ids = wanted.select("doc_id").distinct()
    ids = F.broadcast(ids) if wanted.count() <= 500_000 else ids.hint("merge")
    arrays = full_sets(docs.join(ids, "doc_id", "left_semi"), width).join(wanted.select("hi", "lo", "node").hint("merge"), ["hi", "lo"])
    return rows.join(arrays.select("node", "arr").hint("merge"), "node")


def tile_links(rows: DataFrame, docs: DataFrame, unique: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b, as a stored table: links that join all components c which the tiles of rows(leader, node, n, s, c, met) show
    to be linked."""
    kept = materialize(with_partner(tiles(rows, percent), percent, signed=False).drop("s"))
    kept = materialize(with_partner(kept.join(unique.select("node", "sig").hint("merge"), "node"), percent, signed=True))
    return materialize(links(with_arrays(kept, docs, unique, width), percent))


def set_links(docs: DataFrame, sets: DataFrame, unique: DataFrame, width: int, percent: int) -> DataFrame:
    """node, label: components of linked sets; a set without links has no row."""
    rows = members(docs, unique, width, percent, frequent_shingles(sets))
    first = rows.filter("main").withColumns({"c": F.col("node"), "met": F.lit(False)}).drop("main")
    first = tile_links(first, docs, unique, width, percent)
    labels = components(first)
    named = rows.join(labels.hint("merge"), "node", "left").select("leader", "node", "n", "s", F.coalesce("label", "node").alias("c"), F.col("main").alias("met"))
    named = materialize(named)
    apart = named.groupBy("leader").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("leader")
    second = tile_links(named.join(apart.hint("merge"), "leader", "left_semi"), docs, unique, width, percent)
    return components(first.unionByName(second)) if second.limit(1).count() else labels


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id: smallest doc_id that links reach."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    sets = materialize(document_sets(docs, width, percent))
    some = sets.filter("n > 0")
    unique = some.groupBy("hi", "lo").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.max("sig").alias("sig"))
    unique = materialize(unique.withColumn("node", F.monotonically_increasing_id()))
    labels = set_links(docs, some, unique, width, percent)
    own = unique.select("node", "hi", "lo", "doc_id").join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = own.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = materialize(own.join(smallest.hint("merge"), "label").select("hi", "lo", "component_id"))
    out = sets.select("doc_id", "hi", "lo", "n").join(named.hint("merge"), ["hi", "lo"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(component, F.lit(NO_ID)).alias("component_id"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS k FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
c(x, y) AS (SELECT x, y FROM l UNION SELECT c.x, l.y FROM c JOIN l ON l.x = c.y)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.y, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT x, min(y) AS y FROM c GROUP BY x) m ON m.x = w.doc_id
"""
