"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window is `window` consecutive words of a benchmark item, or the whole item if it is shorter. A document contains a
window if all the window's shingles stand there one after the other. For full containment the necessary prefix of a
window is its single rarest shingle; only where that one occurs can the window occur.

1. The benchmark's shingles are counted over all documents: each position's shingle, as a hash, meets the table of them.
   The counts order shingles by rarity; they may be too high by collisions, which changes the order only. A window with
   a shingle that no document holds occurs nowhere.
2. Only prefixes are joined with positions. The shingle's place in the window and the document's length bound the start;
   what fits is verified by comparing all words of the window at once.
3. Matches, which hold whole windows, are merged per document.

The tables that meet positions are broadcast; one of more than BLOCK rows is met block by block, each of a size that may
be broadcast, so that positions are never shuffled.

Null and empty texts have no words and no hits. Items without words have no windows. Repeated documents each give a
row; repeated items count by item_id. An empty benchmark leaves all documents clean, no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import empty_for_null, materialize

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = 200_000  # rows broadcast at once, of a window's words and a few numbers at most


def words(text: str = "text") -> Column:
    """A-Z in lower case, then runs of letters, digits and everything beyond ASCII."""
    value = empty_for_null(text)
    ascii_ = F.octet_length(value) == F.length(value)
    return F.array_remove(F.split(F.when(ascii_, F.lower(value)).otherwise(F.translate(value, UPPER, LOWER)), SEPARATORS), "")


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id, win (the window's words joined by blanks), len."""
    items = benchmark.select("item_id", words().alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return items.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.array_join(F.slice("w", F.col("at"), window), " ").alias("win"), F.least(F.size("w"), F.lit(window)).alias("len")).distinct()


def shingle_key(words_: Column, at: Column | int, width: int) -> Column:
    """A hash of `width` words from place `at` (from 1) on."""
    return F.xxhash64(F.lit(width), *(F.try_element_at(words_, (at + k) if isinstance(at, Column) else F.lit(at + k)) for k in range(width)))


def window_shingles(windows: DataFrame, width: int, widths: list[int]) -> DataFrame:
    """win, len, q (place, from 0), key: the shingles of all windows. Windows shorter than width are one shingle."""
    each = windows.select("win", "len").distinct().withColumn("w", F.split("win", " ")).withColumn("width", F.least("len", F.lit(width)))
    each = each.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("width"))))
    key = F.lit(None).cast("long")
    for k in widths:
        key = F.when(F.col("width") == k, shingle_key(F.col("w"), F.col("q") + 1, k)).otherwise(key)
    return each.select("win", "len", "q", key.alias("key"))


def positions(docs: DataFrame, widths: list[int]) -> DataFrame:
    """docs(row, doc_id, w, n_words) with pos and key, the hash of the shingle of each width there; position 0 has none."""
    at = docs.withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("n_words"))))
    keys = [F.when((F.col("pos") > 0) & (F.col("pos") + k - 1 <= F.col("n_words")), shingle_key(F.col("w"), F.col("pos"), k)) for k in widths]
    return at.withColumn("key", keys[0] if len(keys) == 1 else F.explode(F.array(*keys)))


def blocks(table: DataFrame, by: str) -> Iterator[DataFrame]:
    """The table as parts that may be broadcast."""
    n = max(1, -(-table.count() // BLOCK))
    for k in range(n):
        yield table if n == 1 else table.filter(F.pmod(F.xxhash64(by), F.lit(n)) == k)


def contained_windows(docs: DataFrame, windows: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """rows(row, doc_id, n_words) and matches(row, start, len, win): every occurrence of every window."""
    widths = sorted(r["width"] for r in windows.select(F.least("len", F.lit(width)).alias("width")).distinct().collect()) or [width]  # at most `width` values
    of = materialize(window_shingles(windows, width, widths))
    texts = docs.select(words().alias("w")).select("w", F.size("w").alias("n_words"))
    rarity = None
    for part in blocks(materialize(of.select("key").distinct()), "key"):
        met = positions(texts, widths).select("key").join(F.broadcast(part), "key").groupBy("key").agg(F.count("*").alias("df"))
        rarity = met if rarity is None else rarity.unionByName(met)
    known = of.join(materialize(rarity).hint("merge"), "key", "left")
    prefix = known.groupBy("win", "len").agg(F.min(F.struct("df", "key", "q")).alias("rare"), F.count("df").alias("met"), F.count("*").alias("n")).filter("met = n")
    prefix = materialize(prefix.select("win", "len", "rare.q", "rare.key"))

    parts = list(blocks(prefix, "win"))
    own = docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("row"))
    own = own if len(parts) == 1 else materialize(own)  # each block then sees the same row numbers
    own = own.select("row", "doc_id", words().alias("w")).withColumn("n_words", F.size("w"))
    found = None
    for k, part in enumerate(parts):
        at = positions(own, widths) if k == 0 else positions(own, widths).filter("pos > 0")
        start = F.col("pos") - F.col("q")
        met = at.join(F.broadcast(part), "key", "left").withColumn("start", start)
        fits = (F.col("start") >= 1) & (F.col("start") + F.col("len") - 1 <= F.col("n_words"))
        same = F.when(fits, F.array_join(F.slice("w", F.greatest("start", F.lit(1)), F.greatest("len", F.lit(0))), " ") == F.col("win"))
        met = met.withColumn("same", F.coalesce(same, F.lit(False))).filter(F.col("same") | (F.col("pos") == 0))
        met = met.select("row", "doc_id", "n_words", "pos", *(F.when(F.col("same"), F.col(c)).alias(c) for c in ("start", "len", "win")))
        found = met if found is None else found.unionByName(met)
    found = materialize(found)
    return found.filter("pos = 0").select("row", "doc_id", "n_words").distinct(), found.filter("win IS NOT NULL").select("row", "start", "len", "win")


def covered(matches: DataFrame) -> DataFrame:
    """row, n_hit: words inside any match, by the union of their spans."""
    spans = matches.groupBy("row", "start").agg((F.col("start") + F.max("len") - 1).alias("end"))
    before = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    new = F.col("end") - F.greatest(F.col("start") - 1, F.coalesce(F.max("end").over(before), F.lit(0)))
    return spans.select("row", F.greatest(new, F.lit(0)).alias("new")).groupBy("row").agg(F.sum("new").alias("n_hit"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, width: int = 3, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    windows = materialize(benchmark_windows(benchmark, window))
    rows, matches = contained_windows(docs, windows, width)
    item = windows.select("win", F.col("item_id").cast("string").alias("item"))
    item = F.broadcast(item) if item.count() <= BLOCK else item.hint("merge")
    items = matches.select("row", "win").distinct().join(item, "win").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = rows.join(covered(matches).hint("merge"), "row", "left").join(items.hint("merge"), "row", "left")
    n_words, n_hit, ids = F.col("n_words").cast("long"), F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", n_words.alias("n_words"), n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), ((n_hit > 0) & (share * n_hit >= n_words)).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, len, array_to_string(w[i:i + len - 1], ' ') AS k
        FROM (SELECT item_id, w, least(len(w), 13) AS len, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
pos AS (SELECT doc_id, w, l.len, unnest(range(1, len(w) - l.len + 2)) AS i FROM d, (SELECT DISTINCT len FROM win) l WHERE len(w) >= l.len),
hit AS (SELECT p.doc_id, p.i, p.len, win.item_id FROM (SELECT doc_id, i, len, array_to_string(w[i:i + len - 1], ' ') AS k FROM pos) p JOIN win ON p.k = win.k AND p.len = win.len),
n AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + len)) AS x FROM (SELECT DISTINCT doc_id, i, len FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n.n_hit, 0)::BIGINT AS n_hit, coalesce(its.n_items, 0)::BIGINT AS n_items, sha256(coalesce(its.items, '')) AS items_sha256,
       coalesce(n.n_hit, 0) > 0 AND 20 * coalesce(n.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""
