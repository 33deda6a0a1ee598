"""Which terms and sources set a source apart inside its language.

Terms are runs of letters (A-Z in lower case, everything beyond ASCII counts as a letter). A language keeps the terms
that at least `least_docs` of its documents hold. A group (language and source) and the language itself give every kept
term a smoothed share p = 1 + floor(10^9 (count + smooth) / (N + smooth V)), N being the count of all kept terms and V
their number. Two questions are answered per group: how far is each other source of the language (sum of |p - q| over
the kept terms), and which of its terms stand out most from the language (p - q).

1. Tasks count terms per group and the documents that hold them; a shuffle by (lang, source, term) adds that up, a
   second one by (lang, term) finds what a language keeps.
2. Outstanding terms are a dominance skyband. If another term of the group has a count no lower in the group, a count no
   higher in the language and comes first in UTF-8, it ranks before. So a term that `top` others dominate cannot be
   among the first `top`. Partitions retain only terms that fewer dominate (in blocks of BUFFER rows, so that what a
   task holds is bounded); the union of these skybands is ranked exactly.
3. Distances: per kept term the counts of the language's sources, summed as matrices over blocks of terms. The table of
   pairs of sources is the asked result; no table here holds pairs of terms or of documents.

Every number is an integer: shares come from long division in steps of a thousand, exact while N is below 9 * 10^15.
Null text, lang and source are ''. A group without terms has its distances (every p is then 1 + floor(10^9 / V)) and no
outstanding terms. Without kept terms distances are 0. Repeated rows count as often as they stand there; ties go to the
item that comes first in UTF-8; an empty table gives no rows. Columns beyond text, lang and source are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import chunks, materialize, small_batches, text_bytes
from .wordhash import lowered, words

OTHER = ~np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)])  # bytes that part terms
CHUNK = 8 << 20  # bytes of text whose terms a task counts at once
BUFFER = 200_000  # rows that a task reduces to skybands at once
CELLS = 4_000_000  # numbers in one block of a matrix
SHORT = 500_000  # rows of a few short columns that may be broadcast
COUNTS = "lang string, source string, term string, n long, df long"


def tally(lang: pa.Array, source: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """lang, source, term, n, df of these documents."""
    data, offsets = text_bytes(texts)
    data = lowered(data)
    starts, ends, first = words(data, offsets, OTHER)
    ends_at = np.concatenate(([0], np.cumsum(ends - starts)))
    letters = np.ascontiguousarray(data[~OTHER[data]])
    spelled = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends_at), pa.py_buffer(letters)]).dictionary_encode()
    number = max(len(spelled.dictionary), 1)
    document, n = np.unique(np.repeat(np.arange(len(texts)), np.diff(first)) * number + spelled.indices.to_numpy(), return_counts=True)
    lang, source = lang.dictionary_encode(), source.dictionary_encode()
    n_sources = max(len(source.dictionary), 1)
    group = (lang.indices.to_numpy().astype(np.int64) * n_sources + source.indices.to_numpy())[document // number]
    key, of, df = np.unique(group * number + document % number, return_inverse=True, return_counts=True)
    group, term = key // number, key % number
    spelled = spelled.dictionary.take(pa.array(term)).cast(pa.binary()).cast(pa.string())
    sums = np.bincount(of, n, len(key)).astype(np.int64)
    parts = [lang.dictionary.take(pa.array(group // n_sources)), source.dictionary.take(pa.array(group % n_sources)), spelled, pa.array(sums), pa.array(df.astype(np.int64))]
    return pa.RecordBatch.from_arrays(parts, ["lang", "source", "term", "n", "df"])


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for part, texts in chunks(batch, "text", CHUNK):
            held.append((part.column("lang").cast(pa.string()), part.column("source").cast(pa.string()), texts))
            size += texts.nbytes
            if size >= CHUNK:
                yield tally(*(pa.concat_arrays(x) for x in zip(*held)))
                held, size = [], 0
    if held:
        yield tally(*(pa.concat_arrays(x) for x in zip(*held)))


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and df (documents) of every term."""
    small_batches(docs.sparkSession)
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return rows.mapInArrow(count_terms, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def joined(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows with a stored table: by broadcast if a count shows that it is short, by merge otherwise."""
    return rows.join(F.broadcast(table) if table.count() <= SHORT else table.hint("merge"), on, how)


def share(count: Column, whole: Column, smooth: int) -> Column:
    """1 + floor(10^9 (count + smooth) / whole) in whole numbers, whole being N + smooth V."""
    part, left = F.call_function("div", count + smooth, whole), (count + smooth) % whole
    for _ in range(3):
        part, left = part * 1000 + F.call_function("div", left * 1000, whole), (left * 1000) % whole
    return part + 1


def shares(count: np.ndarray, whole: np.ndarray, smooth: int) -> np.ndarray:
    """share() of arrays."""
    part, left = np.divmod(count + smooth, whole)
    for _ in range(3):
        more, left = np.divmod(left * 1000, whole)
        part = part * 1000 + more
    return part + 1


def skyband(n: np.ndarray, total: np.ndarray, order: np.ndarray, k: int, block: int = 512) -> np.ndarray:
    """Places of the terms that fewer than k others dominate: n no lower, total no higher, order earlier.

    Taken so that dominators come first. A term that is left out has k dominators among those that are kept."""
    at = np.lexsort((order, total, -n))
    n, total, order = n[at], total[at], order[at]
    kept = np.zeros(0, np.int64)
    for start in range(0, len(at), block):
        here = np.arange(start, min(start + block, len(at)))
        few = np.ones(len(here), bool)
        if len(kept):
            few = ((total[kept] <= total[here, None]) & (order[kept] <= order[here, None])).sum(axis=1) < k
        here = here[few]
        above = (total[here] <= total[here, None]) & (order[here] <= order[here, None]) & (here < here[:, None])
        before = ((total[kept] <= total[here, None]) & (order[kept] <= order[here, None])).sum(axis=1) if len(kept) else 0
        kept = np.concatenate((kept, here[above.sum(axis=1) + before < k]))
    return at[kept]


def skybands(top: int):
    """Rows (g, term, n, total, f) reduced to the skyband of each g, buffer by buffer."""

    def reduce(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        order = np.empty(len(rows), np.int64)
        order[pc.sort_indices(rows["term"].cast(pa.binary())).to_numpy()] = np.arange(len(rows))
        g, n, total = (rows[c].to_numpy() for c in ("g", "n", "total"))
        by = np.argsort(g, kind="stable")
        cuts = np.flatnonzero(np.diff(g[by], prepend=-1, append=-1))
        keep = [part[skyband(n[part], total[part], order[part], top)] for part in (by[a:b] for a, b in zip(cuts[:-1], cuts[1:]))]
        return rows.take(pa.array(np.concatenate(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, least = [], 0, BUFFER
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            size += len(batch)
            if size >= least:
                held = [reduce(pa.concat_tables(held))]
                size = len(held[0])
                least = size + BUFFER
        if size:
            yield from reduce(pa.concat_tables(held)).to_batches()

    return run


def distances(smooth: int):
    """Rows (lang, v, wholes, per) - the kept terms' number, N + smooth V of each source, and (s, n) of the sources that
    hold the term - summed to (lang, a, b, d) over blocks of terms: |p - q| of sources a < b over these terms."""

    def block(lang: str, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        whole = np.asarray(rows[0][0], np.int64)
        held = np.zeros((len(rows), len(whole)), np.int64)
        for i, (_, s, n) in enumerate(rows):
            held[i, s] = n
        p = shares(held, whole, smooth)
        for a in range(len(whole) - 1):
            d = np.abs(p[:, a + 1 :] - p[:, a, None]).sum(axis=0)
            yield lang, np.full(len(d), a), np.arange(a + 1, len(whole)), d

    def batch(lang, a, b, d):
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(d.astype(np.int64))], ["lang", "a", "b", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for rows in batches:
            langs, wholes, per = rows.column("lang").to_pylist(), rows.column("wholes"), rows.column("per")
            for i, lang in enumerate(langs):
                fields = per[i].values
                held.setdefault(lang, []).append((wholes[i].values.to_numpy(), fields.field("s").to_numpy(), fields.field("n").to_numpy()))
                if len(held[lang]) * len(held[lang][0][0]) >= CELLS:
                    for x in block(lang, held.pop(lang)):
                        yield batch(*x)
        for lang, terms in held.items():
            for x in block(lang, terms):
                yield batch(*x)

    return run


def divergence(docs: DataFrame, least_docs: int = 30, smooth: int = 5, top: int = 50) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    every = materialize(counts(docs))
    kept = every.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("df").alias("df")).filter(F.col("df") >= least_docs).drop("df")
    kept = materialize(kept)
    rows = materialize(joined(every.drop("df"), kept, ["lang", "term"]))  # lang, term, source, n, total
    langs = kept.groupBy("lang").agg(F.sum("total").alias("lang_n"), F.count("*").alias("v"))
    empty = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")
    groups = docs.select(*empty).distinct().join(rows.groupBy("lang", "source").agg(F.sum("n").alias("group_n")).hint("merge"), ["lang", "source"], "left").join(langs.hint("merge"), "lang", "left").na.fill(0)
    inside = Window.partitionBy("lang").orderBy("source")  # as many rows as a language has sources
    groups = groups.withColumn("s", F.row_number().over(inside) - 1).withColumn("whole", F.col("group_n") + smooth * F.col("v")).withColumn("g", F.monotonically_increasing_id())
    groups = materialize(groups)
    rows = joined(rows, groups, ["lang", "source"])

    f = share(F.col("n"), F.col("whole"), smooth) - share(F.col("total"), F.col("lang_n") + smooth * F.col("v"), smooth)
    terms = rows.select("g", "term", "n", "total", f.alias("f")).filter("f > 0").mapInArrow(skybands(top), "g long, term string, n long, total long, f long")
    first = Window.partitionBy("g").orderBy(F.desc("f"), "term")
    terms = terms.select("g", "term", "f").withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top)
    terms = joined(terms, groups.select("g", "lang", "source"), ["g"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.col("f").alias("value"), "rank")

    sources = materialize(groups.filter("v > 0").groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "whole"))), lambda x: x["whole"]).alias("wholes")))
    per = rows.select("lang", "term", "s", "n").groupBy("lang", "term").agg(F.collect_list(F.struct("s", "n")).alias("per"))
    sums = joined(per, sources, ["lang"]).select("lang", "wholes", "per").mapInArrow(distances(smooth), "lang string, a int, b int, d long").groupBy("lang", "a", "b").agg(F.sum("d").alias("d"))
    sums = materialize(sums)
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("o")), F.struct(F.col("b").alias("s"), F.col("a").alias("o")))).alias("x"), "d").select("lang", "x.s", "x.o", "d")
    plain = groups.filter("v = 0").select("lang", "s")
    others = plain.join(plain.withColumnRenamed("s", "o").hint("merge"), "lang").filter("s <> o").withColumn("d", F.lit(0).cast("long"))
    named = groups.select("lang", "s", "source")
    pairs = joined(joined(both.unionByName(others), named, ["lang", "s"]), named.select("lang", F.col("s").alias("o"), F.col("source").alias("item")), ["lang", "o"])
    far = Window.partitionBy("lang", "source").orderBy(F.desc("d"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.col("d").alias("value"), F.row_number().over(far).alias("rank"))
    return pairs.unionByName(terms)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY t.lang, t.source, t.term),
gn AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(gn.n, 0) + 5 * l.v) AS p,
             1 + (1000000000::HUGEINT * (k.total + 5)) // (l.n + 5 * l.v) AS q
      FROM g JOIN kept k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 50
"""
