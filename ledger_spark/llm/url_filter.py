"""URL rules through cascades of Bloom filters that are exact over all keys of the corpus.

A rule is a host and a path, like example.com/en/; it fits its host and all subdomains, where the url's path starts
with the rule's. A url's keys are the suffixes of its host that have as many labels as some rule's host, joined to the
prefixes of its path that are as long as some rule's path. All keys of all urls are the universe.

A cascade encodes a list of rules: level 1 holds the listed keys, level 2 the keys of the universe that level 1 takes
for listed, level 3 the listed keys that level 2 holds wrongly, and so on until a level is wrong about none. A key's
answer is the parity of the first level that lacks it. For every key of the universe the answer is exact, so judging
urls needs no join. One cascade holds the blocked rules, one the allowed.

A filter's size follows the list, not the corpus. Lists that would need more than `most_bytes` are cut into stripes by
the key's hash, each with a cascade of its own; stripes are judged one after the other.

Null urls and urls without "://" have an empty host and path: no rule fits and the default verdict stands. Repeated
pages each give a row; an empty table gives none.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize
from .wordhash import mix

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


class SameHash(Exception):
    """A rule and another key have one 64-bit hash."""


def keys_of(host: str, path: str, shapes: set[tuple[int, int]]) -> Column:
    """The host's last labels + the path's first characters, for every shape (labels, characters) that a rule has. So a
    host of any length has no more keys than rules have shapes."""
    labels = F.split(host, r"\.")
    suffix = {k: F.when(F.size(labels) >= k, F.array_join(F.slice(labels, -k, k), ".")) for k, _ in shapes}
    prefix = {n: F.when(F.length(path) >= n, F.substring(path, 1, n)) for _, n in shapes}
    keys = [F.concat(suffix[k], prefix[n]) for k, n in sorted(shapes, reverse=True)]
    return F.filter(F.array(*keys).cast("array<string>"), lambda x: x.isNotNull())


def shape(rule: str) -> tuple[int, int]:
    at = rule.find("/") if "/" in rule else len(rule)
    return rule[:at].count(".") + 1, len(rule) - at


@dataclass
class Bloom:
    bits: np.ndarray
    probes: int
    seed: int

    @classmethod
    def of(cls, hashes: np.ndarray, rate: float, seed: int) -> "Bloom":
        size = max(64, int(-len(hashes) * math.log(rate) / math.log(2) ** 2) // 8 * 8 + 8)
        out = cls(np.zeros(size // 8, np.uint8), max(1, round(-math.log2(rate))), seed)
        for at in out._places(hashes):
            np.bitwise_or.at(out.bits, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))
        return out

    def _places(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        a = mix(hashes + np.uint64(self.seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        b = mix(a) | np.uint64(1)
        for k in range(self.probes):
            yield ((a + np.uint64(k) * b) % np.uint64(len(self.bits) * 8)).astype(np.int64)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self._places(hashes):
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def listed(levels: list[Bloom], hashes: np.ndarray) -> np.ndarray:
    """Whether each key is listed: the number of levels in a row that hold it is odd."""
    out, open_ = np.zeros(len(hashes), bool), np.arange(len(hashes))
    for level in levels:
        open_ = open_[level.holds(hashes[open_])]
        out[open_] = ~out[open_]
    return out


def cascade(spark, universe: DataFrame, rules: list[str], keys: int, seed: int = 0) -> list[Bloom]:
    """Levels over universe(key, h) of that many keys, h being hashed(key, seed); rules is a list of a checked size. Level
    1 is made so exact that it is wrong about as many keys as there are rules, or about a thousand; only those come to
    the driver."""
    if not rules:
        return []
    rate = min(0.5, max(len(rules), 1000) / max(keys, 1))
    mine = spark.createDataFrame([(r,) for r in rules], "key string").select("key", hashed("key", seed).alias("h"))
    inside = np.array([r["h"] for r in mine.collect()], np.int64).astype(np.uint64)
    levels, level = [Bloom.of(inside, rate, 1)], 1
    outside = None  # keys not listed that all levels so far hold, once the universe has been read
    while True:
        level += 1
        if level % 2 == 0:
            if outside is None:
                wrong = _held(universe, levels[0]).join(F.broadcast(mine.select("key")), "key", "left_anti").select("h").distinct()
                outside = np.array([r["h"] for r in wrong.collect()], np.int64).astype(np.uint64)
                if np.isin(outside, inside).any():
                    raise SameHash
            else:
                outside = outside[levels[-1].holds(outside)]
            if not len(outside):
                return levels
            levels.append(Bloom.of(outside, 0.5, level))
        else:
            inside = inside[levels[-1].holds(inside)]
            if not len(inside):
                return levels
            levels.append(Bloom.of(inside, 0.5, level))


def hashed(key: str | Column, seed: int) -> Column:
    return F.xxhash64(key, F.lit(seed)) if seed else F.xxhash64(key)


def _held(universe: DataFrame, level: Bloom) -> DataFrame:
    bits = universe.sparkSession.sparkContext.broadcast(level)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bits.value.holds(batch.column(1).to_numpy().astype(np.uint64))))

    return universe.select("key", "h").mapInArrow(keep, "key string, h long")


def judge(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow", most_bytes: int = 64 << 20) -> DataFrame:
    """page_id, host, path, rule, verdict for each page: the longest rule that fits decides, else the default.
    rules are (verdict, host + path); the first of equal rules counts."""
    verdicts: dict[str, str] = {}
    for verdict, rule in rules:
        verdicts.setdefault(rule, verdict)
    host, path = host_and_path()
    urls = materialize(pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("keys", keys_of("host", "path", {shape(r) for r in verdicts})))
    for seed in itertools.count():  # another one where a rule and another key have one hash
        try:
            return judged_by_stripes(urls, verdicts, default, most_bytes, seed)
        except SameHash:
            continue


def judged_by_stripes(urls: DataFrame, verdicts: dict[str, str], default: str, most_bytes: int, seed: int) -> DataFrame:
    spark = urls.sparkSession
    universe = urls.select(F.explode("keys").alias("key")).withColumn("h", hashed("key", seed))
    keys = urls.agg(F.sum(F.size("keys"))).first()[0] or 0
    size = sum(len(r.encode()) + 6 for r in verdicts)  # the strings, of which a stripe's are broadcast, and under 48 bits a rule
    stripes = max(1, math.ceil(size / most_bytes))
    judged = urls.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(None).cast("string"))
    for stripe in range(stripes):
        mine = F.pmod("h", F.lit(stripes)) == stripe
        of = spark.createDataFrame([(r,) for r in verdicts] or [("",)], "key string").withColumn("h", hashed("key", seed)).filter(mine)
        own = {r["key"] for r in of.collect()}
        levels = {v: cascade(spark, universe.filter(mine), [r for r in verdicts if r in own and verdicts[r] == v], keys, seed) for v in ("block", "allow")}
        judged = _judged(judged, levels, stripes, stripe, seed)
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _judged(urls: DataFrame, levels: dict[str, list[Bloom]], stripes: int, stripe: int, seed: int) -> DataFrame:
    """urls with the longest listed key of this stripe, where it is longer than the rule found before."""
    held = urls.sparkSession.sparkContext.broadcast(levels)
    probed = urls.withColumn("hs", F.transform("keys", lambda k: hashed(k, seed)))
    fields = ["page_id", "host", "path", "keys", "rule", "verdict"]
    schema = probed.select(*fields).schema

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            hs = table["hs"].combine_chunks()
            counts = np.diff(hs.offsets.to_numpy())
            flat = hs.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(counts)), counts)
            keys = table["keys"].combine_chunks().flatten().to_pylist()
            rule, verdict = table["rule"].to_pylist(), table["verdict"].to_pylist()
            own = np.flatnonzero(flat % stripes == stripe)
            for name, cascade_ in held.value.items():
                for k in own[listed(cascade_, flat[own].astype(np.uint64))]:
                    i = row[k]
                    if rule[i] is None or len(keys[k]) > len(rule[i]):
                        rule[i], verdict[i] = keys[k], name
            columns = [table[c] for c in fields[:4]] + [pa.chunked_array([pa.array(x, pa.string())]) for x in (rule, verdict)]
            yield from pa.Table.from_arrays(columns, fields).to_batches()

    return probed.select(*fields, "hs").mapInArrow(test, schema)


ORACLE = """
WITH u AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) v(verdict, rhost, rpath)),
m AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
      FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT h.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN m ON m.page_id = h.page_id
"""
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
