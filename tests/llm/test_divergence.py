import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import odd, words

from ledger_spark.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n string, g string, total string, s string"


def brute(docs, least, smooth, top):
    """docs: (text, lang, source)."""
    term_of = lambda t: re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (t or "").encode()))
    n, df, groups = Counter(), defaultdict(Counter), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = term_of(text)
        df[lang].update(set(terms))
        for t in terms:
            n[lang, source, t] += 1
    kept = {lang: sorted(t for t, k in c.items() if k >= least) for lang, c in df.items()}
    p_of = lambda counts: [1 + 10**9 * (c + smooth) // (sum(counts) + smooth * len(counts)) for c in counts]
    out = set()
    for lang in {g[0] for g in groups}:
        own = kept.get(lang, [])
        sources = sorted(s for x, s in groups if x == lang)
        p = {s: p_of([n[lang, s, t] for t in own]) for s in sources}
        q = p_of([sum(n[lang, s, t] for s in sources) for t in own])
        for s in sources:
            far = sorted((-sum(abs(x - y) for x, y in zip(p[s], p[o])), o.encode(), o) for o in sources if o != s)
            out |= {(lang, s, "pair", o, -d, k + 1) for k, (d, _, o) in enumerate(far)}
            high = sorted((y - x, t) for t, x, y in zip(own, p[s], q) if n[lang, s, t] and x > y)[:top]
            out |= {(lang, s, "term", t.decode(), -d, k + 1) for k, (d, t) in enumerate(high)}
    return out


def run(spark, docs, **how):
    made = spark.createDataFrame([(k, *d, "x", "x", "x", "x", "x") for k, d in enumerate(docs)], SCHEMA)
    got = [tuple(r) for r in divergence.divergence(made, **how).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("top, buffer, cells", [(5, 200_000, 4_000_000), (2, 7, 10)])
def test_divergence_equals_brute_force(spark, monkeypatch, top, buffer, cells):
    monkeypatch.setattr(divergence, "BUFFER", buffer)
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "SHORT", 500_000 if top == 5 else 0)
    texts = [t for _, t in odd()] + ["Über ÜBER über straße " * 3, "a b c", "A-B_c9d", None, ""]
    docs = [(t, ["en", "de", None][k % 3], ["s1", "s2", "s3", None][k % 4]) for k, t in enumerate(texts * 2)]
    docs += [(" ".join(w.replace("1", "a").replace("5", "b") for w in words(k, 80)), "en", "s1" if k % 3 else "hot") for k in range(40)]
    docs += [("", "xx", "alone"), (None, "yy", "a"), ("one two", "yy", "b")]
    assert run(spark, docs, least_docs=3, smooth=5, top=top) == brute(docs, 3, 5, top)


def test_empty_and_single(spark):
    assert run(spark, []) == set()
    assert run(spark, [("some text", "en", "s")]) == set()
    assert run(spark, [("same", "en", "a"), ("same", "en", "b")], least_docs=2) == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}


def test_skyband_keeps_what_few_dominate():
    rng = np.random.default_rng(5)
    for k, block in ((1, 4), (3, 16), (50, 512)):
        n, total, order = rng.integers(0, 12, 300), rng.integers(0, 12, 300), rng.permutation(300)
        dominated = [((n >= n[i]) & (total <= total[i]) & (order < order[i])).sum() for i in range(300)]
        assert sorted(divergence.skyband(n, total, order, k, block)) == [i for i in range(300) if dominated[i] < k]


def test_shares_beyond_64_bits():
    whole = np.array([7 * 10**15, 3, 10**12 + 7])
    count = np.array([7 * 10**15 - 9, 1, 123_456_789_012])
    assert divergence.shares(count, whole, 1).tolist() == [1 + 10**9 * (c + 1) // w for c, w in zip(count.tolist(), whole.tolist())]
