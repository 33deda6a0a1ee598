import re
import unicodedata
import zlib

import numpy as np
import pytest
from cases import odd, table

from ledger_spark.llm import langid

WORDS = {"xa": ["alba", "bala", "labba", "aall"], "xb": ["otto", "toto", "rotor", "ttoo"], "xc": ["ещё", "щёе", "ёёщ"]}


def texts():
    rng = np.random.default_rng(2)
    out = [(k, " ".join(rng.choice(WORDS[lang], 1 + k % 40)).title() + ".,\n"[k % 3], lang) for k, lang in enumerate(["xa", "xb", "xc"] * 40)]
    return out + [(500, None, "xa"), (501, "", "xb"), (502, "12 34 !?", "xa"), (None, "alba bala", "xa"), (503, "otto", None), (503, "otto", None), (504, "中文字 " * 50, "xa")]


def profile(text):
    """By the definition: a vector for each trigram, added up."""
    low = "".join(c.lower() if unicodedata.category(c)[0] == "L" else " " for c in text)
    out = np.zeros(langid.DIMENSIONS, np.int64)
    for word in low.split():
        points = [0, *map(ord, word), 0]
        for a, b, c in zip(points, points[1:], points[2:]):
            out += langid.trigram_vector(a, b, c)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(d, t, lang, "x", "x") for d, t, lang in rows], "doc_id long, text string, lang string, score string, held_out string").repartition(3)


def brute(rows):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 4 == 2
    bundle = {}
    for d, t, lang in rows:
        if t and lang is not None and not held(d):
            bundle[lang] = bundle.get(lang, 0) + profile(t)
    names = sorted((n for n in bundle if bundle[n].any()), key=str.encode)
    out = []
    for d, t, _ in rows:
        p = profile(t or "")
        if not p.any() or not names:
            out.append((d, held(d), "und", 0.0))
            continue
        near = [p @ bundle[n] / np.linalg.norm(p) / np.linalg.norm(bundle[n]) for n in names]
        best = int(np.argmax(near))
        out.append((d, held(d), names[best], max(0.0, float(near[best]))))
    return out


def test_identify_equals_brute_force(spark):
    rows = texts()
    got, want = (sorted(x, key=lambda r: (r[0] is None, r)) for x in ([tuple(r) for r in langid.identify(frame(spark, rows)).collect()], brute(rows)))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-5)
    right = [r[2] == {d: lang for d, _, lang in rows}[r[0]] for r in got if r[1] and r[0] < 120]
    assert all(right) and len(right) > 10


def test_nothing_learned(spark):
    assert langid.identify(frame(spark, [])).count() == 0
    assert [tuple(r)[2:] for r in langid.identify(frame(spark, [(0, "some text", None)])).collect()] == [("und", 0.0)]


def test_odd_documents(spark):
    docs = table(spark, odd())
    assert langid.identify(docs).count() == len(odd())


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST", 2)
    with pytest.raises(ValueError):
        langid.learn(frame(spark, texts()))


def test_wide_alphabets_sort_their_trigrams(monkeypatch):
    monkeypatch.setattr(langid, "NARROW", 4)
    monkeypatch.setattr(langid, "_OWN", {})
    some = [t or "" for _, t, _ in texts()] + ["Wörter mit vielen Buchstaben", re.sub("a", "ø", "abacada")]
    assert np.array_equal(langid.profiles(some), np.array([profile(t) for t in some], np.float32))
    assert len(langid.trigrams().each) > 8


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").selectExpr("avg(int(lang = lang_pred))", "count(*)").first()
    assert out[0] >= 0.99 and out[1] > 200
