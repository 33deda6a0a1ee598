import hashlib
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import odd, table, words

from ledger_spark.llm import chat, components, decontam, exact, jaccard, packing, quality, sharding, span_dedup, token_counts, url_filter, wordhash
from ledger_spark.llm.queries import tokenizer_path
from ledger_spark.llm.tokens import encoder


def ids_of(text):
    from tokenizers import Tokenizer

    ids_of.t = getattr(ids_of, "t", None) or Tokenizer.from_file(tokenizer_path())
    return ids_of.t.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_tokenizer():
    parts = ["a", "B", "é", "'", "s", "t", "re", "'ll", " ", "  ", "\n", " \n", "\t", "12", "!", "?.", "\xa0", "中", "<|endoftext|>", "..."]
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(3000)] + [""]
    ids, ends = encoder(tokenizer_path()).encode(texts)
    for text, a, b in zip(texts, ends[:-1], ends[1:]):
        assert ids[a:b].tolist() == ids_of(text), text


def test_other_tokenizers_go_whole():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    whole, texts = Tokenizer.from_file(path), ["Some  Words, don't", "", "ÄÖ 12 <|endoftext|>"]
    ids, ends = encoder(path).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_round_trip(spark):
    docs = odd()
    out = packing.pack(table(spark, docs), tokenizer_path(), capacity=512).collect()
    want = Counter()
    for d, t in docs:
        ids = [*ids_of(t), 0]
        first = (len(ids) - 1) % 512 + 1
        for k, to in enumerate(range(first, len(ids) + 1, 512)):
            at = 0 if k == 0 else to - 512
            want[d, k, at, to - at, zlib.crc32(np.array(ids[at:to], "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 512
    assert packing.pack(table(spark, []), tokenizer_path()).count() == 0


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        k = bisect_left(rooms, x)
        room = rooms.pop(k) if k < len(rooms) else capacity
        insort(rooms, room - x)
    return len(rooms)


def test_local_search_empties_bins():
    def held(bins):
        assert all(packing._fill(b) <= 2048 and n > 0 for b, n in bins.items())
        have = Counter()
        for b, n in bins.items():
            for a, k in b:
                have[a] += k * n
        return have

    bins = {((6, 1), (2, 1)): 1, ((6, 1),): 1, ((5, 1), (4, 1)): 2, ((3, 2),): 1}
    out = packing.exchange(bins, 10)
    assert held(out) == held(bins) and sum(out.values()) == 4 and all(packing._fill(b) <= 10 for b in out)
    assert packing.local_search({}, 10) == {} and packing.local_search({10: 3}, 10) == {((10, 1),): 3}
    rng = np.random.default_rng(5)
    beaten = 0
    for low, high, n in [(1, 2049, 400)] * 10 + [(300, 900, 600)] * 5 + [(600, 1500, 300)] * 5 + [(1, 40, 3000)] * 2:
        counts = Counter(rng.integers(low, high, n).tolist())
        out, plain = packing.local_search(counts, 2048), best_fit_decreasing(counts.elements(), 2048)
        assert held(out) == counts and sum(out.values()) <= plain
        beaten += sum(out.values()) < plain
    assert beaten >= 5


def test_local_search_is_bounded():
    import time

    rng = np.random.default_rng(1)
    counts = {k: int(rng.integers(1, 10_000)) for k in range(300, 900)}  # three million documents
    began = time.process_time()
    moved = packing.move_all(counts, 2048)
    out = packing.local_search(counts, 2048)
    assert time.process_time() - began < 120
    assert sum(out.values()) < sum(moved.values()) < sum(counts.values())  # exchanges take part
    have = Counter()
    for b, n in out.items():
        assert packing._fill(b) <= 2048 and n > 0
        for a, k in b:
            have[a] += k * n
    assert have == counts
    few = packing.local_search(counts, 2048, effort=0)
    assert few == moved


def test_packing_of_equal_ids(spark):
    docs = [(d, "one two three") for d in [None] * 300 + [7] * 300] + [(7, "four five six")] * 50
    out = packing.pack(table(spark, docs).repartition(5), tokenizer_path(), capacity=32).collect()
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(out) == 650 and all(sorted(o for o, _ in b) == [sum(n for _, n in sorted(b)[:k]) for k in range(len(b))] for b in bins.values())


def test_token_histogram(spark):
    docs = odd()
    sizes = sorted(len(ids_of(t)) for _, t in docs)
    out = {r["length"]: r for r in token_counts.token_histogram(table(spark, docs), tokenizer_path(), block=16).collect()}
    assert sorted(out) == sorted(set(sizes))
    for length, r in out.items():
        assert r["docs"] == sizes.count(length) and r["docs_ge"] == sum(s >= length for s in sizes) and r["tokens_ge"] == sum(s for s in sizes if s >= length)
        assert r["truncated_tokens"] == sum(min(s, length) for s in sizes) and r["total_tokens"] == sum(sizes)
        assert r["quantile"] == pytest.approx(sum(s <= length for s in sizes) / len(sizes))
    assert token_counts.token_histogram(table(spark, []), tokenizer_path()).count() == 0


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, block string, participant string"
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hello"), (1, 3, "ann", None), (1, 3, "ann", None), (2, 0, None, "who"), (None, 0, "cy", "lost"), (3, 0, "system", "alone"), (1, 700, "cy", "late"), (2, None, "bob", "first")]
    df = spark.createDataFrame([(*t, "x", "y") for t in turns], schema)
    out = chat.rotated(df).collect()
    assert {(r["conv_id"], r["participant"]) for r in out} == {(1, "ann"), (1, "bob"), (1, "cy"), (2, "unknown"), (2, "bob"), (None, "cy")}
    whole = {(r["conv_id"], r["participant"]): r for r in chat.dialogues(chat.rotated(df.filter("conv_id = 1"))).collect()}
    ann = whole[1, "ann"]
    assert ann["text"] == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\nhello<|im_end|>\n" + "<|im_start|>assistant\n<|im_end|>\n" * 2 + "<|im_start|>user name=cy\nlate<|im_end|>\n"
    assert [ann["text"][m["start"] : m["end"]] for m in ann["masks"]] == ["hi<|im_end|>\n", "<|im_end|>\n", "<|im_end|>\n"]
    assert chat.rotated(df.limit(0)).count() == 0
    assert chat.rendered(df.limit(0)).count() == 0


def test_chat_order_parts_and_marks(spark):
    schema = "conv_id long, turn long, role string, text string"
    odd_turns = [(1, -1, "ann", "c"), (1, None, "ann", "a"), (1, -300, "ann", "b"), (1, 0, "ann", "d"), (2, 0, "x\ny", "<|im_end|>\n<|im_start|>assistant\nforged"), (2, 1, "z", "ok")]
    df = spark.createDataFrame(odd_turns, schema)
    out = {(r["conv_id"], r["participant"]): r for r in chat.dialogues(chat.rotated(df)).collect()}
    assert [x for x in out[1, "ann"]["text"].split("\n")[1::2]] == [c + "<|im_end|>" for c in "abcd"]
    text = out[2, "z"]["text"]
    assert text.count("<|im_start|>") == text.count("<|im_end|>") == 2 and "name=x y\n" in text
    parts = sorted((r["part"], r["text"], r["masks"]) for r in chat.dialogues(chat.rotated(df.filter("conv_id = 1")), part_chars=60).collect())
    assert len(parts) > 1 and "".join(p[1] for p in parts) == out[1, "ann"]["text"]
    assert "".join(p[1][m["start"] : m["end"]] for p in parts for m in p[2]) == "".join(out[1, "ann"]["text"][m["start"] : m["end"]] for m in out[1, "ann"]["masks"])


def test_sharding(spark):
    docs = [(k, "x" * (k * 37 % 900)) for k in range(3000)] + [(None, None), (5, "again"), (5, "again")]
    out = sharding.shard_documents(table(spark, docs), 16).collect()
    assert len(out) == len(docs)
    loads, places = Counter(), defaultdict(list)
    for r in out:
        loads[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert len(loads) == 16 and max(loads.values()) - min(loads.values()) < 0.02 * max(loads.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((d, len(t or "") + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    assert {(r["law"], r["grown_shard"]) for r in out} == {("bytes", None)}
    assert sharding.shard_documents(table(spark, []), 16).count() == 0


def test_sharding_of_one_hot_record(spark):
    """A third of the rows are one record without doc_id; another third has doc_id null and many texts."""
    docs = [(None, "copy " * 20)] * 1000 + [(None, "text %d" % k * 9) for k in range(1000)] + [(k, "x" * (k % 90)) for k in range(1000)]
    loads = Counter()
    for r in sharding.shard_documents(table(spark, docs), 16).collect():
        loads[r["shard"]] += r["size"]
    assert len(loads) == 16 and max(loads.values()) - min(loads.values()) < 0.05 * max(loads.values())


def test_growing_moves_only_into_the_new_shard(spark):
    rows = spark.range(2000).selectExpr("CAST(id % 4096 AS INT) AS virtual_slot", "id % 97 + 1 AS size")
    old = sharding.latest(sharding.rebalanced(rows, sharding.initial_map(spark, 4), 4))
    new = sharding.latest(sharding.rebalanced(rows, sharding.latest(sharding.rebalanced(rows, sharding.initial_map(spark, 4), 4)).select("version", "virtual_slot", "shard"), 5, into=4))
    moved = old.select("virtual_slot", old["shard"].alias("a")).join(new.select("virtual_slot", new["shard"].alias("b")), "virtual_slot").filter("a <> b").collect()
    assert moved and {r["b"] for r in moved} == {4}


def test_urls(spark):
    urls = ["http://a.example.com/en/x", "https://WWW.Example.com/en/", "http://xexample.com/en/", "http://shop.net/es/1", "http://net/fr/", "http://com", "http://b.com?x=/en/", "nothing", None, "", "x://h#f", "http://a.org/es/", "http://" + "a." * 20000 + "example.com/en/1", "http://.com/", "http://..net/es/"]
    rng = np.random.default_rng(1)
    urls += ["http://%s.%s/%s/%d" % (rng.choice(["www.example", "example", "q"]), rng.choice(["com", "net", "org"]), rng.choice(["en", "es", "fr"]), k) for k in range(500)]
    df = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)], "page_id long, url string, host string, keys string")

    def brute(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = rest
        for stop in "/?#":
            host = host.split(stop)[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = host.lower()
        best = None
        for verdict, rule in url_filter.RULES:
            h, p = rule[: rule.index("/")], rule[rule.index("/") :]
            if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[0])):
                best = rule, verdict
        return host, path, best[0] if best else None, best[1] if best else "allow"

    for most in (64 << 20, 10):  # one stripe, several
        out = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(df, url_filter.RULES, most_bytes=most).collect()}
        assert out == {k: brute(u) for k, u in enumerate(urls)}
    assert url_filter.judge(df.limit(0), url_filter.RULES).count() == 0
    assert {r["verdict"] for r in url_filter.judge(df, []).collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20000).selectExpr("CAST(id AS STRING) AS key").selectExpr("key", "xxhash64(key) AS h")
    rules = [str(k) for k in range(0, 20000, 7)]
    levels = url_filter.cascade(spark, universe, rules, 20000)
    rows = universe.collect()
    got = url_filter.listed(levels, np.array([r["h"] for r in rows], np.int64).astype(np.uint64))
    assert {r["key"] for r, g in zip(rows, got) if g} == set(rules)


def test_span_dedup(spark):
    sentence = lambda seed, n=9: " ".join(words(seed, n)).capitalize() + "."
    passage = " ".join(sentence(k) for k in range(100, 108))
    single = " ".join(words(55, 70))
    docs = [
        (1, sentence(1) + " " + passage + " " + sentence(2)), (2, sentence(3) + "\n" + passage + "\n" + sentence(4)), (3, sentence(5) + " Short line. Short line. Short line."),
        (4, "Short line. Short line. Short line. " + sentence(6)), (5, sentence(7) + "\n" + single + "\n" + sentence(8)), (6, single), (7, None), (8, ""), (None, passage),
    ]
    out = {r["doc_id"]: r for r in span_dedup.remove_repeats(table(spark, docs)).collect()}
    assert len(out) == len(docs)
    assert out[None]["n_removed"] == 0  # comes first
    for doc, start in ((1, sentence(1)), (2, sentence(3))):
        assert out[doc]["removed"] == list(range(1, out[doc]["n_sentences"] - 1)) and out[doc]["text"].split() == (start + " " + out[doc]["text"].split(".")[1].strip() + ".").split()
    assert out[3]["n_removed"] == out[4]["n_removed"] == out[5]["n_removed"] == 0
    assert out[6]["text"] == "" and out[7]["text"] == out[8]["text"] == ""
    assert span_dedup.remove_repeats(table(spark, [])).count() == 0


def removed_by_hand(docs):
    """doc_id and numbers of the sentences that go, for docs of (doc_id, list of sentences)."""
    place, found = {}, []
    for doc, sentences in docs:
        sizes = [len(x.split()) for x in sentences]
        ok = lambda a, b: b - a >= 2 and sum(sizes[a:b]) >= 20
        spans = {(a, next(b for b in range(a, len(sizes) + 1) if ok(a, b))) for a in range(len(sizes)) if ok(a, len(sizes))}
        spans |= {(next(a for a in range(b, -1, -1) if ok(a, b)), b) for b in range(len(sizes) + 1) if ok(0, b)}
        for a, b in spans:
            text, at = tuple(" ".join(sentences[a:b]).split()), (-1 if doc is None else doc, a, b)
            found.append((doc, text, at))
            place[text] = min(at, place.get(text, at))
    out = {doc: set() for doc, _ in docs}
    for doc, text, at in found:
        if at != place[text]:
            out[doc] |= set(range(*at[1:]))
    return {doc: sorted(gone) for doc, gone in out.items()}


@pytest.mark.parametrize("batch", [7, 1000])
def test_spans_by_hand(spark, monkeypatch, batch):
    """All that goes, among documents of few sentences with a passage that a third of them holds and rows twice over."""
    rng = np.random.default_rng(batch)
    pool = [" ".join(words(k, 3 + k % 7)) + "." for k in range(40)]
    docs = [(None if k == 50 else k, [pool[j] for j in rng.integers(0, 40 if k % 2 else 9, rng.integers(0, 14))] + pool[20:24] * (k % 3 == 0)) for k in range(200)]
    docs += docs[30:40]
    monkeypatch.setattr(span_dedup, "small_batches", lambda session: session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch)))
    out = span_dedup.remove_repeats(table(spark, [(d, " ".join(t)) for d, t in docs]).repartition(3)).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = removed_by_hand(docs)
    assert len(out) == len(docs) and any(want.values())
    for r in out:
        assert r["removed"] == want[r["doc_id"]], r["doc_id"]


def test_spans_of_passages_anywhere(spark):
    """Passages of 51 words, with and without stops, among other words at any offsets: all goes but what is within ten
    words of their ends."""
    docs, wants = [], {}
    for k in range(120):
        passage = [f"p{k}x{j}" + "." * (k % 3 > 0 and j % (4 + k % 23) == k % 4) for j in range(51)]
        docs.append((2 * k, " ".join(words(3000 + k, k * 7 % 31) + passage + words(5000 + k, 20))))
        docs.append((2 * k + 1, " ".join(words(7000 + k, k % 13) + passage + words(9000 + k, k * 11 % 29))))
        wants[2 * k + 1] = passage
    out = {r["doc_id"]: r for r in span_dedup.remove_repeats(table(spark, docs)).collect()}
    for doc, passage in wants.items():
        assert out[doc - 1]["n_removed"] == 0
        assert not set(passage[10:-10]) & set(out[doc]["text"].split()), doc
    pieces = lambda text: span_dedup.sentences(span_dedup.pa.array([text], span_dedup.pa.large_string()), 10)[3].tolist()
    assert pieces("He said \u201cgo.\u201d Then (he left!) Now") == [0, 3, 6, 7]
    assert pieces("\u4f60\u597d\u3002 \u4f60\u597d\uff1f\u300d \u0939\u0948\u0964 \u0645\u0627\u061f end") == [0, 1, 2, 3, 4, 5]
    assert max(np.diff(pieces(" ".join(words(4, 3000))))) <= 10


def test_quality_on_held_out(spark):
    junk = lambda k: " | ".join(words(k, 40)) if k % 2 else " ".join(w.upper() + "!!" for w in words(k, 40))
    fine = lambda k: ". ".join(" ".join(words(k * 9 + j, 8)).capitalize() for j in range(12)) + "."
    docs = [(k, junk(k) if k % 3 == 0 else fine(k)) for k in range(400)] + [(1000, None), (1001, ""), (1002, fine(7) * 40)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), None) for k in range(400)] + [(1, 0, None), (2000, 1, 0), (None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    out = quality.quality_scores(table(spark, docs), labels).collect()
    assert len(out) == len(docs)
    held = [r for r in out if r["held_out"] and r["doc_id"] < 400]
    assert len(held) > 50 and np.mean([r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert quality.quality_scores(table(spark, []), labels).count() == 0
    assert {r["score"] for r in quality.quality_scores(table(spark, docs[:5]), labels.limit(0)).collect()} == {1.0}


def test_attention_gradients():
    rng = np.random.default_rng(0)
    bags, labels = [rng.random((k % 3 + 1, quality.FEATURES)) for k in range(6)], np.array([0, 1, 1, 0, 1, 0.0])
    w = quality.fit(bags, labels, hidden=4, gate=3, epochs=1)
    x, at = np.concatenate(bags), np.concatenate(([0], np.cumsum([len(b) for b in bags])))
    loss = lambda: -np.mean(labels * np.log(quality.forward(w, x, at)["p"]) + (1 - labels) * np.log(1 - quality.forward(w, x, at)["p"]))
    for name, g in quality._gradients(w, x, at, labels).items():
        at_ = tuple(0 for _ in np.shape(w[name]))
        before = np.array(w[name])
        step = np.zeros_like(before)
        step[at_] = 1e-6
        w[name] = before + step
        up = loss()
        w[name] = before - step
        down = loss()
        w[name] = before
        assert (up - down) / 2e-6 == pytest.approx(np.array(g)[at_], abs=1e-6)


def brute_sets(docs, width):
    import re

    out = []
    for d, t in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if x]
        out.append((d, {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()))
    return out


def brute_components(docs, width, percent):
    sets = brute_sets(docs, width)
    label = list(range(len(docs)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and 100 * len(a & b) >= percent * len(a | b):
                label[root(i)] = root(j)
    key = lambda d: -(1 << 63) if d is None else d
    groups = defaultdict(list)
    for i, (d, _) in enumerate(sets):
        groups[root(i)].append(d)
    return Counter((d, len(s), min(groups[root(i)], key=key)) for i, (d, s) in enumerate(sets))


def family(k, n, edits):
    base = words(k, n)
    out = []
    for m in range(edits):
        w = list(base)
        for e in range(m % 5):
            w[(m * 31 + e * 17) % n] = f"edit{k}x{m}x{e}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_jaccard(spark, monkeypatch, width, percent):
    common = " ".join(words(999, 30))
    docs = odd()
    docs += [(100 + k, t) for k, t in enumerate(family(3, 150, 40) + family(4, 60, 30) + family(5, 12, 10))]
    docs += [(300 + k, common + " " + " ".join(words(2000 + k, 40 + k % 40))) for k in range(80)]
    docs += [(500 + k, " ".join(words(77, 80)[: 80 - k])) for k in range(30)]
    want = brute_components(docs, width, percent)
    assert Counter(map(tuple, jaccard.jaccard_components(table(spark, docs), width, percent).collect())) == want
    monkeypatch.setattr(jaccard, "TILE", 8)
    monkeypatch.setattr(jaccard.frequent_shingles, "__defaults__", (50,))
    assert Counter(map(tuple, jaccard.jaccard_components(table(spark, docs), width, percent).collect())) == want
    assert jaccard.jaccard_components(table(spark, [])).count() == 0


def test_no_pair_leaves_a_tile_unlinked(spark):
    """A family whose every two are candidates: what the tiles return is no longer than their rows."""
    docs = table(spark, [(k, t) for k, t in enumerate(family(3, 150, 200) + family(3, 150, 200))]).select("doc_id", "text")
    rows = jaccard.document_sets(docs, 3, 90).filter("sig IS NOT NULL").selectExpr("doc_id AS node", "n", "sig", "hi", "lo").dropDuplicates(["hi", "lo"])
    arrays = jaccard.full_sets(docs, 3)
    tile = rows.join(arrays, ["hi", "lo"]).selectExpr("1L AS h", "0 AS side", "true AS one", "node", "node AS c", "false AS met", "n", "sig", "arr")
    assert 0 < jaccard.links(tile, 90).count() < tile.count()


def test_hashes_of_long_words():
    """The Thue-Morse word and its complement have one polynomial hash modulo 2**64, whatever the base."""
    word = bytes(97 + (k.bit_count() & 1) for k in range(8192))
    data = np.frombuffer(word + bytes(195 - x for x in word), np.uint8)
    for seed in wordhash.SEEDS:
        a, b = wordhash.span_hashes(data, np.array([0, 8192]), np.array([8192, 16384]), seed)
        assert a != b
    texts = [data[:8192].tobytes().decode(), data[8192:].tobytes().decode(), "cab"]
    ids, ends = encoder(tokenizer_path()).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [ids_of(t) for t in texts]


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            label[y] = x
    assert got == {x: root(x) for x in label}


@pytest.mark.parametrize("hot", [1000, 4])
def test_exact_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(exact, "HOT", hot)
    docs = odd() + [(20, "x"), (21, "x"), (21, "x"), (22, "x"), (None, "x"), (None, "lonely"), (None, "lonely")]
    out = exact.exact_dedup(table(spark, docs)).collect()
    groups = defaultdict(list)
    for d, t in docs:
        groups[t or ""].append(d)
    key = lambda d: -(1 << 63) if d is None else d
    want = Counter((d, max(groups[t or ""], key=key), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in docs)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out) == want
    kept = [r for r in out if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exact.exact_dedup(table(spark, [])).count() == 0


def test_minimal_perfect_hash():
    digests = np.stack([np.frombuffer(hashlib.sha256(str(k).encode()).digest(), np.uint8) for k in range(5000)])
    levels = exact.build_levels(digests)
    assert sorted(exact.slots_of(digests, levels)) == list(range(5000))
    other = np.stack([np.frombuffer(hashlib.sha256(str(-k - 1).encode()).digest(), np.uint8) for k in range(500)])
    assert exact.slots_of(other, levels).max() < 5000


def test_contamination(spark):
    import re

    items = [(1, " ".join(words(9, 40))), (2, "only five words in here"), (3, None), (4, ""), (5, "Word"), (6, " ".join(words(9, 40)[10:30])), (6, "two words"), (10, " ".join(["same"] * 20)), (11, "ÉCOLE Über alles zwei drei")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    hit = words(9, 40)
    docs = odd() + [(30, " ".join(words(31, 50) + hit[5:20] + words(32, 30))), (31, " ".join(hit[:12])), (32, "Only FIVE, words in-here! and a word more"), (33, " ".join(hit + ["x"] * 1500)), (34, "éCOLE über alles zwei drei"), (35, "École... ÉCOLE über alles; zwei drei"), (30, " ".join(hit[:14]))]

    def toks(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    windows = defaultdict(set)
    for i, t in items:
        w = toks(t)
        if w:
            for k in range(max(len(w) - 12, 1)):
                windows[tuple(w[k : k + 13])].add(i)

    def brute(d, t):
        w, covered, found = toks(t), set(), set()
        for win, ids in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    covered |= set(range(k, k + len(win)))
                    found |= ids
        ids = ",".join(sorted(map(str, found)))
        return d, len(w), len(covered), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(covered) and 20 * len(covered) >= len(w)

    want = Counter(brute(d, t) for d, t in docs)
    assert Counter(map(tuple, decontam.contamination(table(spark, docs), bench).collect())) == want
    old, decontam.BLOCK = decontam.BLOCK, 15
    try:
        assert Counter(map(tuple, decontam.contamination(table(spark, docs), bench).collect())) == want
    finally:
        decontam.BLOCK = old
    assert decontam.contamination(table(spark, []), bench).count() == 0
    assert {r["n_hit"] for r in decontam.contamination(table(spark, docs), bench.limit(0)).collect()} == {0}


def test_equal_rows_give_few_ranges(spark):
    text = ". ".join(" ".join(words(k, 12)) for k in range(40))
    docs = table(spark, [(1, text)] * 400 + [(2, text)] * 300)
    out = {(r["doc_id"], r["n_removed"], r["n_sentences"]) for r in span_dedup.remove_repeats(docs).collect()}
    n = next(n for d, _, n in out if d == 1)
    assert out == {(1, 0, n), (2, n, n)}
    rows = docs.selectExpr("xxhash64(text) AS row", "doc_id", "text")
    gone = span_dedup.repeated_spans(span_dedup.document_spans(rows, 10, 2, 20)).groupBy("doc_id", "row").agg({"a": "count"}).collect()
    assert len(gone) == 1  # one text's ranges, held once each by remove_repeats


def test_learning_takes_one_row_of_an_id(spark):
    many = table(spark, [(5, f"some text {k} " * 20) for k in range(500)] + [(k, "Good prose stands here." if k % 2 else "xx xx xx xx") for k in range(6, 40)])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(5, 40)], "doc_id long, quality int, toxic int")
    sizes = []
    real = quality.fit
    quality.fit = lambda bags, labels, **how: sizes.append(len(bags)) or real(bags, labels, epochs=1)
    try:
        quality.train(many, labels)
    finally:
        quality.fit = real
    held = {k for k in range(5, 40) if zlib.crc32(str(k).encode()) % 4 == 2}
    assert sizes == [35 - len(held)]
