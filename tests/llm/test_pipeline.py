from collections import Counter

import corpus_pipeline
from cases import table, words


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(docs, items):
    """The rows that the stages 2 to 4 keep."""
    least = {}
    for d, t in docs:
        least.setdefault(t or "", set()).add(d)
    rows = [(max(ids, key=lambda d: (d is not None, d or 0)), t) for t, ids in least.items()]
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    first = {}
    for k, (d, _) in enumerate(rows):
        first.setdefault(label[k], []).append((d is not None, d or 0, k))
    rows = [rows[min(group)[2]] for group in first.values()]
    windows = [tuple(w[i : i + 13]) for w in (t.split() for t in items) for i in range(max(len(w) - 12, 1))]
    out = []
    for d, t in rows:
        w = t.lower().split()
        hit = {i + k for i in range(len(w)) for x in windows if tuple(w[i : i + len(x)]) == x for k in range(len(x))}
        if not hit or 20 * len(hit) < len(w):
            out.append((d, t))
    return out


def test_pipeline_with_null_and_repeated_ids(spark, tmp_path):
    item = words(900, 15)
    near = lambda k, at: " ".join(words(k, 80)[:at] + ["other"] + words(k, 80)[at + 1 :])
    text = lambda k: " ".join(words(k, 60))
    dirty = lambda k: " ".join(words(k, 40) + item)
    docs = [
        (None, text(1)), (None, dirty(2)), (None, text(3)), (5, text(4)), (5, dirty(5)), (5, text(6)), (7, near(7, 30)), (8, near(7, 50)), (8, text(8)), (8, text(9)),
        (None, near(10, 20)), (11, near(10, 60)), (12, text(12)), (12, text(12)), (13, text(1)), (14, ""), (15, None), (15, ""), (None, near(13, 10)), (None, near(14, 10)), (16, near(14, 70)), (9, near(7, 40)),
    ]
    table(spark, docs).coalesce(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left, counts = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = corpus_pipeline.materialize(stage(spark, left, str(tmp_path)))
        counts.append(left.count())
    assert left.columns == table(spark, []).columns and counts[0] == len(docs)
    want = Counter(brute(docs, [" ".join(item)]))
    assert Counter((r["doc_id"], r["text"] or "") for r in left.collect()) == want
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {d for d, _ in want}
