"""Keys of what was seen, streams over them, and tables that are rewritten while they are read."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledger_spark.operators import dedupe
from ledger_spark.sources import history, versioned
from ledger_spark.streaming import watch

ARRIVALS = "user_id int, statement_id long, file_name string, file_hash string, content_hash string, uploaded_at timestamp"


def arrivals(n, seed):
    rng, day = random.Random(seed), datetime(2024, 1, 1)
    pick = lambda k, none: None if rng.random() < none else f"h{rng.randrange(k)}"
    return [(rng.randrange(2), 1000 * seed + k, f"f{rng.randrange(5)}.pdf", pick(12, 0.1), pick(14, 0.1), day + timedelta(hours=seed * 100 + rng.randrange(40))) for k in range(n)]


def one_by_one(batches):
    """As the rule says: check, then keep what is new."""
    kept, out = {}, {}
    for batch in batches:
        for user, s, name, file, content, at in sorted(batch, key=lambda r: (r[5], r[2], r[1])):
            hit = [kept.get((user, k)) for k in (file and "f" + file, content and "c" + content)]
            kind = "exact_file" if hit[0] else "exact_content" if hit[1] else None
            out[s] = (kind, hit[0] or hit[1])
            if not kind:
                kept.update({(user, k): name for k in (file and "f" + file, content and "c" + content) if k})
    return out


@pytest.fixture
def seen(spark, tmp_path):
    names = []

    def make(buckets=4):
        names.append(history.opened(spark, f"file://{tmp_path}/seen{len(names)}", buckets))
        return names[-1]

    yield make
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_screened_is_one_by_one(spark, seen):
    name, batches = seen(), [arrivals(n, k + 1) for k, n in enumerate((40, 0, 60, 25))]
    want, got = one_by_one(batches), {}
    for k, batch in enumerate(batches):
        out = history.screened(spark.createDataFrame(batch, ARRIVALS), name, k)
        rows = out.collect()
        assert len(rows) == len(batch)
        got |= {r["statement_id"]: (r["duplicate_type"], r["original_name"]) for r in rows}
        assert all(r["is_duplicate"] == (r["confidence"] == 1.0) == (r["duplicate_type"] is not None) for r in rows)
        history.add(history.keyed(out.filter("NOT is_duplicate"), {"file": F.col("file_hash"), "content": F.col("content_hash")}), name, k)
    assert got == want and {v[0] for v in want.values()} == {None, "exact_file", "exact_content"}


def test_equal_rows_are_rows(spark, seen):
    out = history.screened(spark.createDataFrame([arrivals(1, 1)[0]] * 3, ARRIVALS), seen())
    assert sorted(r["is_duplicate"] for r in out.collect()) == [False, True, True]


def test_stream_goes_on_after_a_failure(spark, tmp_path, monkeypatch):
    batches = [arrivals(30, k + 1) for k in range(3)]
    folder, seen, table, check = (f"file://{tmp_path}/{n}" for n in ("in", "seen", "out", "check"))

    def run():
        stream = spark.readStream.schema(ARRIVALS).parquet(folder)
        watch.screen(stream, seen, table, check, buckets=4).awaitTermination()

    real, fail = history.add, {"at": 1}

    def broken(keys, name, batch):
        if batch == fail["at"]:
            real(keys.limit(3), name, batch)  # a part of the batch's keys is there, then the job dies
            raise RuntimeError("lost")
        real(keys, name, batch)

    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, ARRIVALS).write.mode("append").parquet(folder)
        monkeypatch.setattr(history, "add", broken)
        if k == 1:
            with pytest.raises(Exception):
                run()
            fail["at"] = None
        run()
    got = spark.read.parquet(table).collect()
    assert len(got) == 90
    assert {r["statement_id"]: (r["duplicate_type"], r["original_name"]) for r in got} == one_by_one(batches)
    spark.sql(f"DROP TABLE IF EXISTS {history.opened(spark, seen)}")


def test_history_is_not_shuffled(spark, seen):
    name = seen(8)
    past = spark.createDataFrame(arrivals(200, 3), ARRIVALS)
    history.add(history.keyed(past, {"file": F.col("file_hash"), "content": F.col("content_hash")}), name, 0)
    new = spark.createDataFrame(arrivals(50, 4), ARRIVALS)
    keys = history.keyed(new, {"file": F.col("file_hash")})
    plan = history.known(keys, name)._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.index("SortMergeJoin") :]
    assert side.index("Bucketed: true") < side.index("Exchange"), plan  # the history is the first side of the join
    want = {(r["statement_id"], r["duplicate_type"], r["original_name"]) for r in dedupe.duplicates(new, past).collect()}
    assert {(r["statement_id"], r["duplicate_type"], r["original_name"]) for r in history.duplicates(new, name).collect()} == want
    left = {r["statement_id"] for r in dedupe.unseen(new.filter("file_hash IS NOT NULL"), past).collect()}
    assert {r["statement_id"] for r in history.unseen(new, name, "file", F.col("file_hash")).filter("file_hash IS NOT NULL").collect()} == left


ROWS = "user_id int, statement_id long, txn_idx int, note string"


def state(df):
    return sorted(tuple(r) for r in df.select("user_id", "statement_id", "txn_idx", "note").collect())


def test_upserts_show_whole_versions(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    make = lambda rows: spark.createDataFrame(rows, ROWS)
    assert versioned.read(spark, path) is None and versioned.vacuum(spark, path) == 0
    first = [(u, 10 * u + s, k, "old") for u in (1, 2, 3) for s in (0, 1) for k in range(3)]
    assert versioned.upsert(make(first), path) == 1
    reader = versioned.read(spark, path)
    second = [(1, 10, 0, "new"), (4, 40, 0, "new")]
    assert versioned.upsert(make(second), path, gone=make([(2, 20, 0, ""), (2, 21, 0, "")])) == 2
    assert state(reader) == sorted(first)  # who began before the switch sees the old state
    want = sorted([r for r in first if r[1] not in (10, 20, 21)] + second)
    now = versioned.read(spark, path)
    assert state(now) == want and state(versioned.read(spark, path, 1)) == sorted(first)
    files = lambda df: {f.rsplit("/", 1)[-1] for f in df.inputFiles()}
    parts = {p.name for p in (tmp_path / "t" / "data").iterdir() if p.name.startswith("part=")}
    assert sorted(p.rsplit("_", 1)[1] for p in parts) == ["1", "1", "2", "3", "4"]  # user 3 wasn't rewritten, user 2 has no rows left
    assert "dynamicpruning" in now._jdf.queryExecution().executedPlan().toString().lower() and files(now)
    assert versioned.upsert(make([]), path) == 3 and state(versioned.read(spark, path)) == want
    assert versioned.vacuum(spark, path, keep=1) == 2 and state(versioned.read(spark, path)) == want
    with pytest.raises(ValueError):
        versioned.upsert(make([(None, 1, 1, "x")]), path)


def test_an_overtaken_writer_changes_nothing(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    make = lambda rows: spark.createDataFrame(rows, ROWS)
    versioned.upsert(make([(1, 1, 0, "a")]), path)
    real = versioned.version
    monkeypatch.setattr(versioned, "version", lambda *a: real(*a) - 1 if real(*a) == 2 else real(*a))
    versioned.upsert(make([(1, 2, 0, "b")]), path)
    with pytest.raises(versioned.Conflict):
        versioned.upsert(make([(1, 3, 0, "c")]), path)
    monkeypatch.setattr(versioned, "version", real)
    assert state(versioned.read(spark, path)) == [(1, 1, 0, "a"), (1, 2, 0, "b")]


def test_hashes_are_stored_once(spark, seen, monkeypatch):
    wrote = []
    stored = history.stored
    monkeypatch.setattr(history, "stored", lambda df, *by: wrote.append(df.columns) or stored(df, *by))
    rows = stored(history.numbered(spark.createDataFrame(arrivals(20, 1), ARRIVALS)))
    history.screened(rows, seen())
    assert len(wrote) > 3 and not any({"file_hash", "content_hash"} & set(c) for c in wrote)
    assert [c for c in wrote if "key" in c] == [["user_id", "key", "name", "old"]]  # what the history holds, nothing else
