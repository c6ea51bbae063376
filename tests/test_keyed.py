"""The keyed table and the limiter on streams."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from skein.sources.keyed import KeyedTable
from skein.streaming import events


def rows_of(table):
    return {(r.k, r.v) for r in table.read().collect()}


def made(spark, tmp_path, buckets=4):
    schema = spark.createDataFrame([], "k long, v string").schema
    return KeyedTable.create(spark, str(tmp_path / "t"), schema, ["k"], buckets)


def batch(spark, rows):
    return spark.createDataFrame(rows, "k long, v string")


def test_merges_against_a_dictionary(spark, tmp_path):
    table, rng, want = made(spark, tmp_path), random.Random(1), {}
    for number in range(1, 5):
        rows = [(rng.randrange(40), f"{number}-{i}") for i in range(20)]
        keep = "old" if number == 3 else "new"
        assert table.merge(batch(spark, rows), "w", number, ["v"], keep)
        last = {}
        for k, v in rows:
            last[k] = max(v, last.get(k, ""))
        want = {**last, **want} if keep == "old" else {**want, **last}
        assert rows_of(table) == set(want.items())
    assert not table.merge(batch(spark, [(1, "again")]), "w", 4)
    assert table.merge(batch(spark, []), "other", 1)
    assert rows_of(table) == set(want.items())
    assert {(r.k, r.v) for r in table.lookup(spark.range(5).withColumnRenamed("id", "k")).collect()} == {(k, v) for k, v in want.items() if k < 5}
    table.vacuum()
    assert len(table.versions()) == 1 and rows_of(table) == set(want.items())


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = made(spark, tmp_path, 8)
    table.merge(batch(spark, [(k, "a") for k in range(200)]), "w", 1)
    before = table.manifest()["folders"]
    table.merge(batch(spark, [(7, "b")]), "w", 2)
    after = table.manifest()["folders"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert {(r.k, r.v) for r in table.read(1).collect()} == {(k, "a") for k in range(200)}


def test_a_batch_that_ends_half_way_leaves_the_table(spark, tmp_path, monkeypatch):
    table = made(spark, tmp_path)
    table.merge(batch(spark, [(1, "a")]), "w", 1)

    def killed(manifest):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(table, "_commit", killed)
        table.merge(batch(spark, [(1, "b"), (2, "b")]), "w", 2)
    assert rows_of(table) == {(1, "a")}
    assert table.merge(batch(spark, [(1, "b"), (2, "b")]), "w", 2)
    table.vacuum()
    assert rows_of(table) == {(1, "b"), (2, "b")}


def test_of_two_writers_one_has_to_try_again(spark, tmp_path, monkeypatch):
    table = made(spark, tmp_path)
    other, old = KeyedTable(spark, table.path), table.manifest()
    table.merge(batch(spark, [(1, "a")]), "w", 1)
    with monkeypatch.context() as m, pytest.raises(RuntimeError, match="another writer"):
        m.setattr(other, "manifest", lambda version=None: old)
        other.merge(batch(spark, [(2, "b")]), "v", 1)
    assert other.merge(batch(spark, [(2, "b")]), "v", 1)
    assert rows_of(table) == {(1, "a"), (2, "b")}


def test_errors(spark, tmp_path):
    table = made(spark, tmp_path)
    with pytest.raises(Exception, match="null"):
        table.merge(batch(spark, [(None, "a")]), "w", 1)
    with pytest.raises(ValueError, match="columns"):
        table.merge(batch(spark, [(1, "a")]).withColumn("more", F.lit(1)), "w", 1)
    with pytest.raises(RuntimeError, match="another writer"):
        made(spark, tmp_path)


def brute(rows, limit, seconds):
    """event_id to whether it is accepted, by looking at all accepted events of the user."""
    out, accepted = {}, {}
    for user, ts, event in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        mine = accepted.setdefault(user, [])
        out[event] = sum(ts - t < seconds for t in mine) < limit
        if out[event]:
            mine.append(ts)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "user_id long, s long, event_id long").select("user_id", F.timestamp_seconds("s").alias("ts"), "event_id")


def test_limiter_on_a_stream_is_the_batch(spark, tmp_path):
    """Several batches out of order within the lateness, a restart, a hot user, a null user, and a late event."""
    rng, base = random.Random(2), 1_700_000_000
    rows = [(rng.choice((1, 1, 1, 2, 3, None)), base + 20 * i + rng.randrange(-200, 200), i) for i in range(240)]
    files, out, point = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "point")

    def run(part):
        frame(spark, part).coalesce(1).write.mode("append").parquet(files)
        stream = spark.readStream.schema("user_id long, ts timestamp, event_id long").parquet(files)
        query = events.limited(stream, 3, 120).writeStream.format("parquet").option("path", out).option("checkpointLocation", point).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None

    for at in range(0, 240, 80):
        run(rows[at : at + 80])
    run([(9, base + 100_000, 1000)])
    run([(1, base + 50, 1001), (9, base + 200_000, 1002)])
    want = brute(rows, 3, 120)
    got = {r.event_id: r.accepted for r in spark.read.parquet(out).collect()}
    # The late event has no row; the last one waits for the watermark.
    assert got == {**want, 1000: True}
    assert {r.event_id: r.accepted for r in events.limited(frame(spark, rows), 3, 120).collect()} == want
    assert 0 < sum(want.values()) < len(want)
