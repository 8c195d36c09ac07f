"""What stream jobs remember: bounded reads over many batches, and jobs in many batches against folds over all rows."""

import os
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docaudit.streaming import jobs as J
from docaudit.streaming.history import History, Index, hashed

EVENTS = "event_id string, event string, task_id string, document_id long, audit_version int, occurred_at timestamp, seq long, data string"
START = datetime(2024, 1, 1)


@pytest.fixture
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_reads_stay_flat_over_a_hundred_batches(spark, tmp_path, few_partitions):
    index = Index("seen", "k bigint, v bigint", hashed("k", cells=3))
    read = []
    for n in range(100):
        history = History(spark, str(tmp_path), n)
        history.forget_merged()
        read.append(len(history.paths(index)))
        history.remember(index, spark.range(2).select((F.col("id") + n).alias("k"), F.lit(n).cast("long").alias("v")))
    # Three segments of 1, 4, 16 and one of 64 batches at most; of one key one cell each.
    assert max(read[50:]) <= 3 * 10 and max(read[90:]) <= max(read[20:64])
    history = History(spark, str(tmp_path), 100)
    assert len(history.segments(index)) == 4  # 64 + 2 * 16 + 4
    assert sorted((r.k, r.v, r.batch) for r in history.rows(index).collect()) == sorted((n + i, n, n) for n in range(100) for i in (0, 1))
    one = spark.createDataFrame([(7,), (7,), (-1,)], "k int")
    assert sorted((r.k, r.batch) for r in history.of_keys(index, one).collect()) == [(7, 6), (7, 7)]
    history.forget_merged()
    assert len(os.listdir(f"{tmp_path}/history/seen")) == 4


@pytest.mark.parametrize("batches", [0, 1, 3, 4, 15, 16, 17, 64, 255, 1000])
def test_segments_cover_every_batch_once(spark, batches):
    index = Index("i", "k int", "0")
    spans = [tuple(map(int, p.rsplit("/", 1)[1].split("-"))) for p in History(spark, "x", batches).segments(index)]
    assert [x for low, high in spans for x in range(low, high)] == list(range(batches))
    assert len(spans) <= 3 * 6


def test_keys_may_be_null_and_popular(spark, tmp_path, few_partitions):
    index = Index("seen", "a string, b int", hashed("a", "b"))
    rows = spark.createDataFrame([(None, 1), ("x", None), (None, None), *[("hot", 1)] * 50], "a string, b int")
    empty = rows.where("false")
    for n, df in enumerate([rows, empty, empty, rows, empty]):
        History(spark, str(tmp_path), n).remember(index, df)
    history = History(spark, str(tmp_path), 5)
    found = history.of_keys(index, spark.createDataFrame([(None, None), ("hot", 1), ("y", 2)], "a string, b int"))
    assert sorted((str(r.a), r.batch, r["count"]) for r in found.groupBy("a", "batch").count().collect()) == [("None", 0, 1), ("None", 3, 1), ("hot", 0, 50), ("hot", 3, 50)]
    assert history.of_keys(index, empty).count() == 0


def feed(spark, folder, handle, batches, broken=()):
    """The batches one by one, those in ``broken`` twice as after a failure at their end, each from a fresh start."""
    for n, rows in enumerate(batches):
        for _ in range(2 if n in broken else 1):
            J.land(spark, folder, handle(), spark.createDataFrame(rows, EVENTS), n)
    return spark.read.schema(f"{handle().schema}, batch bigint").parquet(f"{folder}/out")


def missed_by_fold(events):
    """Tasks late by all events up to now, task by task."""
    times = [e[5] for e in events if e[5] is not None]
    starts, ends = {}, defaultdict(list)
    for _, kind, task, _, _, at, _, _ in events:
        if at is not None and kind == "task_started":
            starts[task] = min(at, starts.get(task, at))
        if at is not None and kind in ("task_completed", "task_failed"):
            ends[task].append(at)
    limit = timedelta(seconds=120)
    in_time = lambda task, at: task is not None and any(at <= end <= at + limit for end in ends[task])
    return {(task, at) for task, at in starts.items() if not in_time(task, at) and at + limit + timedelta(seconds=600) <= max(times)}


def test_deadlines_over_late_and_repeated_batches(spark, tmp_path, few_partitions):
    rng = random.Random(11)
    batches, late = [], []
    for n in range(18):
        rows = []
        for i in range(rng.choice([0, 1, 25, 25])):
            at = rng.choice([None, *[START + timedelta(seconds=n * 900 - rng.choice([0, 0, 5000]) + rng.randint(0, 900))] * 15])
            kind = rng.choice(["task_started", "task_started", "task_completed", "task_failed", "task_progress"])
            task = rng.choice([None, *[f"K{n * 3 + rng.randint(-4, 3)}"] * 12])
            rows.append((f"{n}-{i}", kind, task, 1, 1, at, i, "{}"))
            if at is not None and kind == "task_started" and rng.random() < 0.5:
                end = (f"{n}-{i}e", "task_completed", task, 1, 1, at + timedelta(seconds=rng.choice([0, 119, 120, 121])), i, "{}")
                (late if rng.random() < 0.3 else rows).append(end)
        batches.append(rows)
    batches.append(late)
    landed = feed(spark, str(tmp_path / "job"), J.DeadlineHandler, batches, broken={3, 7, 15, 16})
    changes = [(r.batch, r.event, r.task_id, r.occurred_at) for r in landed.collect()]
    assert any(c[1] == "withdrawn" for c in changes) and len(changes) > 30
    open_now = set()
    for n in range(len(batches)):
        for _, event, task, at in (c for c in changes if c[0] == n):
            (open_now.add if event == "missed" else open_now.remove)((task, at))
        seen = [e for rows in batches[: n + 1] for e in rows]
        assert open_now == (missed_by_fold(seen) if any(e[5] for e in seen) else set()), n
    assert {(r.task_id, r.started_at) for r in J.DeadlineHandler.missed(landed).collect()} == open_now


def test_events_are_consumed_once_over_many_batches(spark, tmp_path, few_partitions):
    rng = random.Random(5)
    batches, ids, pairs, expected = [], set(), set(), set()
    for n in range(9):
        rows = [
            (f"e{rng.randint(0, 60)}", "task_started", f"K{rng.randint(0, 9)}", 1, rng.randint(1, 3), START + timedelta(seconds=rng.randint(0, 50)), n * 100 + i, "{}")
            for i in range(rng.choice([0, 8, 12]))
        ]
        batches.append(rows)
        for e in sorted(rows, key=lambda e: (e[5], e[6])):
            if e[0] not in ids:
                ids.add(e[0])
                if (e[2], e[4]) not in pairs:
                    pairs.add((e[2], e[4]))
                    expected.add((n, e[0], e[2], e[4]))
    landed = feed(spark, str(tmp_path / "job"), J.ConsumeOnce, batches, broken={0, 3, 4})
    assert {(r.batch, r.event_id, r.task_id, r.audit_version) for r in landed.where("accepted").collect()} == expected
    assert landed.count() == len(ids)
