"""The report store: versions that are seen whole, failed saves, and what is kept."""

import os

import pytest

from docaudit.sources import sinks
from docaudit.sources.sinks import ReportStore

REPORTS, FINDINGS, TASKS = "task_id string, level string, document_id long", "task_id string, finding_id string", "task_id string, document_id long, status string, progress_pct int"


def loaded(spark, folder, n=20, **options):
    store = ReportStore(spark, str(folder), **{"buckets": 4, **options})
    ids = [f"K{i}" for i in range(n)]
    store.load(
        spark.createDataFrame([(k, "old", i) for i, k in enumerate(ids)], REPORTS),
        spark.createDataFrame([(k, f"{k}-{j}") for k in ids for j in range(2)], FINDINGS),
        spark.createDataFrame([(k, i, "RUNNING", 50) for i, k in enumerate(ids)], TASKS),
    )
    return store


def save(spark, store, ids, level="new"):
    store.save(spark.createDataFrame([(k, level, 1) for k in ids], REPORTS), spark.createDataFrame([(k, level) for k in ids], FINDINGS))


def content(tables):
    return {name: sorted(map(tuple, df.collect())) for name, df in tables.items()}


def test_a_save_replaces_reports_findings_and_tasks(spark, tmp_path):
    store = loaded(spark, tmp_path / "s", buckets=5)
    save(spark, store, ["K3", "K7", "X"])
    assert store.versions() == [0, 1]
    reports = {r["task_id"]: r["level"] for r in store.read("reports").collect()}
    assert reports == {**{f"K{i}": "old" for i in range(20)}, "K3": "new", "K7": "new", "X": "new"}
    findings = [tuple(r) for r in store.read("findings").collect()]
    assert sorted(f for f in findings if f[0] in ("K3", "K7", "X")) == [("K3", "new"), ("K7", "new"), ("X", "new")] and len(findings) == 39
    done = {r["task_id"] for r in store.read("tasks").where("status = 'COMPLETED' and progress_pct = 100").collect()}
    assert done == {"K3", "K7", "X"} and store.read("tasks").count() == 21
    # Another handle reads the number of buckets from the store.
    save(spark, ReportStore(spark, str(tmp_path / "s"), buckets=3), ["K3"], "newer")
    assert store.read("reports").where("task_id = 'K3'").count() == 1 and store.read("findings").count() == 39


def test_readers_keep_the_version_they_took(spark, tmp_path):
    store = loaded(spark, tmp_path / "s")
    taken, before = store.tables(), content(store.tables())
    save(spark, store, [f"K{i}" for i in range(20)])
    assert content(taken) == before != content(store.tables())


def test_a_failed_save_changes_nothing(spark, tmp_path, monkeypatch):
    store = loaded(spark, tmp_path / "s")
    before = content(store.tables())
    whole = ReportStore._write

    def breaks(self, name, df, number, buckets):
        if name == "tasks":
            raise OSError("lost")
        return whole(self, name, df, number, buckets)

    monkeypatch.setattr(ReportStore, "_write", breaks)
    with pytest.raises(OSError):
        save(spark, store, ["K1", "K2"])
    assert content(store.tables()) == before and store.versions() == [0]
    monkeypatch.undo()
    save(spark, store, ["K1", "K2"])
    once = content(store.tables())
    save(spark, store, ["K1", "K2"])
    assert content(store.tables()) == once != before


def test_of_two_saves_one_must_be_repeated(spark, tmp_path, monkeypatch):
    store = loaded(spark, tmp_path / "s")
    merge = sinks.save_results

    def overtaken(*tables):
        monkeypatch.setattr(sinks, "save_results", merge)
        save(spark, ReportStore(spark, str(tmp_path / "s")), ["K1"], "first")
        return merge(*tables)

    monkeypatch.setattr(sinks, "save_results", overtaken)
    with pytest.raises(RuntimeError, match="repeat"):
        save(spark, store, ["K2"], "second")
    assert {r["level"] for r in store.read("reports").where("task_id in ('K1', 'K2')").collect()} == {"first", "old"}
    assert store.versions() == [0, 1]


def test_old_versions_go_and_emptied_buckets_stay_empty(spark, tmp_path):
    store = loaded(spark, tmp_path / "s", n=3, buckets=2, keep=2)
    for level in "abcd":
        save(spark, store, ["K0", "K1", "K2"], level)
    assert store.versions() == [3, 4] and {r["level"] for r in store.read("reports").collect()} == {"d"}
    assert sorted(d.split("-")[0] for d in os.listdir(tmp_path / "s" / "reports")) == ["3", "4"]
    store.save(spark.createDataFrame([("K0", "e", 1), ("K1", "e", 1), ("K2", "e", 1)], REPORTS), spark.createDataFrame([], FINDINGS))
    assert store.read("findings").count() == 0 and store.read("findings").columns == ["task_id", "finding_id"]
    store.save(spark.createDataFrame([], REPORTS), spark.createDataFrame([], FINDINGS))
    assert store.versions() == [4, 5]
