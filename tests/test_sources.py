"""Reads of stored tables and uploaded files."""

import hashlib

import pytest
from pyspark.sql import functions as F

from docaudit.operators import travel
from docaudit.sources import tables


def test_uploaded_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "Scan.PDF").write_bytes(b"one")
    (tmp_path / "a" / "bare").write_bytes(b"two")
    got = {r["file_name"]: r for r in tables.read_files(spark, str(tmp_path / "a")).collect()}
    digest = hashlib.sha256(b"one").hexdigest()
    assert (got["Scan.PDF"]["file_hash"], got["Scan.PDF"]["file_type"], got["Scan.PDF"]["file_size_bytes"]) == (digest, "PDF", 3)
    assert got["Scan.PDF"]["stored_name"] == f"inv_{digest}.pdf" and got["bare"]["stored_name"].endswith(".pdf")


@pytest.mark.parametrize("name", sorted(tables.TABLES))
def test_every_declared_table_can_be_read(spark, tmp_path, name):
    spark.createDataFrame([], tables.TABLES[name]).write.parquet(str(tmp_path / name))
    assert tables.read_table(spark, str(tmp_path), name).count() == 0


def test_stored_points_fit_the_rule(spark, tmp_path):
    rows = [(1, 1, "p1", "2024-01-01 10:00:00", "北京", 39.9, 116.4), (1, 2, "p2", "2024-01-01 10:10:00", "上海", 31.2, 121.5)]
    df = spark.createDataFrame(rows, "scope_id long, point_no long, point_id string, event_time string, city_name string, latitude double, longitude double")
    points = df.withColumns({"event_time": F.col("event_time").cast("timestamp"), "source_desc": F.lit("x"), "invoice_number": F.lit("1")})
    points.write.parquet(str(tmp_path / "points"))
    assert travel.point_collisions(tables.read_table(spark, str(tmp_path), "points")).count() == 1
