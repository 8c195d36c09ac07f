"""Session settings every job relies on."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join partition even when that costs one more exchange downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # The JVM never compiles longer methods: stages with one are run operator by operator, whose code is cut into short ones.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; parallelism and memory stay the cluster's choice."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(app: str = "docaudit", cores: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


#: Temporary folder of a local application that names none, and the tables an application has stored, by application id.
_LOCAL_FOLDERS: dict[str, str] = {}
_STORED: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names, or a temporary one in local mode.

    A cluster must name a folder that all machines share; there is no other way to run. A local application that names
    none gets one folder of its own, which goes when Python ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is not None:
        return folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="docaudit-")
        atexit.register(shutil.rmtree, _LOCAL_FOLDERS[app], ignore_errors=True)
    return _LOCAL_FOLDERS[app]


def new_path(spark: SparkSession, kind: str = "table") -> str:
    """A fresh path in the shared folder, noted for ``release``."""
    path = f"{shared_folder(spark).rstrip('/')}/docaudit/{kind}-{uuid.uuid4().hex}"
    _STORED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


#: Set while a table is stored: the shuffle files of that write go when it ends, and not when the driver next collects garbage.
_FREES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Write a result that several branches use to the shared folder and read it back.

    The table survives lost executors, cuts the lineage and keeps column pruning. It stays until ``discard`` or
    ``release``; what its computation shuffled is deleted with the write.
    """
    spark = df.sparkSession
    path, before = new_path(spark), spark.conf.get(_FREES_SHUFFLES, None)
    spark.conf.set(_FREES_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_FREES_SHUFFLES)
        else:
            spark.conf.set(_FREES_SHUFFLES, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.__dict__["_stored_at"] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` has given and nothing reads any more; other tables are left alone."""
    for table in tables:
        path, paths = table.__dict__.get("_stored_at"), _STORED.get(table.sparkSession.sparkContext.applicationId, [])
        if path in paths:
            paths.remove(path)
            _delete(table.sparkSession, path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession, since: int = 0) -> int:
    """Delete what this application has stored (from the ``since``-th path on); returns the number of paths.

    Results that still read those tables can no longer be computed: write them first.
    """
    paths = _STORED.get(spark.sparkContext.applicationId, [])
    gone = paths[since:]
    del paths[since:]
    for name in gone:
        _delete(spark, name)
    return len(gone)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at the end of the block what was stored inside it: write results inside, then nothing is left behind."""
    since = len(_STORED.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release(spark, since)
