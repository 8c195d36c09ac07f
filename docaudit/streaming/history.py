"""What a stream job remembers of earlier batches: cut into cells by key, read by cell, merged as it grows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from docaudit.schemas import names
from docaudit.session import new_path

#: Cells of an index by key; a batch reads the cells of its own keys only.
CELLS = 64
#: Segments of one size that are merged into one of the next size.
FAN_IN = 4


def hashed(*keys: str, cells: int = CELLS) -> str:
    """SQL text of the cell of a key."""
    return f"cast(pmod(xxhash64({', '.join(keys)}), {cells}) as int)"


@dataclass(frozen=True)
class Index:
    """A table of remembered rows: its columns, and the SQL text of the cell (an int, never null) that a row lies in."""

    name: str
    schema: str
    cell: str


class History:
    """The remembered rows of a job as one of its batches sees them: those of all earlier batches, whole.

    A batch writes one segment per index. ``fan_in`` segments of a size are merged into one of the next size, like the digits
    of a counter, so the number of a batch alone tells which segments hold the batches before it: at most
    ``fan_in - 1`` per size, and every row is written again once per size. There is no list to keep, and a batch that is
    repeated after a failure reads what it read before and overwrites what it wrote. Merged segments go when the next
    batch begins, since only then is the one that merged them done for good.
    """

    def __init__(self, spark: SparkSession, folder: str, batch_id: int, fan_in: int = FAN_IN):
        self.spark, self.batch_id, self.fan_in = spark, batch_id, fan_in
        self.folder = f"{folder.rstrip('/')}/history"

    def segments(self, index: Index, until: int | None = None) -> list[str]:
        """Paths of the segments that hold the batches before ``until`` (this batch), in order."""
        until = self.batch_id if until is None else until
        size, first, found = 1, 0, []
        while size * self.fan_in <= until:
            size *= self.fan_in
        while size:
            while first + size <= until:
                found.append(self._segment(index, first, size))
                first += size
            size //= self.fan_in
        return found

    def paths(self, index: Index, wanted: Callable[[int], bool] = lambda cell: True) -> list[str]:
        """Folders of the wanted cells in the segments before this batch."""
        return self._cells(self.segments(index), wanted)

    def rows(self, index: Index, wanted: Callable[[int], bool] = lambda cell: True) -> DataFrame:
        """Remembered rows of the wanted cells, with the batch that brought them."""
        return self._read(index, self.paths(index, wanted))

    def of_keys(self, index: Index, keys: DataFrame) -> DataFrame:
        """Remembered rows of an index by key that share all columns of ``keys`` (null equals null).

        ``keys`` is read twice, so store it first. At most one number per cell comes to the driver.
        """
        types = StructType.fromDDL(index.schema)
        asked = keys.select(*[F.col(c).cast(types[c].dataType).alias(c) for c in keys.columns]).distinct()
        cells = {r[0] for r in asked.select(F.expr(index.cell)).distinct().collect()}
        same = F.lit(True)
        for c in keys.columns:
            same = same & F.col(f"h.{c}").eqNullSafe(F.col(f"k.{c}"))
        return self.rows(index, cells.__contains__).alias("h").join(asked.alias("k"), same, "left_semi")

    def remember(self, index: Index, rows: DataFrame, keep: Column | None = None) -> None:
        """Write this batch's rows, once per index and batch, and merge the segments that are due.

        ``keep`` tells which remembered rows later batches can still need; the others are left out when segments merge.
        """
        fresh = rows.select(*names(index.schema)).withColumn("batch", F.lit(self.batch_id).cast("bigint"))
        self._write(index, fresh, self._segment(index, self.batch_id, 1))
        done, size = self.batch_id + 1, self.fan_in
        while done % size == 0:
            part = size // self.fan_in
            parts = [self._segment(index, first, part) for first in range(done - size, done, part)]
            merged = self._read(index, self._cells(parts))
            self._write(index, merged if keep is None else merged.where(keep), self._segment(index, done - size, size))
            size *= self.fan_in

    def forget_merged(self) -> None:
        """Delete the segments that earlier batches have merged into larger ones."""
        for name in self._list(self.folder):
            index = Index(name, "", "")
            live = set(self.segments(index))
            for segment in self._list(f"{self.folder}/{name}"):
                path = f"{self.folder}/{name}/{segment}"
                if int(segment.split("-")[1]) <= self.batch_id and path not in live:
                    self._path(path)[1].delete(self._path(path)[0], True)

    def stored(self, rows: DataFrame) -> DataFrame:
        """Rows of a batch written to the shared folder and read back by the job's own session.

        A stream's batches belong to a session without adaptive execution; what reads the table has it, so joins with a
        popular key are split.
        """
        path = new_path(self.spark)
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _segment(self, index: Index, first: int, size: int) -> str:
        return f"{self.folder}/{index.name}/{first}-{first + size}"

    def _cells(self, segments: list[str], wanted: Callable[[int], bool] = lambda cell: True) -> list[str]:
        return [f"{s}/{name}" for s in segments for name in self._list(s) if name.startswith("cell=") and wanted(int(name[5:]))]

    def _read(self, index: Index, paths: list[str]) -> DataFrame:
        schema = f"{index.schema}, batch bigint"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, index: Index, rows: DataFrame, target: str) -> None:
        # Rebalancing gathers a cell into few files and splits one that holds most rows.
        (
            rows.withColumn("cell", F.expr(index.cell)).hint("rebalance", "cell").write.mode("overwrite")
            .option("partitionOverwriteMode", "static").partitionBy("cell").parquet(target)
        )

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, folder: str) -> list[str]:
        path, fs = self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []
