"""Partitioned writes that can be repeated without duplicating rows."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hidden folder of a table with a refresh under way, and the file in it that commits the refresh.
ASIDE = "_refresh"
COMMITTED = "committed.json"


def write_partitioned(df: DataFrame, path: str, column: str, mode: str = "overwrite") -> None:
    """Parquet below ``path`` with one folder per value of ``column``.

    The rebalance hint lets adaptive execution gather small partitions and split a value that
    holds most of the rows into several files.
    """
    df.hint("rebalance", column).write.partitionBy(column).mode(mode).parquet(path)


def refresh_partitions(df: DataFrame, path: str, column: str, values: Sequence) -> None:
    """Replace the partitions of ``values`` by what ``df`` holds for them, in one write job.

    Partitions outside ``values`` are untouched, a value without rows loses its old partition, and a
    second run gives the same table. The source is read once, and may be the table itself.

    The new partitions are written aside, in a hidden folder of the table; then a file lists them, which
    commits the refresh; then each is moved into its place. Stopped before the commit, a refresh
    has changed nothing; stopped after it, the next one, or ``finish_refresh``, does what is left.
    One refresh of a table at a time, on a file system that moves a folder in one step.
    """
    finish_refresh(df.sparkSession, path)
    files = _Files(df.sparkSession, path)
    wanted = df.filter(F.col(column).isin(list(values)))
    wanted.hint("rebalance", column).write.partitionBy(column).parquet(f"{path}/{ASIDE}/new")
    filled = files.folders(f"{ASIDE}/new")
    listed = {files.partition(column, value) for value in values}
    files.commit(f"{ASIDE}/{COMMITTED}", json.dumps({"filled": sorted(filled), "empty": sorted(listed - filled)}))
    finish_refresh(df.sparkSession, path)


def finish_refresh(spark: SparkSession, path: str) -> None:
    """Do what a committed refresh of a table has left to do, and clear what one without commit has written."""
    files = _Files(spark, path)
    plan = files.read(f"{ASIDE}/{COMMITTED}")
    if plan is not None:
        steps = json.loads(plan)
        for name in steps["filled"]:
            _publish(files, name)
        for name in steps["empty"]:
            files.remove(name)
        files.remove(f"{ASIDE}/{COMMITTED}")  # nothing left to do
    files.remove(ASIDE)


def _publish(files: _Files, name: str) -> None:
    """Put one new partition in its place. A partition that is no longer aside is there already."""
    if files.exists(f"{ASIDE}/new/{name}"):
        if files.exists(name):
            files.move(name, f"{ASIDE}/old/{name}")
        files.move(f"{ASIDE}/new/{name}", name)


class _Files:
    """Files and folders below a table's path, on whatever file system it lies."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.top = self.jvm.org.apache.hadoop.fs.Path(path)
        self.system = self.top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        # a partition's name may hold characters that a path would take apart
        found = self.top
        for part in name.split("/"):
            found = self.jvm.org.apache.hadoop.fs.Path(found, self.jvm.org.apache.hadoop.fs.Path(None, None, part))
        return found

    def partition(self, column: str, value) -> str:
        return self.jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(column, str(value))

    def exists(self, name: str) -> bool:
        return self.system.exists(self.at(name))

    def folders(self, name: str) -> set[str]:
        return {f.getPath().getName() for f in self.system.listStatus(self.at(name)) if f.isDirectory()}

    def move(self, name: str, to: str) -> None:
        self.system.mkdirs(self.at(to).getParent())
        if not self.system.rename(self.at(name), self.at(to)):
            raise OSError(f"cannot move {name} to {to}")

    def remove(self, name: str) -> None:
        self.system.delete(self.at(name), True)

    def commit(self, name: str, text: str) -> None:
        """Write a file that is either there as a whole or not at all."""
        out = self.system.create(self.at(f"{name}.writing"), True)
        out.write(bytearray(text, "utf-8"))
        out.close()
        self.move(f"{name}.writing", name)

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self.system.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()


def month_list(start: str | date, n: int) -> list[str]:
    """``n`` first-of-month dates from the month of ``start``, as ``yyyy-mm-dd``."""
    first = date.fromisoformat(str(start))
    months = range(first.year * 12 + first.month - 1, first.year * 12 + first.month - 1 + n)
    return [f"{m // 12:04d}-{m % 12 + 1:02d}-01" for m in months]


def month_range(start: Column, n: int) -> Column:
    """The same list as an array column, for a start date held in a table."""
    first = F.trunc(start, "MM")
    return F.sequence(first, F.add_months(first, n - 1), F.expr("interval 1 month"))


def backfill_months(
    df: DataFrame, start: str | date, n: int, path: str, date_column: str, source: str, target: str = "scaled"
) -> None:
    """Derive ``target = source * 100`` for ``n`` months and refresh their partitions."""
    months = month_list(start, n)
    months = [date.fromisoformat(m) for m in months]
    batch = df.withColumn(target, (F.col(source) * 100).try_cast("decimal(20,5)"))
    refresh_partitions(batch, path, date_column, months)
