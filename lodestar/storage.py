"""Tables of a dataset directory, and intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class NoSharedFolder(RuntimeError):
    """The session names no folder for intermediate tables."""


def shared_dir(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, below the one that spark.checkpoint.dir names.

    It is deleted when the application ends. Without that setting a session on one machine keeps them below its
    warehouse folder; a session on a cluster is refused, since no folder could be guessed that all executors share.
    """
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/lodestar-{spark.sparkContext.applicationId}"
    if path not in _MARKED:
        _MARKED.add(path)
        _file_system(spark, path).deleteOnExit(_path(spark, path))
    return path


_MARKED: set[str] = set()
#: Tables made within the open `scratch` blocks, innermost last.
_SCRATCH: list[list[str]] = []


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system Spark reads; one that is not there is no error."""
    _file_system(spark, path).delete(_path(spark, path), True)


def exists(spark: SparkSession, path: str) -> bool:
    return _file_system(spark, path).exists(_path(spark, path))


def children(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Path, size and time of change of what lies in a folder, or of the file itself; without hidden files."""
    fs = _file_system(spark, path)
    if not fs.exists(_path(spark, path)):
        return []
    found = [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(_path(spark, path))]
    return sorted(f for f in found if f[0].rpartition("/")[2][:1] not in ("_", "."))


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs = _file_system(spark, old)
    fs.mkdirs(_path(spark, new).getParent())
    if not fs.rename(_path(spark, old), _path(spark, new)):
        raise OSError(f"{old} could not be renamed to {new}")


def fresh(spark: SparkSession, what: str) -> str:
    """A path for an intermediate table that no other has."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write an intermediate result as a table in the shared folder and read it back.

    It ends the lineage at files that outlive any executor, and it is compact: columnar and compressed, where a
    checkpoint would hold serialised rows. Column names must be distinct. The table stays until the application ends, or
    the `scratch` block within which it was made.
    """
    spark = df.sparkSession
    path = fresh(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the intermediate tables made within: nothing that reads them may be run later."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            delete(spark, path)


def width(spark: SparkSession) -> int:
    """Partitions for work that is heavy per row: two per core at least, more if the session says so."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """Split a table that comes in too few partitions for heavy map work; a large table is left where it lies.

    Only a plain scan is looked at: its partitions can be counted without running anything. Rows are dealt in turn, so
    that no key or repeated text can weigh on one task; Spark sorts them first, which keeps retried tasks deterministic.
    """
    n = width(df.sparkSession)
    plan = df._jdf.queryExecution().executedPlan()
    if "AdaptiveSparkPlan" not in plan.toString() and df._jdf.queryExecution().toRdd().getNumPartitions() >= n:
        return df
    return df.repartition(n)
