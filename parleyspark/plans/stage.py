"""Cutting lineage: intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_written: dict[str, SparkSession] = {}
#: Temporary folders of local sessions, by application.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where none is set and the session is local."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="parleyspark-")
    return _local[app]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Stage:
    """A table written once and read as often as needed; ``drop`` removes its files.

    ``dictionary=False`` is for arrays of floats: building dictionaries of them costs a hundred times the write itself.
    """

    def __init__(self, df: DataFrame, compression: str = "zstd", dictionary: bool = True, measure: dict[str, Column] | None = None):
        """``measure``: aggregates of all rows, taken while they are written, for ``measured``."""
        self.spark = df.sparkSession
        seen = Observation() if measure else None
        if measure:
            df = df.observe(seen, *[c.alias(k) for k, c in measure.items()])
        self.path = f"{shared_dir(self.spark)}/parleyspark-{uuid.uuid4().hex}"
        df.write.option("compression", compression).option("parquet.enable.dictionary", str(dictionary).lower()).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        self.measured = seen.get if seen else {}
        _written[self.path] = self.spark

    def count(self) -> int:
        return self.df.count()

    def drop(self) -> None:
        if _written.pop(self.path, None) is not None:
            _delete(self.spark, self.path)


def stage(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder and read back; its files go when Python ends."""
    return Stage(df).df


@atexit.register
def release() -> None:
    """Delete the files of all tables written so far. For long-lived drivers: to be called when the results of queries have been
    stored; frames that queries returned before can't be read afterwards. Runs when Python ends."""
    for path, spark in list(_written.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended
            pass
    _written.clear()


@atexit.register
def _remove_local() -> None:
    for where in _local.values():
        shutil.rmtree(where.removeprefix("file://"), ignore_errors=True)


def spread(scan: DataFrame, key: str) -> DataFrame:
    """A scan over all cores, where it has fewer than half as many files; larger inputs stay where they are. The list of files stays in the JVM."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, key) if len(scan._jdf.inputFiles()) * 2 <= cores else scan
