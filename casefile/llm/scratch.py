"""Shared working tables.

Intermediate results are cut from their lineage by writing them as Parquet under the folder that the
session names in ``spark.checkpoint.dir``; all executors see that folder, so a lost executor loses nothing.
Where the setting is empty a local session gets a temporary folder of this process; a cluster has to name one.

Operators delete what they wrote when they end, but for the tables that their result still reads. Those go with the
workspace around them: ``with Workspace(): operator(...).write...`` leaves nothing behind.
"""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar, Token

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_local: list[str] = []
#: The innermost workspace of this thread or task.
_current: ContextVar[Workspace | None] = ContextVar("workspace", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder as a URI without a trailing slash."""
    found = spark.conf.get(SETTING, "") or spark.sparkContext.getConf().get(SETTING, "")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"working tables need a folder that all executors share: set {SETTING}")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="casefile-"))
        found = f"file://{_local[0]}"
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; the workspace around, if any, deletes what is written there."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (around := _current.get()) is not None:
        around.paths[path] = spark
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and host of the file system that Spark would use for it."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back; its lineage ends at the files."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    if (around := _current.get()) is not None:
        around.tables.append((table, path))
    return table


class Workspace:
    """``with Workspace() as w``: what is written within goes when it ends, but for what ``w.keep`` was given.

    What is kept, tables or paths, must be all that later plans read. It belongs to the workspace around this one, if any.
    """

    def __init__(self) -> None:
        self.paths: dict[str, SparkSession] = {}
        self.tables: list[tuple[DataFrame, str]] = []
        self.kept: set[str] = set()
        self.before: Token | None = None

    def __enter__(self) -> Workspace:
        self.before = _current.set(self)
        return self

    def keep(self, what: DataFrame | str) -> DataFrame | str:
        self.kept.update([what] if isinstance(what, str) else [path for table, path in self.tables if table is what])
        return what

    def __exit__(self, *failed: object) -> None:
        _current.reset(self.before)
        around = _current.get()
        for path, spark in self.paths.items():
            if path in self.kept and not failed[0]:
                if around is not None:
                    around.paths[path] = spark
            else:
                delete(spark, path)
        if around is not None:
            around.tables.extend((table, path) for table, path in self.tables if path in self.kept)
