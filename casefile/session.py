"""Session and table access shared by every query."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "casefile", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores where it comes from fewer files than there are cores, for work that takes long per row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


#: Bytes of input files for each partition of a large exchange.
SHARE_BYTES = 4 << 20


def shares(*dfs: DataFrame) -> int:
    """Partitions for an exchange of all rows of ``dfs``: as many as their input files ask for, so a task's memory does not grow with them; 0 if the session's cores are enough."""
    context = dfs[0].sparkSession.sparkContext
    conf, size = context._jsc.hadoopConfiguration(), 0
    for file in {f for df in dfs for f in df.inputFiles()}:
        where = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(file))
        size += where.getFileSystem(conf).getFileStatus(where).getLen()
    n = -(-size // SHARE_BYTES)
    return n if n > context.defaultParallelism else 0


def dealt(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in ``n`` partitions, which are not put together again; as it is if ``n`` is 0."""
    return df.repartition(n, *keys) if n else df


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors see: below spark.checkpoint.dir, or local where the session is."""
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("files need a folder that all executors share: set spark.checkpoint.dir")
        root = f"file://{tempfile.gettempdir()}/casefile-files"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file, by the file system that Spark uses for the path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(data))
    out.close()


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Work:
    """``with Work(spark) as work``: tables written within go when it ends, but for what was given to ``keep``."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths, self.kept = spark, {}, set()

    def __enter__(self) -> Work:
        return self

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written to a work folder and read back, which ends its lineage."""
        path = work_dir(self.spark, name)
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = table
        return table

    def keep(self, table: DataFrame) -> DataFrame:
        self.kept |= {path for path, own in self.paths.items() if own is table}
        return table

    def drop(self, table: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        for path in [p for p, own in self.paths.items() if own is table]:
            delete(self.spark, path)
            del self.paths[path]

    def __exit__(self, *failed: object) -> None:
        for path in self.paths:
            if path not in self.kept or failed[0]:
                delete(self.spark, path)
