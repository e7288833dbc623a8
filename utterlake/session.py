"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("utterlake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, which the cluster names in spark.checkpoint.dir.

    Only where that is unset, as in local tests, a temporary folder of this application stands in.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        sc = spark.sparkContext
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = sc.applicationId
        if app not in _OWN_DIRS:
            _OWN_DIRS[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        path = _OWN_DIRS[app]
    return path.rstrip("/")


_USED: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _USED.append(path)
    return path


def bucketed(df: DataFrame, buckets: int, keys: list[str], label: str) -> DataFrame:
    """Write a frame as a scratch table bucketed by its keys, so that joins on them don't move it. The frame over its files stays; the
    table's name leaves the catalog at once."""
    spark = df.sparkSession
    path, name = scratch(spark, label), f"{label}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("compression", "zstd").option("path", path)
    writer.bucketBy(buckets, *keys).saveAsTable(name)
    table = spark.table(name)
    # a table with a path of its own leaves its files where they are
    spark.sql(f"DROP TABLE {name}")
    return table


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch folders whose readers are done."""
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def used_scratch() -> list[str]:
    """Scratch folders handed out so far, in order."""
    return list(_USED)


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back."""
    path = scratch(df.sparkSession, label)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
