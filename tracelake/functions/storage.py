"""Reading tables, and writing intermediates to the folder that the driver and the executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a new local folder on a local master; on a cluster no folder is shared, an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-tracelake-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tracelake/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: cuts the lineage, survives lost executors, and is computed once."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tracelake_path = path
    return out


@contextmanager
def joins_by_rows(spark: SparkSession):
    """While it lasts, tables are broadcast by the bytes of their rows, counted as they are shuffled, and not by the size of their files: of
    narrow rows, files hold a fortieth to a three hundredth, and the driver would have to hold the rest."""
    by_files, by_rows = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {name: spark.conf.get(name, None) for name in (by_files, by_rows)}
    spark.conf.set(by_rows, before[by_rows] or before[by_files] or "10MB")
    spark.conf.set(by_files, "-1")
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def remove(*tables: DataFrame) -> None:
    """Deletes written tables that no result still reads."""
    for df in tables:
        spark, path = df.sparkSession, df._tracelake_path
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
