"""Written tables between the stages of a plan, in the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Where it is unset a local session gets a folder of its own, as in tests; on a cluster that is an error."""
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"{KEY} has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="fathom-")
        spark.conf.set(KEY, found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read again: later stages neither recompute it nor depend on an executor."""
    path = f"{folder(df.sparkSession)}/fathom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes the tables written so far; results that read them must have been consumed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder(spark)}/fathom")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
