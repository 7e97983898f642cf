"""Intermediate tables that cut lineage, kept in the folder the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """Shared scratch folder: below ``spark.checkpoint.dir`` where set, else below the warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", ""
    )
    configured = configured or spark.conf.get("spark.sql.warehouse.dir")
    return f"{configured.rstrip('/')}/quietwire/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch folder; nothing is created yet."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def pin(df: DataFrame, name: str = "pinned", **options: str) -> DataFrame:
    """Write ``df`` once and read it back; ``options`` are the Parquet writer's.

    The result survives lost executors, is columnar (later readers prune columns), and freezes
    whatever is not repeatable, such as a partition number.
    """
    path = new_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unpin(df: DataFrame) -> None:
    """Remove a table of :func:`pin` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
