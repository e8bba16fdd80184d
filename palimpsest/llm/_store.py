"""Tables that cut lineage, in the folder which the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` as a Parquet table in the shared folder; lost executors don't lose it."""
    spark = df.sparkSession
    path = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Takes tables of ``written`` from the disk, once nothing reads them any more, and lets Spark do so
    with shuffle files that nothing refers to."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        jvm.System.gc()


def released(spark: SparkSession) -> None:
    """Lets Spark take shuffle files that nothing refers to from the disk."""
    spark.sparkContext._jvm.System.gc()
