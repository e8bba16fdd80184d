"""Tables in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared


def kept(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written once and read back: what it took to make it is neither lost nor done again."""
    path = f"{shared(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Lets Spark take shuffle files that nothing refers to from the disk."""
    spark.sparkContext._jvm.System.gc()
