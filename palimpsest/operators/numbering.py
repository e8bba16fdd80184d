"""Row numbers over a whole table, without one task that sees it all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import kept


def numbered(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """``df`` with its rows' numbers from 1 by ``column`` (a unique key; null last). Ranges of the column are
    numbered side by side; only the ranges' sizes reach the driver."""
    order = F.col(column).asc_nulls_last()
    parts = kept(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    before, upto = [], 0
    for part, n in sorted(tuple(r) for r in parts.groupBy("_part").count().collect()):
        before += [F.lit(part), F.lit(upto).cast("long")]
        upto += n
    first = F.element_at(F.create_map(*before), F.col("_part")) if before else F.lit(0).cast("long")
    return parts.withColumn(name, F.row_number().over(Window.partitionBy("_part").orderBy(order)) + first).drop("_part")
