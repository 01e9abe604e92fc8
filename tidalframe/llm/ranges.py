"""Ranks and running sums over whole tables, with no task that sees all rows.

Rows carry a part number that rises with their order. A window within each part is added to the
sums of the parts before it, so one task holds one part, and one group holds one row a part.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

PART = "__part"


def by_ranges(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` dealt by ranges of ``order`` and stored, with the range's number; rows of equal order share a range."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return common.stored(rows.repartitionByRange(parts, *order).withColumn(PART, F.spark_partition_id()))


def running(rows: DataFrame, amount: str | Column, order: list[Column], by: list[str] | None = None, part: str = PART, out: str = "__before") -> DataFrame:
    """Adds ``out``: the sum of ``amount`` over the rows before each one by (part, order), within equal ``by``; no null keys."""
    keys = [*(by or []), part]
    before = Window.orderBy(part) if not by else Window.partitionBy(*by).orderBy(part)
    total = F.sum("__sum").over(before.rowsBetween(Window.unboundedPreceding, -1))
    bases = rows.groupBy(*keys).agg(F.sum(amount).alias("__sum")).select(*keys, F.coalesce(total, F.lit(0)).alias("__base"))
    inner = F.sum(amount).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("__inner", F.coalesce(inner, F.lit(0))).join(bases, keys).withColumn(out, F.col("__base") + F.col("__inner")).drop("__base", "__inner")
