"""Exact row numbers inside groups of any size, without a group in one task.

A window numbers each group in one task; a group that holds a third of all rows then
takes one task as long as a third of the job. Here the rows are range-partitioned on
(group, order), so a large group lies in several consecutive partitions; they are
numbered inside each partition and shifted by what the earlier partitions hold of the
group. At most one group reaches from a partition into the next, so the shifts are at
most one row a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chirpflow.session import written


def numbered(df: DataFrame, group: list[str], order: list[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """``df`` with ``name`` = row_number() over (partition by group order by order), as long.

    The order must tell the rows of a group apart. The range-partitioned rows are written once to
    the shared folder, so that a lost executor cannot change which partition a row is in."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *[F.col(c) for c in group], *order).withColumn("_pid", F.spark_partition_id())
    placed = written(placed, "numbered")
    here = placed.withColumn("_rn", F.row_number().over(Window.partitionBy("_pid", *group).orderBy(*order)))
    earlier = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        placed.groupBy("_pid", *group).agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_shift", F.sum("_rows").over(earlier)).where(F.col("_shift") > 0).drop("_rows")
    )
    on = [here[c].eqNullSafe(shifts[c]) for c in ("_pid", *group)]
    joined = here.join(F.broadcast(shifts), on, "left")  # at most one row a partition
    return joined.select(*[here[c] for c in df.columns], (F.coalesce("_shift", F.lit(0)) + F.col("_rn")).cast("long").alias(name))
