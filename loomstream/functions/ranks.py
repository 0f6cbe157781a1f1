"""Global ranks without moving all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstream.session import materialise


def with_rank(df: DataFrame, order: str, rank: str, *, within: str | None = None, partitions: int | None = None) -> DataFrame:
    """df with the 1-based rank of each row by ascending order (a column of df), ties in any order, and `n`, the number
    of rows; of the rows with the same value of the column `within`, if it is given.  Rows are dealt by ranges and
    ranked inside; only one count a range (and value of within) meets in one task."""
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    group = [within] if within else []
    ranged = materialise(df.repartitionByRange(parts, *group, F.col(order).asc_nulls_first()).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range", *group).agg(F.count("*").alias("_count"))
    whole = Window.partitionBy(*group)
    running = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", *group, F.coalesce(F.sum("_count").over(running), F.lit(0)).alias("_before"), F.sum("_count").over(whole).alias("n"))
    inside = F.row_number().over(Window.partitionBy("_range", *group).orderBy(F.col(order).asc_nulls_first()))
    offsets = offsets.withColumnsRenamed({c: f"_of{c}" for c in ("_range", *group)})
    match = F.col("_range") == F.col("_of_range")
    for c in group:
        match = match & F.col(c).eqNullSafe(F.col(f"_of{c}"))
    ranked = ranged.withColumn("_within", inside).join(F.broadcast(offsets) if not group else offsets, match)
    return ranked.withColumn(rank, (F.col("_before") + F.col("_within")).cast("long")).drop("_range", "_within", "_before", *(f"_of{c}" for c in ("_range", *group)))


def ntile_of(rank: Column, n: Column, buckets: int) -> Column:
    """The bucket that NTILE gives a rank: the first n mod buckets ones hold a row more."""
    base, extra = F.floor(n / buckets), n % buckets
    long = extra * (base + 1)
    return F.when(rank <= long, F.floor((rank - 1) / (base + 1)) + 1).otherwise(extra + F.floor(F.try_divide(rank - 1 - long, base)) + 1).cast("long")
