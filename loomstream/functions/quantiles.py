"""Exact quantiles of groups of any size without holding a group's values in one buffer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstream.session import materialise


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], *, accuracy: int = 10_000, small: int = 100_000) -> DataFrame:
    """keys (none: one row), `n`, and a double for each name in probs: the quantile of the group's values that are not
    null, interpolated between neighbours; null without values (and no row, with keys).

    A sketch of bounded size brackets each quantile between two values that are 8 / accuracy of the rows apart.  What
    lies below a bracket is only counted; the values inside are counted by value, and the two neighbours are read off
    their running count.  Groups of up to `small` rows are one bracket.  A sketch depends on the order in which its
    parts meet, so it is taken once and kept: what is counted below a bracket and inside must mean the same bracket.
    """
    names, p = list(probs), list(probs.values())
    margin = 4 / accuracy
    at = [max(0.0, x - margin) for x in p] + [min(1.0, x + margin) for x in p]
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    sketch = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("_v", at, accuracy).alias("_b"))
    big = F.col("n") > small
    low, high = ([F.when(big, F.col("_b")[i + j * len(p)]).alias(f"_{side}{i}") for i in range(len(p))] for j, side in enumerate(("low", "high")))
    sketch = materialise(sketch.select(*keys, "n", *low, *high))
    own = rows.join(sketch, list(keys)) if keys else rows.crossJoin(F.broadcast(sketch))
    below = own.groupBy(*keys).agg(F.first("n").alias("n"), *(F.count_if(F.col("_v") < F.col(f"_low{i}")).alias(f"_below{i}") for i in range(len(p))))
    inside = [F.coalesce(F.col("_v").between(F.col(f"_low{i}"), F.col(f"_high{i}")), F.lit(True)) for i in range(len(p))]
    brackets = F.filter(F.array(*(F.when(test, F.lit(i)) for i, test in enumerate(inside))), lambda i: i.isNotNull())
    counted = own.select(*keys, "_v", brackets.alias("_of")).where(F.size("_of") > 0).groupBy(*keys, "_v", "_of").agg(F.count("*").alias("_c"))
    counted = counted.select(*keys, "_v", F.explode("_of").alias("_i"), "_c")
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_i").orderBy("_v"))
    counted = counted.withColumn("_upto", upto)
    joined = counted.join(below, list(keys)) if keys else counted.crossJoin(F.broadcast(below))
    found = []
    for i, x in enumerate(p):
        place = F.lit(float(x)) * (F.col("n") - 1)
        end = F.col(f"_below{i}") + F.col("_upto")

        def neighbour(rank, i=i, end=end):
            return F.max(F.when((F.col("_i") == i) & (rank < end) & (rank >= end - F.col("_c")), F.col("_v")))

        first, second = neighbour(F.floor(place)), neighbour(F.ceil(place))
        found.append((first + (second - first) * F.max(place - F.floor(place))).alias(names[i]))
    return joined.groupBy(*keys).agg(F.max("n").alias("n"), *found)
