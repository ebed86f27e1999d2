"""Running sums over sorted groups, however large a group is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def running_sums(df: DataFrame, by: list[str], order: list[Column], values: dict[str, Column]) -> DataFrame:
    """df with sums of exact values (whole numbers, decimals) over the rows of the same `by` up to each row.

    Rows are dealt by ranges of (by, order), so a group of any size spreads over many tasks; each
    range sums its own rows, and a table of one row a range carries sums from range to range. Nulls
    in `by` are a group. Rows equal in by and order come in any order, the same for all sums.
    """
    keys = [*[F.col(c).asc() for c in by], *order]
    dealt = materialize(df.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()), "ranges")
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    own = Window.partitionBy("__range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    part = materialize(dealt.withColumns({"__k": F.row_number().over(own), **{c: F.sum(v).over(own) for c, v in values.items()}}), "sums")
    # The last row of a range's last group has that group's sums.
    last = F.max(F.struct(group.alias("g"), "__k", *values))
    ends = part.groupBy("__range").agg(F.min(group).alias("head"), last.alias("tail"))
    # One row a range from here on.
    upto = Window.partitionBy("tail.g").orderBy("__range")
    kept = ends.withColumns({f"__{c}": F.sum(F.col(f"tail.{c}")).over(upto) for c in values})
    before = Window.orderBy("__range")
    goes_on = F.lag("tail.g").over(before).eqNullSafe(F.col("head"))
    carries = kept.select("__range", "head", *[F.coalesce(F.when(goes_on, F.lag(f"__{c}").over(before)), F.lit(0)).alias(f"__{c}") for c in values])
    joined = part.join(F.broadcast(carries), "__range")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"head.{c}")) for c in by], F.lit(True))
    out = joined.withColumns({c: F.col(c) + F.when(same, F.col(f"__{c}")).otherwise(0) for c in values})
    return out.drop("__range", "__k", "head", *[f"__{c}" for c in values])


def running(df: DataFrame, by: list[str], order: list[Column], value: Column, out: str) -> DataFrame:
    """df with one running sum of whole numbers; see running_sums()."""
    return running_sums(df, by, order, {out: value})
