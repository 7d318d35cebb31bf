"""Running values over ordered records that may be far too many for one task.

Records of a group are cut into blocks of their order.  Windows run inside blocks; what a block starts from comes from
one row for each block before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scan import number_lines
from ..sources.settle import settle

BLOCK = 65_536


def _starts(df: DataFrame, by: list[str], value: Column, fold) -> DataFrame:
    ahead = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy(*by, "__block").agg(value.alias("__v"))
    return blocks.select(*by, "__block", fold(F.col("__v")).over(ahead).alias("__start"))


def running_sum(df: DataFrame, by: list[str], seq: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """``df`` with the sum of ``value`` over the records of its group up to each one."""
    df = settle(df.withColumns({"__block": F.floor(F.col(seq) / block), "__x": value.cast("long")}))
    inside = Window.partitionBy(*by, "__block").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("__own", F.sum("__x").over(inside)).join(_starts(df, by, F.sum("__x"), F.sum), [*by, "__block"])
    return out.withColumn(name, F.col("__own") + F.coalesce("__start", F.lit(0))).drop("__block", "__x", "__own", "__start")


def last_before(df: DataFrame, by: list[str], seq: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """``df`` with the last ``value`` that isn't null among the records of its group before each one."""
    df = settle(df.withColumns({"__block": F.floor(F.col(seq) / block), "__x": value}))
    inside = Window.partitionBy(*by, "__block").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    starts = _starts(df, by, F.max_by("__x", F.when(F.col("__x").isNotNull(), F.col(seq))), lambda c: F.last(c, ignorenulls=True))
    out = df.withColumn("__own", F.last("__x", ignorenulls=True).over(inside)).join(starts, [*by, "__block"])
    return out.withColumn(name, F.coalesce("__own", "__start")).drop("__block", "__x", "__own", "__start")


def nth_occurrence(df: DataFrame, by: list[str], seq: str, name: str = "nth", block: int = BLOCK) -> DataFrame:
    """``df`` with the place of each record, from 0, among those with the same ``by``, none of them null."""
    return number_lines(df.withColumn("__block", F.floor(F.col(seq) / block)), by, "__block", seq, name).drop("__block")


def ordered_print(pos: Column, value: Column) -> Column:
    """An aggregate: the fingerprint of ordered lines, the sums of two hashes of place and line.  Tasks add up their parts before
    they meet; two different texts have the same one by a chance of 2^-128."""
    mark = lambda salt: F.sum(F.xxhash64(F.lit(salt), pos, value).cast("decimal(38,0)"))  # noqa: E731  (64-bit sums would overflow)
    return F.struct(mark(1).alias("x"), mark(2).alias("y"))
