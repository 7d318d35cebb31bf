"""Names met with very many patterns, by an index of the patterns' literal parts.

A pattern's literal runs are cut into grams, long runs into long ones; it is filed under the one of them that the fewest names have.
Names come with all their grams, so an equi-join on grams finds for each name the patterns that can fit, and only these are tried.
Patterns without a literal are filed under the names' length or, if they have a star, under what all names have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import glob_pattern
from ..sources.settle import settle

GRAM = 4
#: Long grams, so that what names and patterns have in common by chance doesn't grow with the number of both.
LONG = (8, 16, 32)
#: Names with one gram that one task tries.
CROWD = 50_000


def _grams_of_name(name: Column, sizes: list[int]) -> Column:
    """All pieces of a name of the given sizes, what stands for its length, and what all names have."""
    own = [F.when(F.length(name) >= s, F.transform(F.sequence(F.lit(1), F.length(name) - (s - 1)), lambda i: F.substring(name, i, F.lit(s)))) for s in sizes if s]  # noqa: B023
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(x, none) for x in own], F.array(F.lit(""), F.concat(F.lit("\x00"), F.length(name).cast("string")))))


def _grams_of_pattern(pattern: Column, size: int) -> Column:
    """Pieces that any name has that fits: grams of the literal runs, whole runs that are shorter."""
    plain = F.regexp_replace(pattern, r"#[A-Za-z0-9_]+", "*")
    runs = F.filter(F.split(plain, r"[*?]+"), lambda r: r != "")
    cut_by = lambda r, n: F.transform(F.sequence(F.lit(1), F.length(r) - (n - 1)), lambda i: F.substring(r, i, F.lit(n)))

    def grams(r: Column) -> Column:
        out = F.when(F.length(r) <= size, F.array(r))
        long = [n for n in LONG if n > size]
        for n in reversed(long):
            out = out.when(F.length(r) >= n, cut_by(r, n))
        return out.otherwise(cut_by(r, size))

    cut = F.flatten(F.transform(runs, grams))
    # short grams are tried only if there is nothing long: names are cut by all sizes that any pattern has
    longest = F.array_max(F.transform(cut, F.length))
    best = F.array_distinct(F.filter(cut, lambda g: F.length(g) >= F.when(longest > size, longest).otherwise(F.least(longest, F.lit(3)))))
    without = F.when(F.contains(plain, F.lit("*")), F.lit("")).otherwise(F.concat(F.lit("\x00"), F.length(plain).cast("string")))
    return F.when(F.size(cut) > 0, best).otherwise(F.array(without))


def fitting(names: DataFrame, patterns: DataFrame, name: str, pattern: str, size: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """All rows of ``names`` with all rows of ``patterns`` whose pattern fits, whatever the case: no column of both has the same name.

    Work is in proportion to the names' grams and to the pairs that share a pattern's rarest gram.  Grams are told apart by their hash:
    two with the same one cost tries, and change nothing.  Names that share a gram are cut into parts of about ``crowd``.  Names and
    patterns may both be many, so neither is sent to all tasks, whatever Spark thinks of their size.
    """
    low = F.col("__low")
    rows = settle(patterns.withColumn("__low", F.lower(pattern)).where("__low is not null").withColumn("__id", F.monotonically_increasing_id()))
    cut = rows.select("__id", F.explode(_grams_of_pattern(low, size)).alias("text"))
    cut = settle(cut.select("__id", F.xxhash64("text").alias("gram"), F.when(~F.startswith("text", F.lit("\x00")), F.length("text")).alias("size")))
    sizes = sorted(r["size"] for r in cut.where("size is not null").select("size").distinct().collect())  # a few numbers
    own = F.explode(F.transform(_grams_of_name(F.lower("__name"), sizes), lambda g: F.xxhash64(g)))
    grams = names.select(F.col(name).alias("__name")).distinct().select("__name", own.alias("gram"))
    grams = settle(grams.join(cut.select("gram").distinct().hint("merge"), "gram", "left_semi"))
    common = grams.groupBy("gram").agg(F.count("*").alias("n"))
    filed = cut.join(common.hint("merge"), "gram").groupBy("__id").agg(F.min_by(F.struct("gram", "n"), F.struct("n", "gram")).alias("x"), F.count("*").alias("have"))
    # a gram that no name has rules its pattern out
    every = cut.groupBy("__id").agg(F.count("*").alias("all"))
    filed = filed.join(every.hint("merge"), "__id").where(F.col("have") == F.col("all")).select("__id", "x.gram", F.ceil(F.col("x.n") / crowd).cast("int").alias("parts"))
    filed = settle(filed.join(rows.select("__id", glob_pattern(low).alias("__regex")).hint("merge"), "__id"))
    # at most one in ``crowd`` of all grams
    crowded = filed.where("parts > 1").select("gram", "parts").distinct()
    left = grams.join(F.broadcast(crowded), "gram", "left").withColumn("part", F.pmod(F.xxhash64("__name"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    right = filed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    # a pattern is filed once and a name has a gram once, so no pair comes twice
    found = left.join(right.hint("merge"), ["gram", "part"]).where(F.regexp_like(F.lower("__name"), F.col("__regex"))).select("__name", "__id")
    return names.join(found.hint("merge"), F.col(name) == F.col("__name")).join(rows.drop("__low").hint("merge"), "__id").drop("__id", "__name")
