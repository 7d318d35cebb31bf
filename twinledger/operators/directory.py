"""Two directories compared in one job, each pair of files by its own rule.

Rules are data: keys, columns that don't count, delimiter, trailer mark, incremental conditions and dynamic columns are columns of
the pair's row, and every record's line meets its pair's row once.  All pairs are scanned, filtered, keyed and joined together, by
pair and key, so a job has as many tasks as its data need, however the files are sized.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import strip
from ..sources.scan import scan_delimited
from ..sources.settle import settle
from . import summary
from .compare import by_sub_fields, keyed_compare, trailer_compare
from .pairing import pair_files

RULE = ("keys", "omit", "ignore", "delim", "trailer", "incremental")


@dataclass
class Compared:
    """What a job gives: result rows (data and trailer), one summary row a pair, the pairs with their rules, files that found
    no partner or rule, and the registry of virtual columns."""

    results: DataFrame
    summary: DataFrame
    pairs: DataFrame
    registry: DataFrame | None


def plan_pairs(files_a: DataFrame, files_b: DataFrame, rules: DataFrame, conditions: DataFrame | None = None) -> DataFrame:
    """``pair_id`` (the file's name) and its rule, for the names on both sides that a rule's pattern fits.

    ``rules`` is what ``effective_rules`` gives, perhaps scoped; of several rules that fit, the first in their file's order counts.
    ``conditions`` has ``nickname, conds``: comma lists, one for each incremental column of the rule.
    """
    order = [c for c in ("file_order", "line_no") if c in rules.columns]
    both = pair_files(files_a, files_b, rules.where("error is null"))
    rest = [c for c in both.columns if c not in ("name", "path_a", "path_b")]
    best = both.groupBy("name").agg(F.min_by(F.struct("path_a", "path_b", *rest), F.struct(*order, "nickname", "glob")).alias("x")).select(F.col("name").alias("pair_id"), "x.*")
    none = F.array().cast("array<string>")
    if conditions is None:
        return best.withColumn("conds", none)
    return best.join(conditions.select("nickname", F.col("conds").alias("__conds")), "nickname", "left").withColumn("conds", F.coalesce("__conds", none)).drop("__conds")


def _asked(fields: Column, conds: Column) -> Column:
    """The values asked for in each incremental column; blank lists ask for nothing."""
    asked = F.transform(F.slice(conds, F.lit(1), F.size(fields)), lambda c, i: F.struct(F.get(fields, i).alias("col"), F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip), lambda v: v != "").alias("values")))
    return F.filter(asked, lambda x: F.size(x["values"]) > 0)


def _wanted(cols: Column, asked: Column) -> Column:
    """Whether a record has one of the values asked for in each column."""
    return F.when(F.size(asked) == 0, True).otherwise(F.forall(asked, lambda x: F.array_contains(x["values"], F.coalesce(F.get(cols, x["col"]), F.lit("")))))


def compare_directories(lines_a: DataFrame, lines_b: DataFrame, pairs: DataFrame, dynamic: DataFrame | None = None, items: DataFrame | None = None) -> Compared:
    """All pairs of ``plan_pairs`` compared at once.

    Lines have ``pair_id`` (the file's name), ``seq`` and ``value``; they are read several times, so what is costly to make should be settled.  ``dynamic`` has ``pair_id, col, label, dyn_name`` of columns with
    sub-fields, ``items`` their names.  Summaries have ``before_* / after_*``, the records before and after the incremental
    filter, and ``incremental``, its label where the pair has one.
    """
    about = pairs.select("pair_id", *RULE, "conds")
    if dynamic is not None:
        found = dynamic.groupBy("pair_id").agg(F.array_sort(F.collect_set("col")).alias("dynamic"))
        about = about.join(found, "pair_id", "left").withColumn("dynamic", F.array_except(F.coalesce("dynamic", F.array().cast("array<int>")), F.array_union("omit", "ignore")))
    else:
        about = about.withColumn("dynamic", F.array().cast("array<int>"))
    # what a rule says is worked out once a pair, not for each of its records
    about = about.withColumn("skip", F.array_union(F.array_union("omit", "ignore"), "dynamic")).withColumn("asked", _asked(F.col("incremental"), F.col("conds")))
    about = settle(about)
    rule = F.broadcast(about.select("pair_id", "keys", "skip", "delim", "trailer", "asked"))

    def side(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        rows = lines.select("pair_id", "seq", "value").join(rule, "pair_id")  # a rule a pair goes to all tasks, so a large file is many tasks'
        data, trailer, stats = scan_delimited(rows, F.col("delim"), F.col("trailer"), keep=("keys", "skip", "asked"))
        keep = _wanted(F.col("cols"), F.col("asked"))
        counts = data.groupBy("pair_id").agg(F.count("*").alias("before"), F.count_if(keep).alias("after"))
        return data.where(keep), trailer, stats, counts

    (a, ta, sa, na), (b, tb, sb, nb) = side(lines_a), side(lines_b)
    keys = F.col("keys")
    rows = keyed_compare(a, b, keys, F.col("skip"))
    registry = None
    if dynamic is not None:
        given = about.select("pair_id", F.col("dynamic").alias("__own"))
        rows, registry = by_sub_fields(rows.join(F.broadcast(given), "pair_id"), F.col("__own"), dynamic, items)
    rows = settle(rows.unionByName(trailer_compare(ta, tb), allowMissingColumns=True))
    kept = lambda s, n: s.join(n, "pair_id", "left").withColumn("data_rows", F.coalesce("after", F.lit(0))).drop("before", "after")
    counted = summary.compare_summary(rows, kept(sa, na), kept(sb, nb), summary.malformed(a, keys), summary.malformed(b, keys))
    for x, n in (("a", na), ("b", nb)):
        counted = counted.join(n.select("pair_id", F.col("before").alias(f"before_{x}"), F.col("after").alias(f"after_{x}")), "pair_id", "left")
    counted = counted.fillna(0, ["before_a", "after_a", "before_b", "after_b"])
    asks = about.select("pair_id", F.exists("conds", lambda c: F.coalesce(strip(c), F.lit("")) != "").alias("__asks"))
    label = F.when(F.col("__asks"), F.when((F.col("after_a") == 0) & (F.col("after_b") == 0), "增量-空文本").otherwise("增量"))
    return Compared(rows, counted.join(asks, "pair_id").withColumn("incremental", label).drop("__asks"), pairs, registry)
