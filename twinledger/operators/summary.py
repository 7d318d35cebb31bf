"""Counts and checks over records and result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import key_of
from ..sources.settle import settle


def compare_summary(results: DataFrame, stats_a: DataFrame, stats_b: DataFrame, malformed_a: DataFrame, malformed_b: DataFrame) -> DataFrame:
    """One row for each pair: records by status, malformed ones, data and trailer rows and totals of both sides."""
    data = results.where("section = 'data'").groupBy("pair_id").agg(
        F.count_if(F.col("status") == "equal").alias("equal"), F.count_if(F.col("status") == "diff").alias("diff"),
        F.count_if(F.col("status") == "unmatched_a").alias("only_a"), F.count_if(F.col("status") == "unmatched_b").alias("only_b"),
    )
    side = lambda s, m, x: s.join(m, "pair_id", "left").select(
        "pair_id", F.coalesce("malformed", F.lit(0)).cast("long").alias(f"malformed_{x}"), F.col("data_rows").alias(f"data_rows_{x}"),
        F.col("trailer_rows").alias(f"trailer_rows_{x}"), (F.col("data_rows") + F.col("trailer_rows")).alias(f"total_{x}"),
    )
    out = side(stats_a, malformed_a, "a").join(side(stats_b, malformed_b, "b"), "pair_id", "full").join(data, "pair_id", "left")
    return out.fillna(0)


def malformed(data: DataFrame, keys: list[int] | Column | None) -> DataFrame:
    """``pair_id, malformed``: records too short for the key."""
    return data.groupBy("pair_id").agg(F.count_if(key_of(F.col("cols"), keys).isNull()).alias("malformed"))


def diff_column_freq(results: DataFrame) -> DataFrame:
    """``pair_id, col, n``: records that differ in each column."""
    return results.where("section = 'data' and status = 'diff'").select("pair_id", F.explode("diff_cols").alias("col")).groupBy("pair_id", "col").agg(F.count("*").alias("n"))


def diff_concentration(results: DataFrame, most: int = 30) -> DataFrame:
    """The columns that differ most: ``pair_id, rank, col, n, percent`` of the differing records."""
    freq = diff_column_freq(results)
    rows = results.where("section = 'data' and status = 'diff'").groupBy("pair_id").agg(F.count("*").alias("rows"))
    rank = F.row_number().over(Window.partitionBy("pair_id").orderBy(F.desc("n"), "col"))
    out = freq.withColumn("rank", rank).where(F.col("rank") <= most).join(rows, "pair_id")
    return out.select("pair_id", "rank", "col", "n", (F.col("n") * 100.0 / F.col("rows")).alias("percent"))


def duplicate_keys(data: DataFrame, keys: list[int] | Column | None) -> DataFrame:
    """``pair_id, duplicates``: records beyond the first of their key."""
    n = data.select("pair_id", key_of(F.col("cols"), keys).alias("key")).where("key is not null").groupBy("pair_id", "key").agg(F.count("*").alias("n"))
    return n.groupBy("pair_id").agg(F.sum(F.col("n") - 1).alias("duplicates"))


def duplicate_key_top(data: DataFrame, keys: list[int] | Column | None, k: int = 10, prefix: int = 65_536) -> DataFrame:
    """``pair_id, rank, key, repeats``: the first ``k`` keys to repeat, and their records beyond the first.

    A key that repeats early in a file is found in the file's beginning: places up to ``prefix`` are looked at, then 16 times as
    many of those pairs that have fewer than ``k`` such keys there, and so on, so that all records are looked at only of a pair in which
    hardly any key repeats.  The result is the same for any ``prefix``.  How often the keys found repeat is counted over all records.
    """
    rows = data.select("pair_id", "seq", key_of(F.col("cols"), keys).alias("key")).where("key is not null")
    open_ = settle(rows.groupBy("pair_id").agg(F.max("seq").alias("last")))
    found = None
    while True:
        part = rows.where(F.col("seq") < prefix).join(open_.select("pair_id"), "pair_id", "left_semi")
        n = part.groupBy("pair_id", "key").agg(F.count("*").alias("n"), F.min("seq").alias("first")).where("n > 1")
        again = part.join(n, ["pair_id", "key"]).where(F.col("seq") > F.col("first")).groupBy("pair_id", "key").agg(F.min("seq").alias("second"))
        rank = F.row_number().over(Window.partitionBy("pair_id").orderBy("second"))
        top = settle(again.withColumn("rank", rank).where(F.col("rank") <= k))
        seen = open_.join(top.groupBy("pair_id").agg(F.count("*").alias("n")), "pair_id", "left")
        seen = settle(seen.select("pair_id", "last", ((F.coalesce("n", F.lit(0)) >= k) | (F.col("last") < prefix)).alias("done")))
        some = top.join(seen.where("done").select("pair_id"), "pair_id", "left_semi")
        found = some if found is None else found.unionByName(some)
        open_ = seen.where("not done").select("pair_id", "last")
        if open_.isEmpty():
            break
        prefix *= 16
    # at most k keys of each pair meet all records
    counts = rows.join(found.select("pair_id", "key"), ["pair_id", "key"], "left_semi").groupBy("pair_id", "key").agg((F.count("*") - 1).alias("repeats"))
    return found.join(counts, ["pair_id", "key"]).select("pair_id", "rank", "key", "repeats")


def duplicate_key_samples(a: DataFrame, b: DataFrame, keys: list[int] | Column | None, k: int = 20) -> DataFrame:
    """The first ``k`` distinct keys that repeat, A's before B's: ``pair_id, rank, key``."""
    own = duplicate_key_top(a, keys, k).withColumn("side", F.lit(0)).unionByName(duplicate_key_top(b, keys, k).withColumn("side", F.lit(1)))
    first = own.groupBy("pair_id", "key").agg(F.min(F.struct("side", "rank")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("pair_id").orderBy("at"))
    return first.withColumn("rank", rank).where(F.col("rank") <= k).select("pair_id", "rank", "key")


def zone_counts(results: DataFrame) -> DataFrame:
    """Rows by zone: trailer rows are one zone, the others go by status."""
    zone = F.when(F.col("section") == "trailer", "trailer").when(F.col("status").isin("unmatched_a", "unmatched_b"), "unmatched").otherwise(F.col("status"))
    return results.groupBy("pair_id", zone.alias("zone")).agg(F.count("*").alias("n"))


# ---- deviation grades ----


def content_deviation(diff: Column, equal: Column) -> Column:
    """Share of the matched records that differ; null if none match."""
    return F.when(diff + equal > 0, diff / (diff + equal))


def count_deviation(a: Column, b: Column) -> Column:
    return F.abs(b - a) / F.greatest(F.lit(1), a)


def grade(ratio: Column) -> Column:
    return F.when(ratio.isNull(), F.lit(None)).when(ratio >= 0.5, "严重问题").when(ratio >= 0.2, "务必关注").when(ratio >= 0.1, "微量偏移").otherwise("正常")


def volume_grade(a: Column, b: Column) -> Column:
    """Grade of two numbers of records by whole per mille of their difference."""
    mille = F.when(a + b > 0, F.floor(F.abs(a - b) * 2000 / (a + b))).otherwise(0)
    return F.when(mille >= 500, "严重问题").when(mille >= 200, "差异明显").when(mille >= 100, "保持关注").otherwise("正常")


def deviation_report(summary: DataFrame) -> DataFrame:
    """Deviations of each pair, the largest first, pairs without any last; numbers of records are totals with trailers."""
    content = content_deviation(F.col("diff"), F.col("equal"))
    count = count_deviation(F.col("total_a"), F.col("total_b"))
    out = summary.select(
        "pair_id", "equal", "diff", F.round(content, 4).alias("content_deviation"), F.round(count, 4).alias("count_deviation"), grade(content).alias("content_grade"), grade(count).alias("count_grade"),
        volume_grade(F.col("total_a"), F.col("total_b")).alias("volume_grade"),
    )
    worst = F.when(F.col("content_deviation").isNotNull(), F.greatest("content_deviation", "count_deviation"))
    return out.orderBy(worst.desc_nulls_last(), F.desc("diff"), "pair_id")


def batch_overview(pairs: DataFrame, summary: DataFrame) -> DataFrame:
    """One row over all pairs of a batch.

    ``pairs`` has ``batch_id, pair_id, state`` (done, failed, no_rule, missing, queued), ``started`` and ``ended``.
    """
    state = lambda s: F.count_if(F.col("state") == s)
    out = pairs.join(summary, "pair_id", "left").groupBy("batch_id").agg(
        F.count("*").alias("pairs"), state("done").alias("done"), state("failed").alias("failed"), state("no_rule").alias("no_rule"), state("missing").alias("missing"),
        F.count_if(F.coalesce(F.col("diff") + F.col("only_a") + F.col("only_b"), F.lit(0)) > 0).alias("diff_files"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("equal", "diff", "only_a", "only_b", "data_rows_a", "data_rows_b")],
        F.min("started").alias("started"), F.max("ended").alias("ended"),
    )
    whole = F.when(F.col("failed") > 0, "failed").when(F.col("done") + F.col("no_rule") + F.col("missing") == F.col("pairs"), "done").otherwise("running")
    return out.withColumn("state", whole)


def batch_detail(summary: DataFrame, freq: DataFrame) -> DataFrame:
    """Counts and grade of each pair, with its differing columns (from 1) as a list."""
    cols = freq.groupBy("pair_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("col")), lambda c: (c + 1).cast("string")), ",").alias("columns"))
    return summary.join(cols, "pair_id", "left").select(
        "pair_id", "equal", "diff", "only_a", "only_b", "total_a", "total_b", volume_grade(F.col("total_a"), F.col("total_b")).alias("volume_grade"), F.coalesce("columns", F.lit("")).alias("columns")
    )
