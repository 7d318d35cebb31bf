"""Monitored columns: the values of both sides, and whether they are as they should be."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import strip

#: Types of monitored columns.
TYPES = {1: "废弃字段", 2: "功能未实施", 3: "无法对比", 4: "数据治理"}


def load_monitor_fields(rows: DataFrame) -> DataFrame:
    """``nickname, col_seq, field_name, field_meaning, field_type`` from text cells, the first row of equal ones.

    Types are numbers or their words, 0 if neither; rows without a name or with a column below 1 are left out.
    """
    word = strip(F.col("field_type"))
    kind = F.coalesce(F.when(word.try_cast("int").between(0, 4), word.try_cast("int")), *[F.when(word == w, F.lit(t)) for t, w in TYPES.items()], F.lit(0))
    rows = rows.select("row_no", strip(F.col("nickname")).alias("nickname"), F.trim("col_seq").try_cast("int").alias("col_seq"), "field_name", "field_meaning", kind.alias("field_type"))
    good = rows.where((F.col("nickname") != "") & (F.col("col_seq") >= 1))
    n = F.row_number().over(Window.partitionBy(F.lower("nickname"), "col_seq").orderBy("row_no"))
    return good.withColumn("__n", n).where("__n = 1").drop("__n", "row_no")


def monitor_values(data: DataFrame, fields: DataFrame, cap: int = 1000) -> DataFrame:
    """``pair_id, col, values, truncated``: distinct stripped values of columns, in the order of their first appearance.

    ``fields`` has ``pair_id, col``.  A missing column counts as empty.  At most ``cap`` values are listed, and each task gives at most
    one more of each column to the shuffle.
    """
    value = strip(F.coalesce(F.get("cols", F.col("col")), F.lit("")))
    rows = data.join(fields.select("pair_id", "col").distinct(), "pair_id").select("pair_id", "col", "seq", value.alias("value"))
    parts = rows.mapInArrow(first_places(cap + 1), rows.schema)
    first = parts.groupBy("pair_id", "col", "value").agg(F.min("seq").alias("first"))
    rank = F.row_number().over(Window.partitionBy("pair_id", "col").orderBy("first", "value"))
    top = first.withColumn("rank", rank).where(F.col("rank") <= cap + 1)
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= cap, F.struct("rank", "value")))), lambda x: x["value"])
    return top.groupBy("pair_id", "col").agg(listed.alias("values"), (F.max("rank") > cap).alias("truncated"))


def first_places(k: int):
    """A task's part of the first ``k`` distinct values of each column: ``pair_id, col, seq, value`` with each value's smallest place.

    What is among the first k of all is among the first k of its task, so a task gives no more of each column.  Values beyond
    are dropped on the way: one that comes again later has k others before it still.
    """
    import heapq

    least = lambda own: heapq.nsmallest(k, own.items(), key=lambda x: (x[1], x[0].encode()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, dict[str, int]] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            # the smallest place of each value of the batch, found by Arrow
            t = pa.Table.from_batches([batch]).group_by(["pair_id", "col", "value"]).aggregate([("seq", "min")]).to_pydict()
            for pair, col, value, seq in zip(t["pair_id"], t["col"], t["value"], t["seq_min"], strict=True):
                own = held.setdefault((pair, col), {})
                if seq < own.get(value, seq + 1):
                    own[value] = seq
                    if len(own) > 4 * k:
                        held[pair, col] = dict(least(own))
        rows = [(*key, seq, value) for key, own in held.items() for value, seq in least(own)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return work


def monitor_verdict(fields: DataFrame, values_a: DataFrame, values_b: DataFrame) -> DataFrame:
    """``fields`` (``pair_id, col, field_type``) with both sides' values, ``matched`` and its text.

    Types 1, 4 and 0 want B's values among A's, type 2 the same values, type 3 is not monitored.  A side without
    data has no values; a pair that failed leaves it open (``monitor_coverage``).
    """
    side = lambda v, x: v.select("pair_id", "col", F.col("values").alias(f"values_{x}"), F.col("truncated").alias(f"truncated_{x}"))
    out = fields.join(side(values_a, "a"), ["pair_id", "col"], "left").join(side(values_b, "b"), ["pair_id", "col"], "left")
    a, b = (F.coalesce(x, F.array().cast("array<string>")) for x in ("values_a", "values_b"))
    inside = F.size(F.array_except(b, a)) == 0
    same = inside & (F.size(F.array_except(a, b)) == 0)
    matched = F.when(F.col("field_type") != 3, F.when(F.col("field_type") == 2, same).otherwise(inside))
    out = out.withColumn("matched", matched)
    text = (
        F.when(F.col("field_type") == 3, "不监控").when(F.col("matched").isNull(), "—")
        .when(F.col("field_type") == 2, F.when(F.col("matched"), "新旧线一致").otherwise("新旧线不一致"))
        .otherwise(F.when(F.col("matched"), "新线输出正常").otherwise("新线不为旧线子集"))
    )
    return out.withColumn("verdict", text)


def monitor_coverage(pairs: DataFrame, fields: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Every monitored column of every pair, also of pairs that failed or can't be monitored."""
    wanted = pairs.select("pair_id", F.lower("nickname").alias("__nick"), "state").join(fields.select(F.lower("nickname").alias("__nick"), (F.col("col_seq") - 1).alias("col"), "field_type"), "__nick")
    return wanted.drop("__nick").join(verdicts.select("pair_id", "col", "matched", "verdict"), ["pair_id", "col"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("—")))


# tasks get this module's functions themselves, so workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
