"""Pairing of the records of side A and side B, and what differs between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import diff_columns, key_of, once
from ..sources.settle import settle
from .cells import VIRTUAL

RESULT = ("pair_id", "key", "status", "section", "a_cols", "b_cols", "diff_cols", "seq")
TRAILER_FIELDS = ("RecNum", "SysID", "TabName", "Version", "GenTime", "CycFlag", "DataStartDate", "DataEndDate")


def _keyed(data: DataFrame, keys: list[int] | Column | None, **more: Column) -> DataFrame:
    return data.select("pair_id", "seq", "cols", key_of(F.col("cols"), keys).alias("key"), *[c.alias(n) for n, c in more.items()])


def last_per_key(data: DataFrame, keys: list[int] | Column | None) -> DataFrame:
    """``pair_id, key, cols, seq`` of the last record of each key."""
    rows = _keyed(data, keys).where("key is not null")
    return rows.groupBy("pair_id", "key").agg(F.max_by("cols", "seq").alias("cols"), F.max("seq").alias("seq"))


def keyed_compare(a: DataFrame, b: DataFrame, keys: list[int] | Column | None = None, skip: list[int] | Column = ()) -> DataFrame:
    """Result rows of two tables of records.

    Of the records of A with one key the last counts; every record of B is compared with it.  Keys of A that B
    lacks come once.  Records too short for the key are left out.  Without ``keys`` the whole record is the key.
    Columns in ``skip`` don't count as different.  Both are lists, or columns of arrays in the records' tables, so that pairs with
    rules of their own are compared together.  ``seq`` orders the rows: B's, then A's.

    Rows of B keep their own side in a left join, which Spark can split where one key is common, instead
    of a full join, which it can't.
    """
    left = last_per_key(a, keys).withColumnsRenamed({"cols": "a_cols", "seq": "a_seq"})
    by_row = {"__skip": skip} if isinstance(skip, Column) else {}
    right = _keyed(b, keys, **by_row).where("key is not null").withColumnsRenamed({"cols": "b_cols"})
    left_out = F.col("__skip") if by_row else list(skip)
    both = right.join(left, ["pair_id", "key"], "left")
    none = F.array().cast("array<int>")
    # that no record of A met is read from a_seq, so that both joins need the same columns of A and share its cut and its shuffle
    alone = F.col("a_seq").isNull()
    diff = F.when(alone, none).otherwise(diff_columns(F.col("a_cols"), F.col("b_cols"), left_out))
    met = both.withColumn("diff_cols", diff)
    status = F.when(alone, "unmatched_b").when(F.size("diff_cols") > 0, "diff").otherwise("equal")
    met = met.select("pair_id", "key", status.alias("status"), F.lit("data").alias("section"), "a_cols", "b_cols", "diff_cols", F.struct(F.lit(0).alias("part"), "seq").alias("seq"))
    # an anti join would be pushed below A's aggregate, which makes another shuffle of A
    there = right.select("pair_id", "key").distinct().withColumn("__there", F.lit(True))
    # the last term holds for all records; it asks for A's columns and place so that what only counts rows shares A's shuffle as well: keys
    # alone would be shuffled once more, and are so small that adaptive execution gives a task millions of them
    only = left.join(there, ["pair_id", "key"], "left").where("__there is null and (a_seq is not null or a_cols is null)")
    rest = only.select(
        "pair_id", "key", F.lit("unmatched_a").alias("status"), F.lit("data").alias("section"), "a_cols", F.lit(None).cast("array<string>").alias("b_cols"), none.alias("diff_cols"),
        F.struct(F.lit(1).alias("part"), F.col("a_seq").alias("seq")).alias("seq"),
    )
    return met.unionByName(rest)


def whole_row_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Result rows with the whole record as the key: no record can differ."""
    return keyed_compare(a, b, None)


def trailer_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Result rows of two trailers, by key; of equal keys the last counts, values are raw."""
    last = lambda t, x: t.groupBy("pair_id", "key").agg(F.max_by("value", "seq").alias(x))
    both = last(a, "a").join(last(b, "b"), ["pair_id", "key"], "full")
    status = F.when(F.col("a").isNull(), "unmatched_b").when(F.col("b").isNull(), "unmatched_a").when(F.col("a") == F.col("b"), "equal").otherwise("diff")
    side = lambda x: F.when(F.col(x).isNotNull(), F.array(x))
    rows = both.withColumn("status", status)
    return rows.select(
        "pair_id", "key", "status", F.lit("trailer").alias("section"), side("a").alias("a_cols"), side("b").alias("b_cols"),
        F.when(F.col("status") == "diff", F.array(F.lit(0))).otherwise(F.array().cast("array<int>")).alias("diff_cols"), F.struct(F.lit(2).alias("part"), F.lit(0).cast("long").alias("seq")).alias("seq"),
    )


def trailer_fields(a: DataFrame, b: DataFrame) -> DataFrame:
    """``pair_id, field, a, b, equal`` of the named fields that either trailer has, values without quotes."""
    last = lambda t, x: t.where(F.col("key").isin(*TRAILER_FIELDS)).groupBy("pair_id", F.col("key").alias("field")).agg(F.max_by("meta", "seq").alias(x))
    return last(a, "a").join(last(b, "b"), ["pair_id", "field"], "full").withColumn("equal", F.col("a").eqNullSafe(F.col("b")))


def recnum_check(trailer: DataFrame, stats: DataFrame) -> DataFrame:
    """``pair_id, declared, data_rows, ok``: whether RecNum is the number of records; null if it is no number."""
    said = trailer.where("key = 'RecNum'").groupBy("pair_id").agg(F.max_by("meta", "seq").alias("__raw"))
    said = said.select("pair_id", F.trim("__raw").try_cast("long").alias("declared"))
    return stats.select("pair_id", "data_rows").join(said, "pair_id", "left").withColumn("ok", F.col("declared") == F.col("data_rows"))


# ---- dynamic sub-fields ----


def sub_fields(text: Column) -> Column:
    """Sub-fields of a column as an array of (k, v) in order.

    Parts are cut at ``~~``.  A part behind a mark that begins with two letters or digits has them as its code, and
    the rest as value; a code that repeats gets ``*2`` and so on.  Other parts, and what stands before the
    first mark, are numbered ``#1``, ``#2``.  Empty parts are dropped.
    """
    parts = F.split(text, "~~", -1)
    part = lambda k, v: F.struct(k.alias("k"), v.alias("v"))
    coded = lambda s, i: F.when((i > 0) & s.rlike(r"^[\p{L}\p{Nd}]{2}"), part(F.substring(s, 1, 2), F.substring(s, F.lit(3), F.length(s)))).otherwise(part(F.lit("#"), s))
    found = F.filter(F.transform(parts, coded), lambda x: (x["k"] != "#") | (x["v"] != ""))

    def named(every: Column, x: Column, i: Column) -> Column:
        nth = F.size(F.filter(F.slice(every["k"], F.lit(1), i + 1), lambda k: k == x["k"]))
        name = once(nth, lambda n: F.when(x["k"] == "#", F.concat(F.lit("#"), n.cast("string"))).when(n == 1, x["k"]).otherwise(F.concat(x["k"], F.lit("*"), n.cast("string"))))
        return part(name, x["v"])

    def all_named(every: Column) -> Column:
        # codes that all differ are names already
        plain = (F.size(F.array_distinct(every["k"])) == F.size(every)) & ~F.array_contains(every["k"], "#")
        return F.when(plain, every).otherwise(F.transform(every, lambda x, i: named(every, x, i)))

    return F.coalesce(once(found, all_named), F.array().cast("array<struct<k:string,v:string>>"))


def expand_dynamic(data: DataFrame, col: int, items: DataFrame | None = None) -> DataFrame:
    """``pair_id, seq, pos, code, content, name``: a row for each sub-field of a column.

    ``items`` has ``item_code, item_name``; the name is that of the code without its repeat mark.
    """
    rows = data.select("pair_id", "seq", F.posexplode(sub_fields(F.coalesce(F.get("cols", F.lit(col)), F.lit("")))).alias("pos", "x"))
    rows = rows.select("pair_id", "seq", "pos", F.col("x.k").alias("code"), F.col("x.v").alias("content"))
    if items is None:
        return rows.withColumn("name", F.lit(None).cast("string"))
    base = F.regexp_replace("code", r"\*[0-9]+$", "")
    return rows.withColumn("item_code", base).join(items.select("item_code", F.col("item_name").alias("name")), "item_code", "left").drop("item_code")


def keyed_compare_dynamic(
    a: DataFrame, b: DataFrame, keys: list[int] | Column | None, dynamic: list[int], skip: list[int] = (), about: DataFrame | None = None, items: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """``keyed_compare`` with some columns compared sub-field by sub-field, whatever their order.

    Returns result rows with ``dyn``, an array of (idx, c, k, a, b, label, name), and the registry ``pair_id, c, k, idx, label,
    name`` of virtual columns, numbered in the order of their first appearance.  A sub-field that one side lacks is
    different from an empty one.  Records of one side carry their own values.

    ``about`` has ``pair_id, col, label, dyn_name``: how a dynamic column is called (else by its number from 1), and the list of its
    sub-fields' names in ``items`` (``dyn_name, item_code, item_name``).  A virtual column's label is that of its column and
    the code, without the mark of numbered ones; its name is the label with the sub-field's name behind it.
    """
    dynamic = sorted(set(dynamic) - set(skip))
    rows = keyed_compare(a, b, keys, [*skip, *dynamic])
    return by_sub_fields(rows, F.array(*map(F.lit, dynamic)).cast("array<int>"), about, items)


def by_sub_fields(rows: DataFrame, dynamic: Column, about: DataFrame | None = None, items: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Result rows that don't compare the columns in ``dynamic`` (arrays of places), with those compared by sub-fields; as
    ``keyed_compare_dynamic``."""
    rows = rows.withColumn("__dynamic", dynamic)
    # both sides' sub-fields are cut once, met by code, and written, as the registry and the rows need them
    for x in "ab":
        cut = lambda c: sub_fields(F.coalesce(F.get(F.col(f"{x}_cols"), c), F.lit("")))  # noqa: B023, E731
        rows = rows.withColumn(f"__{x}", F.transform("__dynamic", cut))

    def values(c: Column, n: Column) -> Column:
        of = lambda x, f: F.get(F.col(f"__{x}"), n)[f].alias(f"{x}{f}")
        at = lambda s, x, k: F.get(s[f"{x}v"], (F.array_position(s[f"{x}k"], k) - 1).cast("int")).alias(x)
        met = lambda s: F.transform(F.array_union(s["ak"], s["bk"]), lambda k: F.struct(c.alias("c"), k.alias("k"), at(s, "a", k), at(s, "b", k)))
        return once(F.struct(*[of(x, f) for x in "ab" for f in "kv"]), met)

    rows = settle(rows.withColumn("__vals", F.flatten(F.transform("__dynamic", values))).select(*RESULT, "__vals"))
    first = rows.select("pair_id", "seq", F.posexplode("__vals").alias("pos", "x")).groupBy("pair_id", F.col("x.c").alias("c"), F.col("x.k").alias("k")).agg(F.min(F.struct("seq", "pos")).alias("at"))
    # one row for each column and code of a pair, few by nature
    registry = first.select("pair_id", "c", "k", (F.lit(VIRTUAL) + F.row_number().over(Window.partitionBy("pair_id").orderBy("at"))).cast("int").alias("idx"))
    registry = settle(_named(registry, about, items))
    entry = F.struct(F.concat_ws(":", F.col("c").cast("string"), "k"), F.struct("idx", "label", "name"))
    named = registry.groupBy("pair_id").agg(F.map_from_entries(F.collect_list(entry)).alias("__names"))
    rows = rows.join(F.broadcast(named), "pair_id", "left")  # one row a pair: the rows stay where they are

    def told(x: Column) -> Column:
        known = F.element_at("__names", F.concat_ws(":", x["c"].cast("string"), x["k"]))
        return once(known, lambda y: F.struct(y["idx"].alias("idx"), x["c"].alias("c"), x["k"].alias("k"), x["a"].alias("a"), x["b"].alias("b"), y["label"].alias("label"), y["name"].alias("name")))

    rows = rows.withColumn("dyn", F.transform("__vals", told))
    two = F.col("status").isin("equal", "diff")
    more = F.transform(F.filter("dyn", lambda x: ~x["a"].eqNullSafe(x["b"])), lambda x: x["idx"])
    rows = rows.withColumn("diff_cols", F.when(two, F.concat("diff_cols", more)).otherwise(F.col("diff_cols")))
    status = F.when(two, F.when(F.size("diff_cols") > 0, "diff").otherwise("equal")).otherwise(F.col("status"))
    return rows.withColumn("status", status).select(*RESULT, "dyn"), registry


def _named(registry: DataFrame, about: DataFrame | None, items: DataFrame | None) -> DataFrame:
    """The registry with labels and names."""
    registry = registry.withColumn("__base", F.when(~F.startswith("k", F.lit("#")), F.regexp_replace("k", r"\*[0-9]+$", "")))
    none = F.lit(None).cast("string")
    if about is not None:
        one = about.groupBy("pair_id", F.col("col").alias("c")).agg(F.min_by("label", "label").alias("__label"), F.min_by("dyn_name", "label").alias("__dyn"))
        registry = registry.join(one, ["pair_id", "c"], "left")
    else:
        registry = registry.withColumns({"__label": none, "__dyn": none})
    if items is not None:
        one = items.groupBy(F.col("dyn_name").alias("__dyn"), F.col("item_code").alias("__base")).agg(F.min("item_name").alias("__item"))
        registry = registry.join(one, ["__dyn", "__base"], "left")
    else:
        registry = registry.withColumn("__item", none)
    parent = F.coalesce("__label", (F.col("c") + 1).cast("string"))
    label = F.concat(parent, F.lit("-"), F.regexp_replace("k", "^#", ""))
    name = F.concat("label", F.when(F.coalesce(F.trim("__item"), F.lit("")) != "", F.concat(F.lit("（"), F.col("__item"), F.lit("）"))).otherwise(""))
    return registry.withColumn("label", label).withColumn("name", name).select("pair_id", "c", "k", "idx", "label", "name")
