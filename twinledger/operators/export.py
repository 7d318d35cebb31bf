"""Result rows as tables ready to be written, and the CSV dialect they are written in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import display_key, excel_safe, is_blank, status_text
from ..sources.settle import settle
from .cells import Cells, registry_of
from .monitor import TYPES

PART = 20_000
BOM = "﻿"


def export_full_csv(results: DataFrame, names: list[str] | None = None, src_a: str = "A", src_b: str = "B") -> DataFrame:
    """``pair_id, seq, line, key, status, diff, values``: a line for a record, two (A's, then B's) for one that differs.

    ``values`` has as many columns as the widest record.  Rows of a dynamic comparison have ``virtual`` besides: the values of
    all virtual columns of their pair, in the order of their numbers.  ``full_csv_columns`` turns both into columns of their own.
    """
    cells = Cells(results, names)
    some = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    both = lambda a, b: F.when(is_blank(F.coalesce(a, F.lit(""))), F.coalesce(b, F.lit(""))).otherwise(a)
    merged = F.zip_with(some(F.col("a_cols")), some(F.col("b_cols")), both)
    merged = F.when(F.col("status") == "equal", F.col("a_cols")).otherwise(merged)
    shown = ["pair_id", "seq", display_key(F.col("key")).alias("key"), cells.summary(F.col("diff_cols")).alias("diff")]
    if cells.dynamic:
        # one row a pair
        every = registry_of(results).groupBy("pair_id").agg(F.array_sort(F.collect_list("idx")).alias("__idx"))
        results = results.join(F.broadcast(every), "pair_id", "left").withColumn("__at", F.map_from_entries(F.transform("dyn", lambda d: F.struct(d["idx"], F.struct(d["a"].alias("a"), d["b"].alias("b"))))))
        virtual = lambda one: F.transform(some(F.col("__idx").cast("array<string>")), lambda i: F.coalesce(one(F.try_element_at("__at", i.cast("int"))), F.lit("")))
        extra = {"one": virtual(lambda v: both(v["a"], v["b"])), "a": virtual(lambda v: v["a"]), "b": virtual(lambda v: v["b"])}
    else:
        extra = {}
    line = lambda n, status, values, x: F.struct(F.lit(n).alias("line"), status.alias("status"), values.alias("values"), *([extra[x].alias("virtual")] if extra else []))
    one = F.array(line(0, status_text(F.col("status"), src_a, src_b), merged, "one"))
    two = F.array(line(0, F.lit(f"有差异·{src_a}"), F.col("a_cols"), "a"), line(1, F.lit(f"有差异·{src_b}"), F.col("b_cols"), "b"))
    rows = results.select(*shown, F.explode(F.when(F.col("status") == "diff", two).otherwise(one)).alias("x"))
    safe = [F.transform(f"x.{c}", excel_safe).alias(c) for c in ("values", "virtual")[: 1 + cells.dynamic]]
    return rows.select("pair_id", "seq", "x.line", "key", "x.status", "diff", *safe)


def full_csv_columns(full: DataFrame, width: int, names: list[str] | None = None, virtual: list[str] | None = None) -> DataFrame:
    """The lines with their Chinese headers: values as ``width`` columns ``NAME(n)`` or ``栏位n``, then the virtual columns by the
    full names in ``virtual`` (a pair's ``registry_of``, in the order of the numbers)."""
    names = names or []
    head = [f"{names[i]}({i + 1})" if i < len(names) and names[i].strip() else f"栏位{i + 1}" for i in range(width)]
    at = lambda c, i, h: F.coalesce(F.get(c, F.lit(i)), F.lit("")).alias(h)
    return full.select(
        F.col("key").alias("键值"), F.col("status").alias("状态"), F.col("diff").alias("差异栏位"), *[at("values", i, h) for i, h in enumerate(head)], *[at("virtual", i, h) for i, h in enumerate(virtual or [])]
    )


def _primary(side: str) -> Column:
    key, first = display_key(F.col("key")), F.get(f"{side}_cols", F.lit(0))
    return F.when(~is_blank(F.coalesce(key, F.lit(""))), key).otherwise(F.coalesce(first, F.lit("")))


def export_diff_records(results: DataFrame, monitor: DataFrame | None = None, src_a: str = "A", src_b: str = "B") -> DataFrame:
    """``pair_id, key, status, detail``: one line for each data record that isn't equal.

    Details name each differing column with both values, monitored ones by their type; ``monitor`` has ``pair_id, col,
    field_type``.  Records of one side show their key.
    """
    rows = results.where("section <> 'trailer' and status <> 'equal'")
    prefix = F.lit("[栏位不一致")
    if monitor is not None:
        kinds = monitor.where(F.col("field_type").between(1, 4)).groupBy("pair_id").agg(F.map_from_entries(F.collect_set(F.struct("col", "field_type"))).alias("__kinds"))
        rows = rows.join(F.broadcast(kinds), "pair_id", "left")
        words = F.create_map(*[x for t, w in TYPES.items() for x in (F.lit(t), F.lit(f"[{t}-{w}"))])
        prefix = lambda i: F.coalesce(F.try_element_at(words, F.try_element_at("__kinds", i)), F.lit("[栏位不一致"))
    cells = Cells(rows)
    cell = lambda i: F.concat(prefix(i) if monitor is not None else prefix, F.lit(" @"), cells.number(i), F.lit("] A:'"), cells.value("a", i), F.lit("' B:'"), cells.value("b", i), F.lit("'"))
    detail = (
        F.when(F.col("status") == "diff", F.array_join(F.transform("diff_cols", cell), "\n"))
        .when(F.col("status") == "unmatched_a", F.concat(F.lit("[仅A存在] A:'"), _primary("a"), F.lit("' B:''")))
        .otherwise(F.concat(F.lit("[仅B存在] A:'' B:'"), _primary("b"), F.lit("'")))
    )
    key = F.when(F.col("key") != "", display_key(F.col("key"))).otherwise(F.when(F.col("status") == "unmatched_a", _primary("a")).otherwise(_primary("b")))
    return rows.select("pair_id", "seq", key.alias("key"), status_text(F.col("status"), src_a, src_b).alias("status"), detail.alias("detail"))


def export_diff_fields(results: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``pair_id, seq, key, no, label, name, a, b``: a line for each differing column.

    ``no`` counts from 1, ``label`` is what is shown: that number, or the short label of a virtual column.
    """
    cells, i = Cells(results, names), F.col("i")
    rows = results.where("status = 'diff'").withColumn("i", F.explode("diff_cols"))
    return rows.select("pair_id", "seq", display_key(F.col("key")).alias("key"), (i + 1).alias("no"), cells.number(i).alias("label"), cells.name(i).alias("name"), *[excel_safe(cells.value(x, i)).alias(x) for x in "ab"])


# Dates in file names, the variable part of a pattern, and the columns of the case table.
FILE_DATE = r"(?<![0-9])((?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01]))(?![0-9])"
TRAILER_DATE = "^((?:19|20)[0-9]{6})"
NAMED = "#[A-Za-z0-9_]*[A-Za-z0-9]"
CASE_COLUMNS = [
    "采集日期", "批次", "轮次", "银行号", "表类型", "表名", "文件名", "栏位索引", "错误类型", "存在问题",
    "分析人", "分析说明", "分析团队", "问题结论大类", "问题结论小类", "修改方案", "问题状态", "备注", "修改时间", "主键id",
]


def file_date(name: Column) -> Column:
    """The last run of eight digits in a file name that looks like a date; days aren't held against the month's length."""
    return F.try_element_at(F.regexp_extract_all(name, F.lit(FILE_DATE), F.lit(1)), F.lit(-1))


def wildcard(glob: Column) -> Column:
    """The variable part of a pattern: ``#NAME`` without underscores at its end, else its stars."""
    tag, stars = F.regexp_extract(glob, NAMED, 0), F.regexp_extract(glob, r"\*+", 0)
    return F.when(tag != "", tag).otherwise(stars)


def extension(name: Column, glob: Column) -> Column:
    """What stands behind the last dot of a file's name, else of its pattern."""
    part = lambda c: F.nullif(F.trim(F.regexp_extract(c, r"\.([^./\\]+)$", 1)), F.lit(""))
    return F.coalesce(part(name), part(glob), F.lit(""))


def export_cases(results: DataFrame, pairs: DataFrame) -> DataFrame:
    """A case for each differing column of each data record that isn't equal; column 0 stands for a record of one side,
    whose content is its whole line.

    ``pairs`` has ``pair_id, batch, round, nickname, glob, file_a, file_b, team``, and perhaps ``type`` and ``delim`` (else " | ").  The
    date comes from A's name, else B's, else from the trailer's DataStartDate.  ``column`` is ``column_no`` as shown, a virtual column's label.
    """
    rows = results.where("section = 'data' and status <> 'equal'")
    cells, i = Cells(rows), F.col("i")
    rows = rows.withColumn("i", F.explode(F.when(F.col("status") == "diff", F.col("diff_cols")).otherwise(F.array(F.lit(-1)))))
    said = results.where("section = 'trailer' and key = 'DataStartDate'")
    said = said.groupBy("pair_id").agg(F.max(F.coalesce(*[F.nullif(F.regexp_extract(F.trim(F.replace(F.get(c, F.lit(0)), F.lit('"'), F.lit(""))), TRAILER_DATE, 1), F.lit("")) for c in ("a_cols", "b_cols")])).alias("trailer_date"))
    given = lambda c, other: F.col(c) if c in pairs.columns else F.lit(other)
    about = pairs.join(said, "pair_id", "left").select(
        "pair_id", "batch", "round", "nickname", "team", F.coalesce(file_date(F.col("file_a")), file_date(F.col("file_b")), "trailer_date", F.lit("")).alias("date"),
        wildcard(F.col("glob")).alias("wildcard"), extension(F.col("file_a"), F.col("glob")).alias("extension"), given("type", "").alias("type"), given("delim", " | ").alias("delim"),
    )
    line = lambda x: F.concat(F.lit(f"{x.upper()}:'"), F.coalesce(F.expr(f"array_join({x}_cols, delim)"), F.lit("")), F.lit("'"))
    text = F.when(F.col("i") >= 0, F.concat(F.lit("A:'"), cells.value("a", i), F.lit("' B:'"), cells.value("b", i), F.lit("'"))).when(F.col("status") == "unmatched_a", line("a")).otherwise(line("b"))
    kind = F.when(F.col("status") == "diff", "栏位不一致").when(F.col("status") == "unmatched_a", "仅A存在").otherwise("仅B存在")
    found = rows.join(F.broadcast(about), "pair_id").select("*", display_key(F.col("key")).alias("shown"), kind.alias("kind"), (i + 1).alias("column_no"), F.when(i < 0, "0").otherwise(cells.number(i)).alias("column"), text.alias("content"))
    return found.select("pair_id", "seq", F.col("shown").alias("key"), "kind", "column_no", "column", "content", "batch", "round", "nickname", "team", "date", "wildcard", "extension", "type")


def case_table(cases: DataFrame) -> DataFrame:
    """Cases under the 20 headers of the collection table; what analysts fill in is empty."""
    filled = dict(zip(CASE_COLUMNS, ("date", "batch", "round", "wildcard", "type", "nickname", "extension", "column", "content"), strict=False)) | {"分析团队": "team"}
    return cases.select(*[(F.coalesce(F.col(filled[c]).cast("string"), F.lit("")) if c in filled else F.lit("")).alias(c) for c in CASE_COLUMNS])


def export_parts(rows: DataFrame, *order: str, size: int = PART, begins: Column | None = None) -> DataFrame:
    """``rows`` with ``part``: a new one every ``size`` records of a pair, in order.

    Every row is a record, or those where ``begins`` holds begin one and the rows behind it belong to it.  Places are counted in
    ranges: each range of rows counts its own, and starts where the ranges before it end.
    """
    # the ranges are written once, so that both uses see the same
    one = F.lit(1) if begins is None else begins.cast("int")
    cut = settle(rows.withColumn("__one", one).repartitionByRange("pair_id", *order).withColumn("__part", F.spark_partition_id()))
    counts = cut.groupBy("pair_id", "__part").agg(F.sum("__one").alias("__n"))
    ahead = Window.partitionBy("pair_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("pair_id", "__part", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__start"))
    upto = Window.partitionBy("pair_id", "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    place = F.sum("__one").over(upto) - 1 + F.col("__start")
    return cut.join(starts, ["pair_id", "__part"]).withColumn("part", F.floor(place / size).cast("int")).drop("__part", "__start", "__one")


def write_csv(rows: DataFrame, path: str, header: list[str]) -> None:
    """A table in the dialect of the exports: byte order mark, CRLF, doubled quotes, empty cells empty."""
    named = rows.toDF(*[BOM + header[0], *header[1:]])
    (
        named.write.option("header", True).option("lineSep", "\r\n").option("quote", '"').option("escape", '"').option("emptyValue", "").option("nullValue", "")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def csv_line(*cells: Column) -> Column:
    """A line of the dialect for ``write.text``, for cells that hold line feeds of their own."""
    safe = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    return F.concat_ws(",", *map(safe, cells))


def export_monitor(verdicts: DataFrame) -> DataFrame:
    """The monitor table: values of both sides as one cell each."""
    def cell(x: str) -> Column:
        shown = F.array_join(F.transform(f"values_{x}", lambda v: F.when(v == "", "（空）").otherwise(excel_safe(v))), "、")
        shown = F.when(F.coalesce(F.size(f"values_{x}"), F.lit(0)) <= 0, "（无数据行）").otherwise(shown)
        shown = F.concat(shown, F.when(F.col(f"truncated_{x}"), "…（超出 1000 个已截断）").otherwise(""))
        return F.when(F.col("field_type") == 3, "（不监控：无法对比，仅报表展示）").otherwise(shown)

    return verdicts.select("pair_id", "col", "field_type", cell("a").alias("values_a"), cell("b").alias("values_b"), "verdict")
