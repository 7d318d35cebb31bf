"""Comparison rules as tables: read from text, made effective, scoped and compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import strip

#: The names that may begin a token of a rule line.
TOKENS = ("KEYSEQ", "OMITSEQ", "IGNORESEQ", "DELIM", "ENCA", "ENCB", "SRCA", "SRCB", "TRAILER", "REPLACE", "COLS", "MTIME", "PRISEQ", "ADDMOD")
_REPLACE = "map<string,array<array<string>>>"


def _numbers(text: Column, sep: str) -> Column:
    """Column numbers from 1 as places from 0, in the order written; one null among them marks a bad one."""
    parts = F.filter(F.transform(F.split(text, sep, -1), strip), lambda x: x != "")
    n = F.transform(parts, lambda x: x.try_cast("int"))
    return F.array_distinct(F.transform(n, lambda x: F.when(x >= 1, x - 1)))


# The delimiter and the trailer's mark of a rule that names none.
DELIM, TRAILER = " | ", "|||||"


def rules_from_lines(lines: DataFrame, delim: str = DELIM, trailer: str = TRAILER) -> DataFrame:
    """Rules of text lines ``value``; other columns pass through.

    A line is ``NICK:GLOB`` and tokens ``:NAME=value``; a colon begins a token only before a known name.  Blank lines and
    comments (``#``) are left out, a leading ``=>`` goes.  Of a token given twice the last counts.  ``error``
    says what is wrong with a line; the other columns of such a line are not to be used.
    """
    text = strip(F.regexp_replace(strip(F.col("value")), "^=>", ""))
    rows = lines.withColumn("__text", text).where((F.col("__text") != "") & ~F.startswith("__text", F.lit("#")))
    rows = rows.withColumn("__pieces", F.split("__text", f":(?=(?:{'|'.join(TOKENS)})=)", -1))
    head = F.split(F.get("__pieces", F.lit(0)), ":", -1)
    tokens = F.transform(
        F.filter(F.slice("__pieces", 2, F.greatest(F.size("__pieces") - 1, F.lit(0))), lambda p: F.contains(p, F.lit("="))),
        lambda p: F.struct(F.upper(strip(F.substring_index(p, "=", 1))).alias("k"), F.substring(p, F.instr(p, "=") + 1, F.length(p)).alias("v")),
    )
    rows = rows.withColumns({"__head": head, "__tokens": tokens})
    raw = lambda k: F.try_element_at(F.filter("__tokens", lambda t: t["k"] == k), F.lit(-1))["v"]
    value = lambda k: F.nullif(strip(raw(k)), F.lit(""))
    seq = lambda k: F.coalesce(F.array_sort(_numbers(raw(k), "/")), F.array().cast("array<int>"))
    bad = lambda c: F.exists(c, lambda x: x.isNull())
    addmod = _numbers(raw("ADDMOD"), ",")
    pri = strip(raw("PRISEQ")).try_cast("int")
    error = (
        F.when(F.size("__head") < 2, "no name and pattern")
        .when(bad(seq("KEYSEQ")) | bad(seq("OMITSEQ")) | bad(seq("IGNORESEQ")), "bad column number")
        .when(raw("PRISEQ").isNotNull() & ~F.coalesce(pri.between(1, 5), F.lit(False)), "bad priority")
        .when(raw("ADDMOD").isNotNull() & (bad(addmod) | (F.size(addmod) == 0)), "bad incremental columns")
    )
    json = lambda k, schema: F.from_json(F.try_to_binary(value(k), F.lit("base64")).cast("string"), schema)
    return rows.select(
        *[F.col(f"`{c}`") for c in lines.columns if c != "value"],
        strip(F.get("__head", F.lit(0))).alias("nickname"), strip(F.get("__head", F.lit(1))).alias("glob"),
        seq("KEYSEQ").alias("keys"), seq("OMITSEQ").alias("omit"), seq("IGNORESEQ").alias("ignore"),
        F.coalesce(F.nullif(raw("DELIM"), F.lit("")), F.lit(delim)).alias("delim"),
        F.coalesce(value("ENCA"), F.lit("auto")).alias("encoding_a"), F.coalesce(value("ENCB"), F.lit("auto")).alias("encoding_b"),
        F.coalesce(value("SRCA"), F.lit("A")).alias("source_a"), F.coalesce(value("SRCB"), F.lit("B")).alias("source_b"),
        F.coalesce(value("TRAILER"), F.lit(trailer)).alias("trailer"), json("REPLACE", _REPLACE).alias("replace"), json("COLS", "array<string>").alias("names"),
        F.coalesce(pri, F.lit(5)).alias("priority"), F.coalesce(addmod, F.array().cast("array<int>")).alias("incremental"), error.alias("error"),
    )


def effective_rules(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rule that counts for each name and pattern, and the repeats.

    ``rules`` also has ``file``, ``file_order`` and ``line_no``; the first in that order counts.  The second result is ``nickname,
    glob, files`` of pairs that occur more than once.  Rules with an error are left out of both.
    """
    good = rules.where("error is null")
    n = F.row_number().over(Window.partitionBy("nickname", "glob").orderBy("file_order", "line_no"))
    repeats = good.groupBy("nickname", "glob").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("file")), ",").alias("files")).where("n > 1")
    return good.withColumn("__n", n).where("__n = 1").drop("__n"), repeats


def scope_rules(rules: DataFrame, groups: DataFrame, name: str) -> DataFrame:
    """Rules whose name is a member of group ``name``, whatever the case; ``groups`` has ``group_name, members``."""
    members = groups.where(F.col("group_name") == name).select(F.explode("members").alias("__m")).select(F.lower("__m").alias("__member"))
    return rules.join(members, F.lower("nickname") == F.col("__member"), "left_semi")


def load_compare_groups(groups: DataFrame) -> DataFrame:
    """``group_name, members`` from text cells: members are cut at the usual marks, the first of equal ones stays, and of
    groups with one name the last row (by ``row_no``) replaces the others."""
    cell = F.array_distinct(F.filter(F.transform(F.split("members", r"[、,，;；|/]"), strip), lambda x: x != ""))
    return groups.groupBy(strip(F.col("group_name")).alias("group_name")).agg(F.max_by(cell, "row_no").alias("members"))


def rule_baseline_diff(base: DataFrame, current: DataFrame) -> DataFrame:
    """``nickname, status`` from ``nickname, line`` of a baseline and of what is there now."""
    both = base.select("nickname", F.col("line").alias("b")).join(current.select("nickname", F.col("line").alias("c")), "nickname", "full")
    status = F.when(F.col("b").isNull(), "新增").when(F.col("c").isNull(), "缺失").when(F.col("b") == F.col("c"), "一致").otherwise("已修改")
    return both.select("nickname", status.alias("status"))


def group_members_missing(groups: DataFrame, rules: DataFrame) -> DataFrame:
    """``group_name, member`` for which there is no rule."""
    members = groups.select("group_name", F.explode("members").alias("member"))
    return members.join(rules.select(F.lower("nickname").alias("__nick")).distinct(), F.lower("member") == F.col("__nick"), "left_anti")
