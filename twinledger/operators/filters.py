"""Filters and routes of records, and views of result rows."""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import column_at, strip

OTHER = "其他"


def incremental_filter(data: DataFrame, fields: list[int], conds: list[str]) -> DataFrame:
    """Records whose columns have one of the values listed for them.

    One comma list for each field; a blank list asks for nothing, and if all are blank every record stays.  Trailers
    are another table, so they always stay.
    """
    for field, cond in zip(fields, conds, strict=True):
        values = [v.strip() for v in (cond or "").split(",") if v.strip()]
        if values:
            data = data.where(column_at(F.col("cols"), field).isin(*values))
    return data


def incremental_counts(before_a: DataFrame, after_a: DataFrame, before_b: DataFrame, after_b: DataFrame) -> DataFrame:
    """Records of both sides before and after the filter, and the label of the pair."""
    n = lambda d, x: d.groupBy("pair_id").agg(F.count("*").alias(x))
    out = n(before_a, "before_a").join(n(after_a, "after_a"), "pair_id", "full").join(n(before_b, "before_b"), "pair_id", "full").join(n(after_b, "after_b"), "pair_id", "full").fillna(0)
    return out.withColumn("label", F.when((F.col("after_a") == 0) & (F.col("after_b") == 0), "增量-空文本").otherwise("增量"))


def regex_replace_columns(data: DataFrame, rules: dict[int, list[tuple[str, str]]]) -> DataFrame:
    """Records with regular expressions of Java replaced in order, column by column."""
    def one(x: Column, i: Column) -> Column:
        out = x
        for col, pairs in rules.items():
            new = x
            for pattern, value in pairs:
                new = F.regexp_replace(new, pattern, value)
            out = F.when(i == col, new).otherwise(out)
        return out

    return data.withColumn("cols", F.transform("cols", one)) if rules else data


@dataclass(frozen=True)
class Cond:
    """A condition on a column (from 1): eq, contains, prefix, suffix, regex, or range with ``low~high``."""

    col: int
    op: str
    value: str


@dataclass(frozen=True)
class Rule:
    name: str
    logic: str  # all or any
    conds: tuple[Cond, ...]


def _bounds(value: str) -> tuple[Decimal | None, Decimal | None]:
    parts = value.split("~")
    try:
        low, high = (Decimal(p.strip()) if p.strip() else None for p in (parts + [""])[:2])
    except InvalidOperation:
        raise ValueError(f"a range needs numbers: {value}") from None
    if len(parts) > 2 or (low is None and high is None) or (low is not None and high is not None and low > high):
        raise ValueError(f"not a range: {value}")
    return low, high


def predicate(cond: Cond) -> Column:
    """The condition over ``cols``; a missing column is empty, and what isn't a number is in no range."""
    if cond.col < 1 or not cond.value:
        raise ValueError(f"a condition needs a column from 1 and a value: {cond}")
    x = column_at(F.col("cols"), cond.col - 1)
    if cond.op == "range":
        low, high = _bounds(cond.value)
        n = strip(x).try_cast("decimal(38,18)")
        ok = n.isNotNull()
        ok = ok if low is None else ok & (n >= F.lit(low).cast("decimal(38,18)"))
        return F.coalesce(ok if high is None else ok & (n <= F.lit(high).cast("decimal(38,18)")), F.lit(False))
    if cond.op == "regex":
        re.compile(cond.value)  # fails early on most mistakes
        return x.rlike(cond.value)
    v = F.lit(cond.value)
    return {"eq": x == v, "contains": F.contains(x, v), "prefix": F.startswith(x, v), "suffix": F.endswith(x, v)}[cond.op]


def split_route(data: DataFrame, rules: list[Rule]) -> DataFrame:
    """``data`` with ``grp``: the name of the first rule that a record meets, or 其他."""
    route = None
    for rule in rules:
        tests = [predicate(c) for c in rule.conds]
        if not tests or rule.logic not in ("all", "any"):
            raise ValueError(f"not a rule: {rule}")
        ok = tests[0]
        for t in tests[1:]:
            ok = ok & t if rule.logic == "all" else ok | t
        route = F.when(ok, rule.name) if route is None else route.when(ok, rule.name)
    return data.withColumn("grp", F.lit(OTHER) if route is None else route.otherwise(OTHER))


def split_counts(routed: DataFrame, rules: list[Rule]) -> DataFrame:
    """``pair_id, grp, n`` for every group, also those without records."""
    names = list(dict.fromkeys([*(r.name for r in rules), OTHER]))
    n = routed.groupBy("pair_id", "grp").agg(F.count("*").alias("n"))
    every = routed.select("pair_id").distinct().select("pair_id", F.explode(F.array(*map(F.lit, names))).alias("grp"))
    return every.join(n, ["pair_id", "grp"], "left").fillna(0, ["n"])


def split_files(routed: DataFrame, path: str) -> None:
    """One folder for each pair and group, lines as they were (``value``)."""
    routed.select("pair_id", "grp", "value").write.partitionBy("pair_id", "grp").text(path)


# ---- views of result rows ----


def zone_filter(results: DataFrame, zone: str) -> DataFrame:
    """all, trailer, unmatched, or a status; trailer rows are in no other zone than all and trailer."""
    if zone == "all":
        return results
    if zone == "trailer":
        return results.where("section = 'trailer'")
    statuses = ["unmatched_a", "unmatched_b"] if zone == "unmatched" else [zone]
    return results.where((F.col("section") != "trailer") & F.col("status").isin(*statuses))


def section_filter(results: DataFrame, section: str, q: str = "") -> DataFrame:
    """Rows of a section whose key contains ``q``."""
    return results.where((F.col("section") == section) & F.contains(F.coalesce("key", F.lit("")), F.lit(q)))


def search_results(results: DataFrame, q: str = "", note: str = "", notes: DataFrame | None = None) -> DataFrame:
    """Rows whose key contains ``q`` and, with ``note`` has or none, that have a note or none."""
    if q:
        results = results.where(F.contains("key", F.lit(q)))
    if note and notes is not None:
        results = results.join(notes.select("pair_id", "key").distinct(), ["pair_id", "key"], "left_semi" if note == "has" else "left_anti")
    return results


def page_results(results: DataFrame, offset: int, limit: int, *order: str) -> DataFrame:
    """A page of rows in their order."""
    return results.orderBy(*order).offset(offset).limit(limit)


def annotate_results(notes: DataFrame, updates: DataFrame) -> DataFrame:
    """Notes after updates: one for each ``pair_id, key, zone``, the last by ``at``."""
    both = notes.unionByName(updates)
    rest = [c for c in both.columns if c not in ("pair_id", "key", "zone")]
    return both.groupBy("pair_id", "key", "zone").agg(F.max_by(F.struct(*rest), "at").alias("n")).select("pair_id", "key", "zone", "n.*")


def annotate_matching(notes: DataFrame, results: DataFrame, q: str, text: str, at) -> DataFrame:
    """Notes for all rows whose key contains ``q`` and that have none yet, added to the others."""
    zone = F.when(F.col("section") == "trailer", "trailer").otherwise(F.col("status"))
    found = results.where(F.contains("key", F.lit(q))).select("pair_id", "key", zone.alias("zone")).distinct()
    new = found.join(notes, ["pair_id", "key", "zone"], "left_anti").withColumns({"note": F.lit(text), "at": F.lit(at)})
    return notes.unionByName(new)


def note_counts(notes: DataFrame) -> DataFrame:
    return notes.groupBy("pair_id", "zone").agg(F.count("*").alias("n"))
