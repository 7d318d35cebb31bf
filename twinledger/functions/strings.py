"""Expressions on strings and on arrays of strings."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Joins the columns of a key.
UNIT = "\x1f"
#: White space that counts as blank, with the marks that files pad with.
BLANK = r"[\s\x00\x{3000}]"


def quoted(text: str) -> str:
    """A literal as a regular expression of Java."""
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def quoted_column(text: Column) -> Column:
    """As ``quoted``, of a column of literals."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once: inside lambdas Spark works out an expression each time it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def split_columns(line: Column, delim: str | Column = " | ") -> Column:
    """Columns of a line; trailing empty ones stay.  The delimiter is a text, or a column of texts."""
    return F.split(line, quoted(delim) if isinstance(delim, str) else quoted_column(delim), -1)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text.rlike(r"(?U)[^\s]"), F.lit(False))


def unquote(text: Column) -> Column:
    """A value without the pair of double quotes around it."""
    inner = F.trim(text)
    return F.when(inner.rlike(r'(?s)^".*"$') & (F.length(inner) >= 2), F.substring(inner, F.lit(2), F.length(inner) - 2)).otherwise(text)


def column_at(cols: Column, i: int) -> Column:
    """A column's value, empty where the record is too short."""
    return F.coalesce(F.get(cols, F.lit(i)), F.lit(""))


def key_of(cols: Column, keys: list[int] | Column | None) -> Column:
    """The record's key: its key columns in column order; null if the record is too short for them.

    Without key columns the whole record is the key.  ``keys`` is a list, or a column of arrays.
    """
    if isinstance(keys, Column):
        first = F.get(keys, F.lit(0))
        one = F.when(F.size(cols) > first, F.coalesce(F.get(cols, first), F.lit("")))  # most keys: no lambda
        wanted = F.sort_array(F.array_distinct(keys))
        own = F.when(F.size(cols) > F.array_max(keys), F.array_join(F.transform(wanted, lambda k: F.coalesce(F.get(cols, k), F.lit(""))), UNIT))
        return F.when(F.size(keys) == 1, one).when(F.size(keys) > 0, own).otherwise(F.array_join(cols, UNIT))
    if not keys:
        return F.array_join(cols, UNIT)
    keys = sorted(set(keys))
    return F.when(F.size(cols) > keys[-1], F.concat_ws(UNIT, *[F.get(cols, F.lit(k)) for k in keys]))


def diff_columns(a: Column, b: Column, skip: list[int] | Column = (), missing: str | None = "") -> Column:
    """Places where two records differ, but for those in ``skip`` (a list, or a column of arrays).  What the shorter one lacks
    counts as ``missing``; with ``missing=None`` it differs from everything but another lack."""
    value = (lambda c, i: F.coalesce(F.get(c, i), F.lit(missing))) if missing is not None else F.get
    differs = lambda i: ~value(a, i).eqNullSafe(value(b, i))
    if isinstance(skip, Column):
        wanted = lambda i: differs(i) & ~F.array_contains(skip, i)
    else:
        wanted = (lambda i: differs(i) & ~i.isin(*sorted(skip))) if skip else differs
    width = F.greatest(F.size(a), F.size(b))
    none = F.array().cast("array<int>")
    return F.when(a.eqNullSafe(b), none).when(width > 0, F.filter(F.sequence(F.lit(0), width - 1), wanted)).otherwise(none)


def display_key(key: Column) -> Column:
    return F.replace(key, F.lit(UNIT), F.lit(":"))


def excel_safe(text: Column) -> Column:
    """Long digit strings as formulas, so that spreadsheets keep all digits."""
    return F.when(text.rlike("^[0-9]{16,}$"), F.concat(F.lit('="'), text, F.lit('"'))).otherwise(text)


def status_text(status: Column, src_a: str | None = None, src_b: str | None = None) -> Column:
    a, b = (x if x and x.strip() else d for x, d in ((src_a, "A"), (src_b, "B")))
    return (
        F.when(status == "equal", "完全匹配").when(status == "diff", "有差异")
        .when(status == "unmatched_a", f"仅{a}存在").when(status == "unmatched_b", f"仅{b}存在").otherwise(status)
    )


def column_name(names: Column, i: Column) -> Column:
    """The name of a column, or its number."""
    name = F.get(names, i)
    return F.when(F.coalesce(~is_blank(name), F.lit(False)), name).otherwise(F.concat(F.lit("栏位"), (i + 1).cast("string")))


def glob_regex(glob: str) -> str:
    """A file name pattern as a regular expression: stars for any run, ``?`` for one character, ``#NAME`` for any run."""
    out = []
    for part in re.findall(r"\*+|\?|#[A-Za-z0-9_]+|[^*?#]+|#", glob):
        out.append(".*" if part[0] == "*" or (part[0] == "#" and len(part) > 1) else "." if part == "?" else re.escape(part))
    return "(?is)^" + "".join(out) + "$"


def glob_pattern(glob: Column, marks: bool = True) -> Column:
    """As ``glob_regex``, of a column of patterns; without ``marks``, ``#`` stands for itself."""
    marked = F.regexp_replace(F.regexp_replace(glob, r"#[A-Za-z0-9_]+", "*") if marks else glob, r"\*+", "*")
    safe = F.regexp_replace(marked, r"([\\.\[\]{}()+^$|#-])", r"\\$1")
    return F.concat(F.lit("(?is)^"), F.regexp_replace(F.regexp_replace(safe, r"\*", ".*"), r"\?", "."), F.lit("$"))


def glob_match(name: Column, glob: Column) -> Column:
    """Whether a name fits a pattern, both columns."""
    return F.regexp_like(name, glob_pattern(glob))


def similarity(a: Column, b: Column) -> Column:
    """Mean over columns: 1 where equal or both empty, 0 where one is empty, else 1 - distance / longer length."""
    value = lambda x: F.coalesce(x, F.lit(""))
    one = lambda x, y: (
        F.when(value(x) == value(y), F.lit(1.0)).when((value(x) == "") | (value(y) == ""), F.lit(0.0))
        .otherwise(1.0 - F.levenshtein(value(x), value(y)) / F.greatest(F.length(value(x)), F.length(value(y))))
    )
    parts = F.zip_with(a, b, one)
    return F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size(parts)).otherwise(F.lit(0.0))


def similarity_bound(a: Column, b: Column) -> Column:
    """What ``similarity`` is at most, by the values' lengths alone."""
    size = lambda x: F.coalesce(F.length(x), F.lit(0))
    one = lambda x, y: F.when(size(x) == size(y), F.lit(1.0)).otherwise(1.0 - F.abs(size(x) - size(y)) / F.greatest(size(x), size(y)))
    parts = F.zip_with(a, b, one)
    return F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size(parts)).otherwise(F.lit(0.0))


def pipe_label_like(line: Column, template: Column) -> Column:
    """Equal numbers of pipes, and each part of the template that isn't empty begins the line's part."""
    mine, theirs = F.split(line, r"\|", -1), F.split(template, r"\|", -1)
    fits = F.zip_with(mine, theirs, lambda x, t: (strip(t) == "") | F.startswith(strip(x), strip(t)))
    return (F.size(mine) > 1) & (F.size(mine) == F.size(theirs)) & F.forall(fits, lambda x: x)
