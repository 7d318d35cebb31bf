"""Messages cut from text by patterns, and their comparison."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import last_before, nth_occurrence, ordered_print, running_sum
from ..functions.strings import diff_columns, strip
from ..sources.settle import settle

_NONE = "array<string>"


def extract_key(value: Column, key: str) -> Column:
    """What the pattern finds in a line: its first group if it has groups; null if nothing."""
    return F.when(value.rlike(key), F.regexp_extract(value, key, 1 if re.compile(key).groups else 0))


def _in_segments(lines: DataFrame, start: str, end: str | None, unterminated: str) -> DataFrame:
    """``lines`` with ``seg_no``, whether they are in the segment (``__in``) and whether its end is missing (``__cut``)."""
    by = ["pair_id"]
    is_start = F.col("value").rlike(start)
    if not end:
        rows = running_sum(lines, by, "seq", is_start.cast("int"), "seg_no")
        return rows.withColumns({"__in": F.col("seg_no") > 0, "__cut": F.lit(False)})
    is_end = F.col("value").rlike(end)
    kind = F.when(is_start & is_end, "B").when(is_start, "S").when(is_end, "E")
    rows = last_before(lines.withColumn("__kind", kind), by, "seq", F.col("__kind"), "__prev")
    inside = F.coalesce(F.col("__prev") == "S", F.lit(False))
    again = (F.col("__kind") == "S") & inside
    opens = is_start & ~inside
    if unterminated == "eof":
        # the first start inside a segment is where the text's parsing ends
        rows = settle(rows)
        broken = rows.groupBy("pair_id").agg(F.min(F.when(again, F.col("seq"))).alias("__broken"))
        rows = rows.join(broken, "pair_id")
        sound = F.coalesce(F.col("seq") < F.col("__broken"), F.lit(True))
        opens, closes = opens & sound, ((F.col("__kind") == "B") | ((F.col("__kind") == "E") & inside)) & sound
    else:
        opens, closes = opens | again, (F.col("__kind") == "B") | ((F.col("__kind") == "E") & inside)
    rows = running_sum(rows, by, "seq", F.coalesce(opens, F.lit(False)).cast("int"), "seg_no")
    rows = settle(rows)
    stops = rows.groupBy("pair_id", "seg_no").agg(F.min(F.when(closes, F.col("seq"))).alias("__stop"))
    rows = rows.join(stops, ["pair_id", "seg_no"])
    return rows.withColumns({"__in": (F.col("seg_no") > 0) & F.coalesce(F.col("seq") <= F.col("__stop"), F.lit(True)), "__cut": F.col("__stop").isNull()})


def _loose(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """Lines before the first segment and behind the last; ``segments`` has each one's last ``seq`` as ``__end``."""
    last = segments.groupBy("pair_id").agg(F.max("__end").alias("__last"))
    loose = rows.where(~F.col("__in")).join(last, "pair_id", "left")
    head, tail = F.col("seg_no") == 0, F.col("seq") > F.col("__last")
    loose = loose.where(head | F.coalesce(tail, F.lit(False)))
    return loose.select("pair_id", F.when(head, "head").otherwise("tail").alias("kind"), F.when(head, F.col("seq")).otherwise(F.col("seq") - F.col("__last") - 1).alias("pos"), "value")


def _key_of(key: str | None) -> Column:
    return F.min_by(extract_key(F.col("value"), key), F.when(F.col("value").rlike(key), F.col("seq"))) if key else F.lit(None).cast("string")


def scan_segments(lines: DataFrame, start: str, end: str | None = None, key: str | None = None, unterminated: str = "eof") -> tuple[DataFrame, DataFrame]:
    """Segments and loose lines of text ``pair_id, seq, value`` (``seq`` from 0), each segment with its lines in one row.

    Segments: ``pair_id, seg_no, key, lines, start_line, cut`` (``start_line`` from 1).  Without ``end`` a segment runs to the next
    start.  With it, a segment ends at its first end line, which may be its start line; lines between segments are
    dropped.  A start inside a segment means that its end is missing: with ``unterminated='eof'`` the segment then takes all the
    rest of the text, with ``'next_start'`` it stops there; ``cut`` tells.  Loose lines: ``pair_id, kind, pos, value``, those before the
    first segment (head) and behind the last (tail).  Where segments may be too long for a row, ``segment_lines`` leaves them in lines.
    """
    for p in (start, end, key):
        if p:
            re.compile(p)
    rows = _in_segments(lines, start, end, unterminated)
    segments = rows.where("__in").groupBy("pair_id", "seg_no").agg(
        _key_of(key).alias("key"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]).alias("lines"),
        (F.min("seq") + 1).alias("start_line"), F.max("seq").alias("__end"), F.max("__cut").alias("cut"),
    )
    segments = settle(segments)
    return segments.drop("__end"), _loose(rows, segments)


def segment_lines(lines: DataFrame, start: str, end: str | None = None, key: str | None = None, unterminated: str = "eof") -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``scan_segments``, without ever holding a segment: heads, lines and loose lines.

    Heads: ``pair_id, seg_no, key, start_line, n_lines, print, first_line, cut``.  ``print`` is a fingerprint of the lines in their order:
    the sums of two hashes of place and line, which tasks add up for their parts before they meet; two different segments
    have the same one by a chance of 2^-128.  Lines: ``pair_id, seg_no, pos, value`` with ``pos`` from 0.
    """
    for p in (start, end, key):
        if p:
            re.compile(p)
    rows = _in_segments(lines, start, end, unterminated).where("seg_no is not null")
    rows = settle(rows)
    inner = rows.where("__in")
    begins = inner.groupBy("pair_id", "seg_no").agg(F.min("seq").alias("__begin"))
    inner = settle(inner.join(begins, ["pair_id", "seg_no"]).withColumn("pos", F.col("seq") - F.col("__begin")))
    heads = inner.groupBy("pair_id", "seg_no").agg(
        _key_of(key).alias("key"), (F.min("seq") + 1).alias("start_line"), F.count("*").alias("n_lines"), ordered_print(F.col("pos"), F.col("value")).alias("print"),
        F.max(F.when(F.col("pos") == 0, F.col("value"))).alias("first_line"), F.max("seq").alias("__end"), F.max("__cut").alias("cut"),
    )
    heads = settle(heads)
    return heads.drop("__end"), inner.select("pair_id", "seg_no", "pos", "value"), _loose(rows, heads)


def _segment_label(start_line: Column, first_line: Column) -> Column:
    head = F.substring(strip(first_line), 1, 60)
    return F.concat(F.when(head == "", F.concat(F.lit("段@"), start_line.cast("string"))).otherwise(head), F.lit(" @"), start_line.cast("string"))


def compare_segment_lines(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Segments of both sides compared by their fingerprints, and only those that differ line by line.

    Each side is heads and lines of ``segment_lines``.  Returns ``pair_id, key, status, n_a, n_b, n_diff`` for each pair of
    segments (the n-th of A with the n-th of B of the same key; those without a key match one to one by their fingerprints), and
    ``pair_id, key, status, line_no, a, b`` for each differing line and each line of a segment of one side; ``line_no`` counts from 1, and
    what a side lacks is null.  No row holds a segment, so it may be as long as a file.
    """

    def side(heads: DataFrame, x: str) -> DataFrame:
        cols = ["pair_id", "seg_no", "key", "n_lines", "print", "start_line", "first_line"]
        keyed = nth_occurrence(heads.where("key is not null").select(*cols), ["pair_id", "key"], "seg_no")
        plain = nth_occurrence(heads.where("key is null").select(*cols), ["pair_id", "print", "n_lines"], "seg_no")
        shared = lambda d, same: d.select("pair_id", same.alias("__same"), "nth", F.col("key").alias(f"key_{x}"), F.col("seg_no").alias(f"seg_no_{x}"), F.col("n_lines").alias(f"n_{x}"), F.col("print").alias(f"print_{x}"), _segment_label(F.col("start_line"), F.col("first_line")).alias(f"label_{x}"))
        text = lambda c: F.concat_ws(",", F.lit("p"), F.col("n_lines").cast("string"), c["x"].cast("string"), c["y"].cast("string"))
        return shared(keyed, F.concat(F.lit("k"), F.col("key"))).unionByName(shared(plain, text(F.col("print"))))

    both = side(a[0], "a").join(side(b[0], "b"), ["pair_id", "__same", "nth"], "full")
    alike = (F.col("n_a") == F.col("n_b")) & (F.col("print_a") == F.col("print_b"))
    status = F.when(F.col("seg_no_a").isNull(), "unmatched_b").when(F.col("seg_no_b").isNull(), "unmatched_a").when(alike, "equal").otherwise("diff")
    key = F.coalesce("key_a", "key_b", "label_a", "label_b")
    return lines_apart(both.select("pair_id", key.alias("key"), status.alias("status"), "n_a", "n_b", "seg_no_a", "seg_no_b"), a[1], b[1], ["seg_no"])


def lines_apart(met: DataFrame, a: DataFrame, b: DataFrame, place: list[str], more: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Parts of texts that have met, with the number of lines that differ, and the differing lines of those that aren't equal.

    ``met`` has ``pair_id, key, status, n_a, n_b``, the columns of ``more``, and for each column of ``place`` that of side A and of side B
    (``_a``, ``_b``; null on a side that a part lacks); ``a`` and ``b`` have ``pair_id``, those of ``place``, ``pos`` and ``value``.
    """
    met = settle(met.withColumn("__id", F.monotonically_increasing_id()))
    apart = met.where("status <> 'equal'")

    def lines(rows: DataFrame, x: str) -> DataFrame:
        wanted = apart.where(F.col(f"{place[0]}_{x}").isNotNull()).select("__id", "pair_id", *[F.col(f"{c}_{x}").alias(c) for c in place])
        return rows.join(wanted, ["pair_id", *place]).select("__id", "pos", F.col("value").alias(x))

    differ = settle(lines(a, "a").join(lines(b, "b"), ["__id", "pos"], "full").where(~F.col("a").eqNullSafe(F.col("b"))))
    n = differ.groupBy("__id").agg(F.count("*").alias("n_diff"))
    results = met.join(n, "__id", "left").select("pair_id", "key", *more, "status", "n_a", "n_b", F.when(F.col("status") == "diff", F.coalesce("n_diff", F.lit(0))).otherwise(0).alias("n_diff"))
    shown = differ.join(apart.select("__id", "pair_id", "key", *more, "status"), "__id").select("pair_id", "key", *more, "status", (F.col("pos") + 1).alias("line_no"), "a", "b")
    return results, shown


def _result(rows: DataFrame, key: Column, missing: str | None = None) -> DataFrame:
    """Result rows of joined sides ``a`` and ``b`` (arrays of lines)."""
    two = F.col("a").isNotNull() & F.col("b").isNotNull()
    diff = F.when(two, diff_columns(F.col("a"), F.col("b"), missing=missing)).otherwise(F.array().cast("array<int>"))
    status = F.when(F.col("a").isNull(), "unmatched_b").when(F.col("b").isNull(), "unmatched_a").when(F.size("diff_cols") > 0, "diff").otherwise("equal")
    return rows.withColumn("diff_cols", diff).select("pair_id", key.alias("key"), status.alias("status"), F.lit("segment").alias("section"), F.col("a").alias("a_cols"), F.col("b").alias("b_cols"), "diff_cols")


def segment_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Result rows of segments with a key: the n-th of A with the n-th of B of the same key."""
    side = lambda d, x: nth_occurrence(d.where("key is not null").select("pair_id", "key", "seg_no", F.col("lines").alias(x)), ["pair_id", "key"], "seg_no").drop("seg_no")
    return _result(side(a, "a").join(side(b, "b"), ["pair_id", "key", "nth"], "full"), F.col("key"))


def segment_compare_unkeyed(a: DataFrame, b: DataFrame) -> DataFrame:
    """Result rows of segments without a key: equal texts match one to one, what is over is on one side alone."""
    def side(d: DataFrame, x: str) -> DataFrame:
        rows = d.where("key is null").select("pair_id", "seg_no", "start_line", "lines", F.array_join("lines", "\n").alias("text"))
        label = _segment_label(F.col("start_line"), F.get("lines", F.lit(0)))
        return nth_occurrence(rows.withColumn(f"label_{x}", label).withColumnRenamed("lines", x), ["pair_id", "text"], "seg_no").drop("seg_no", "start_line")

    return _result(side(a, "a").join(side(b, "b"), ["pair_id", "text", "nth"], "full"), F.coalesce("label_a", "label_b"))


def loose_line_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Result rows of head and tail lines, place by place."""
    side = lambda d, x: d.select("pair_id", "kind", "pos", F.array("value").alias(x))
    label = F.concat(F.when(F.col("kind") == "head", "文件头#").otherwise("文件尾#"), (F.col("pos") + 1).cast("string"))
    return _result(side(a, "a").join(side(b, "b"), ["pair_id", "kind", "pos"], "full"), label)


def segment_summary(results: DataFrame, segments_a: DataFrame, segments_b: DataFrame, loose_a: DataFrame, loose_b: DataFrame) -> DataFrame:
    """One row for each pair: segments of both sides, those without a key or an end, loose lines, and results by status
    (``results`` without the loose lines)."""
    n = results.groupBy("pair_id").agg(*[F.count_if(F.col("status") == s).alias(c) for s, c in (("equal", "equal"), ("diff", "diff"), ("unmatched_a", "only_a"), ("unmatched_b", "only_b"))])
    seg = lambda d, x: d.groupBy("pair_id").agg(F.count("*").alias(f"segments_{x}"), F.count_if(F.col("key").isNull()).alias(f"key_miss_{x}"), F.count_if(F.col("cut")).alias(f"cut_{x}"))
    loose = lambda d, x: d.groupBy("pair_id").agg(F.count_if(F.col("kind") == "head").alias(f"head_{x}"), F.count_if(F.col("kind") == "tail").alias(f"tail_{x}"))
    out = n
    for part in (seg(segments_a, "a"), seg(segments_b, "b"), loose(loose_a, "a"), loose(loose_b, "b")):
        out = out.join(part, "pair_id", "full")
    return out.fillna(0)


def export_segment_diff(results: DataFrame) -> DataFrame:
    """``pair_id, status, key, line_no, a, b``: a row for each differing line, numbered from 1; a segment of one side is one row
    without a number, its lines joined by line feeds."""
    rows = results.where("section = 'segment' and status <> 'equal'")
    rows = rows.withColumn("i", F.explode(F.when(F.col("status") == "diff", F.col("diff_cols")).otherwise(F.array(F.lit(None).cast("int")))))
    value = lambda x: F.coalesce(F.when(F.col("i").isNull(), F.array_join(x, "\n")).otherwise(F.get(x, F.col("i"))), F.lit(""))
    return rows.select("pair_id", "status", "key", (F.col("i") + 1).alias("line_no"), value("a_cols").alias("a"), value("b_cols").alias("b"))
