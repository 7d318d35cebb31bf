"""What the differences of a column look like."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strings import is_blank
from .cells import Cells

_NUMBER = r"^[\x00-\x20]*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?[\x00-\x20]*$"
# Fixed value: what looks like a date.
_DATE = r"^[\x00-\x20]*([0-9]{8}([0-9]{6})?|[0-9]{4}[-/年][0-9]{1,2}[-/月][0-9]{1,2}日?.*)[\x00-\x20]*$"


def diff_cells(results: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``pair_id, col, seq, key, a, b, label, name``: a row for each differing column of each differing record, virtual ones too."""
    cells, i = Cells(results, names), F.col("col")
    rows = results.where("section = 'data' and status = 'diff'").withColumn("col", F.explode("diff_cols"))
    return rows.select("pair_id", "col", "seq", "key", cells.value("a", i).alias("a"), cells.value("b", i).alias("b"), cells.number(i).alias("label"), cells.name(i).alias("name"))


def one_sided_samples(results: DataFrame, cap: int = 10) -> DataFrame:
    """``pair_id, n, status, key, cols``: the first ``cap`` records of each pair that only one side has, B's before A's."""
    rows = results.where("section = 'data'").where(F.col("status").isin("unmatched_a", "unmatched_b"))
    n = F.row_number().over(Window.partitionBy("pair_id").orderBy("seq", "key"))
    return rows.select("pair_id", n.alias("n"), "status", "key", F.coalesce("a_cols", "b_cols").alias("cols")).where(F.col("n") <= cap)


def top_columns(features: DataFrame, most: int = 20) -> DataFrame:
    """``features`` with their ``rank`` in the pair, most differences first, and only the first ``most``: what a compact report shows."""
    rank = F.row_number().over(Window.partitionBy("pair_id").orderBy(F.desc("count"), "col"))
    return features.withColumn("rank", rank).where(F.col("rank") <= most)


def _shared(a: Column, b: Column) -> Column:
    """How many characters two texts share at their beginning."""
    n = F.least(F.length(a), F.length(b))
    step = lambda acc, i: F.when((acc == i - 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(acc)
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step)).otherwise(0)


def _prefix(a: Column, b: Column) -> Column:
    return F.substring(a, F.lit(1), _shared(a, b))


def samples(results: DataFrame, cap: int = 30) -> DataFrame:
    """The first ``cap`` differing cells of each column."""
    n = F.row_number().over(Window.partitionBy("pair_id", "col").orderBy("seq", "key"))
    return diff_cells(results).withColumn("n", n).where(F.col("n") <= cap)


def diff_features(results: DataFrame, sample_cap: int = 30, top: int = 8) -> DataFrame:
    """One row for each differing column, virtual ones with their ``label``.

    Counted over all cells: ``count, empty_a, empty_b, kinds`` (of A to B patterns) and the ``top`` patterns as text, most
    frequent first.  From the first ``sample_cap`` cells: pairs of numbers and of dates, values that grow or shrink, and
    what all have in common at their beginning and end.
    """
    cells = diff_cells(results)
    patterns = cells.groupBy("pair_id", "col", "a", "b").agg(F.count("*").alias("n"))
    shown = cells.groupBy("pair_id", "col").agg(F.first("label").alias("label"))
    totals = patterns.groupBy("pair_id", "col").agg(
        F.sum("n").alias("count"), F.sum(F.when(is_blank(F.col("a")), F.col("n")).otherwise(0)).alias("empty_a"), F.sum(F.when(is_blank(F.col("b")), F.col("n")).otherwise(0)).alias("empty_b"), F.count("*").alias("kinds")
    )
    rank = F.row_number().over(Window.partitionBy("pair_id", "col").orderBy(F.desc("n"), "a", "b"))
    best = patterns.withColumn("rank", rank).where(F.col("rank") <= top).groupBy("pair_id", "col").agg(F.array_sort(F.collect_list(F.struct("rank", "a", "b", "n"))).alias("x"))
    best = best.select("pair_id", "col", F.array_join(F.transform("x", lambda t: F.concat(t["a"], F.lit(">"), t["b"], F.lit("="), t["n"].cast("string"))), ";").alias("top_patterns"))
    both = lambda p: F.count_if(F.col("a").rlike(p) & F.col("b").rlike(p))
    seen = samples(results, sample_cap).groupBy("pair_id", "col").agg(
        both(_NUMBER).alias("numeric_pairs"), both(_DATE).alias("date_pairs"), F.count_if(F.length("a") < F.length("b")).alias("grows"), F.count_if(F.length("a") > F.length("b")).alias("shrinks"),
        F.array_sort(F.collect_list(F.struct("n", "a", "b"))).alias("x"),
    )

    def common(flip: bool) -> Column:
        turn = F.reverse if flip else (lambda c: c)
        fold = lambda acc, t: F.when(acc == "", _prefix(turn(t["a"]), turn(t["b"]))).otherwise(_prefix(acc, _prefix(turn(t["a"]), turn(t["b"]))))
        return turn(F.aggregate("x", F.lit(""), fold))

    seen = seen.withColumns({"common_prefix": common(False), "common_suffix": common(True)}).drop("x")
    return totals.join(shown, ["pair_id", "col"]).join(best, ["pair_id", "col"]).join(seen, ["pair_id", "col"])


def _plain_difference(a: str, b: str, most: int = 10_000) -> str | None:
    """b - a in full, with as many decimals as the longer of both has, however many digits; null for exponents beyond ``most``."""
    parts = []
    for text in (a, b):
        body, _, power = text.strip("".join(map(chr, range(33)))).lower().partition("e")
        whole, _, decimals = body.partition(".")
        if len(power) > 7 or abs(int(power or 0)) > most:
            return None
        parts.append((int(whole + decimals) if whole.strip("+-") or decimals else 0, len(decimals) - int(power or 0)))
    (x, m), (y, n) = parts
    scale = max(m, n)
    d = y * 10 ** (scale - n) - x * 10 ** (scale - m)
    digits = str(abs(d)) + "0" * max(0, -scale if d else 0)
    if scale > 0:
        digits = digits.rjust(scale + 1, "0")
        digits = f"{digits[:-scale]}.{digits[-scale:]}"
    return ("-" if d < 0 else "+") + digits


def numeric_delta_mode(results: DataFrame, sample_cap: int = 30) -> DataFrame:
    """``pair_id, col, delta, n``: the difference B - A of more than half of a column's sampled pairs of numbers, of two at least.

    Differences are exact, whatever the number of digits, and told apart as plain text with as many decimals as the longer of both
    has, so 1 and 1.00 are two.
    """
    rows = samples(results, sample_cap).where(F.col("a").rlike(_NUMBER) & F.col("b").rlike(_NUMBER)).select("pair_id", "col", "n", "a", "b")
    plain = _plain_difference

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = [plain(a, b) for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(d, pa.string())], names=["pair_id", "col", "n", "d"])

    rows = rows.mapInArrow(work, T.StructType([*rows.schema.fields[:3], T.StructField("d", T.StringType())])).where("d is not null")
    n = rows.groupBy("pair_id", "col", "d").agg(F.count("*").alias("n"), F.min("n").alias("first"))
    best = n.groupBy("pair_id", "col").agg(F.sum("n").alias("all"), F.max_by(F.struct("d", "n"), F.struct("n", -F.col("first"))).alias("m"))
    best = best.where((F.col("all") >= 2) & (F.col("m.n") * 2 > F.col("all")))
    return best.select("pair_id", "col", F.col("m.d").alias("delta"), F.col("m.n").alias("n"))


def diff_column_overview(freq: DataFrame, summary: DataFrame) -> DataFrame:
    """``pair_id, col, n, percent`` of B's records, and the signed deviation of B's number of records from A's."""
    share = F.when(F.col("data_rows_b") > 0, F.col("n") * 100.0 / F.col("data_rows_b"))
    change = (F.col("data_rows_b") - F.col("data_rows_a")) / F.greatest(F.lit(1), "data_rows_a")
    return freq.join(summary.select("pair_id", "data_rows_a", "data_rows_b"), "pair_id").select("pair_id", "col", "n", share.alias("percent"), change.alias("count_change"))


SPANS = T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), *[T.StructField(n, T.IntegerType()) for n in ("i1", "i2", "j1", "j2")]]))


_FULL = np.uint64((1 << 63) - 1)


def _growth(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Bit vectors, in 63-bit words, of how longest common subsequences of pairs grow, the longest x first: [t, pair, word] for
    the last t characters of x.

    Bit k is 1 where one more character of y's end, the (k+1)-th from its end, makes it longer.  A character of x is one
    addition with carries for all pairs at once (the bit-parallel recurrence V = (V + (V & M)) | (V & ~M), growth being ~V).
    """
    words = max(1, *(-(-len(y) // 63) for y in ys))
    longest = len(xs[0])
    # the places of each character of y, from its end, as bits; row 0 is for characters that y lacks
    masks, rows = [[0] * words], np.zeros((len(xs), longest), np.int64)
    for p, (x, y) in enumerate(zip(xs, ys, strict=True)):
        own: dict[int, int] = {}
        for k, c in enumerate(y[::-1].tolist()):
            at = own.setdefault(c, len(masks))
            if at == len(masks):
                masks.append([0] * words)
            masks[at][k // 63] |= 1 << k % 63
        rows[p, : len(x)] = [own.get(c, 0) for c in x[::-1].tolist()]
    table = np.array(masks, np.uint64)
    sizes = np.array(list(map(len, xs)))
    v = np.full((len(xs), words), _FULL)
    steps = np.empty((longest + 1, len(xs), words), np.uint64)
    steps[0] = v
    for t in range(longest):
        live = int(np.searchsorted(-sizes, -t, "left"))  # they stand in front
        m, part = table[rows[:live, t]], v[:live]
        hit = part & m
        carry = np.zeros(live, np.uint64)
        for w in range(words):
            total = part[:, w] + hit[:, w] + carry
            carry = total >> np.uint64(63)
            part[:, w] = (total & _FULL) | (part[:, w] & ~m[:, w])
        steps[t + 1] = v
    return ~steps & _FULL


def _ways(xs: list[np.ndarray], ys: list[np.ndarray]) -> list[list[list]]:
    """For each pair the tags (tag, size) of the way that keeps the longest subsequence, deletions first; the longest x first."""
    grow = _growth(xs, ys)
    words = grow.shape[2]
    n, m = (np.array(list(map(len, z))) for z in (xs, ys))
    place = np.arange(words) * 63
    # the lowest bits up to a length
    low = (np.uint64(1) << np.clip(np.arange(int(m.max()) + 1)[:, None] - place, 0, 63).astype(np.uint64)) - np.uint64(1)
    wide = [np.zeros((len(z), max(map(len, z)) + 1), np.int64) for z in (xs, ys)]
    for z, w in zip((xs, ys), wide, strict=True):
        for p, codes in enumerate(z):
            w[p, : len(codes)] = codes
    i, j, live, kinds = np.zeros_like(n), np.zeros_like(m), np.flatnonzero((n > 0) & (m > 0)), []
    while len(live):
        a, b = i[live], j[live]
        kind = np.zeros(len(live), np.int8)
        apart = np.flatnonzero(wide[0][live, a] != wide[1][live, b])
        p, a, b = live[apart], a[apart], b[apart]
        rest = m[p] - b
        without_x = np.bitwise_count(grow[n[p] - a - 1, p] & low[rest]).sum(axis=1, dtype=np.int64)
        without_y = np.bitwise_count(grow[n[p] - a, p] & low[rest - 1]).sum(axis=1, dtype=np.int64)
        kind[apart] = np.where(without_x >= without_y, 1, 2)
        every = np.full(len(n), -1, np.int8)
        every[live] = kind
        kinds.append(every)
        i[live] += kind != 2
        j[live] += kind != 1
        live = live[(i[live] < n[live]) & (j[live] < m[live])]
    steps = np.array(kinds, np.int8).reshape(len(kinds), len(n)).T
    out = []
    for p in range(len(n)):
        own = steps[p]
        own = own[: int((own >= 0).sum())]
        cut = np.flatnonzero(np.diff(own, prepend=-1)) if len(own) else np.zeros(0, np.int64)
        tags = [[("equal", "delete", "insert")[k], size] for k, size in zip(own[cut].tolist(), np.diff(cut, append=len(own)).tolist(), strict=True)]
        out.append([*tags, ["delete", int(n[p] - i[p])], ["insert", int(m[p] - j[p])]])
    return out


def _ends(x: np.ndarray, y: np.ndarray) -> list[list]:
    """Spans of two texts of which only what both have in common at their beginning and end is equal."""
    n, m = len(x), len(y)
    k = min(n, m)
    differ = np.flatnonzero(x[:k] != y[:k])
    lo = int(differ[0]) if len(differ) else k
    k -= lo
    differ = np.flatnonzero(x[n - k :][::-1] != y[m - k :][::-1])
    hi = int(differ[0]) if len(differ) else k
    return [["equal", lo], ["delete", n - lo - hi], ["insert", m - lo - hi], ["equal", hi]]


def _spans(tags: list[list]) -> list[dict]:
    out: list[dict] = []
    i = j = 0
    for tag, size in tags:
        if not size:
            continue
        if not out or out[-1]["tag"] != tag:
            out.append({"tag": tag, "i1": i, "i2": i, "j1": j, "j2": j})
        i, j = i + size * (tag != "insert"), j + size * (tag != "delete")
        out[-1].update(i2=i, j2=j)
    return out or [{"tag": "equal", "i1": 0, "i2": 0, "j1": 0, "j2": 0}]


def opcodes(pairs: list[tuple[str, str]], most: int = 40_000) -> list[list[dict]]:
    """Equal, deleted and inserted spans of pairs of texts in order, by a longest common subsequence.

    Where both a deletion and an insertion keep the longest, the deletion comes first.  If the product of the lengths is
    above ``most``, only what both have in common at their beginning and end is equal, and the rest deleted and inserted.
    """
    codes = lambda t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    coded = [(codes(a), codes(b)) for a, b in pairs]
    # alike lengths together, so that neither steps nor words are wasted
    near = sorted((k for k, (x, y) in enumerate(coded) if len(x) * len(y) <= most), key=lambda k: (max(1, -(-len(coded[k][1]) // 63)), -len(coded[k][0])))
    tags = [_ends(x, y) if len(x) * len(y) > most else [] for x, y in coded]
    at = 0
    while at < len(near):
        words = max(1, -(-len(coded[near[at]][1]) // 63))
        end = at
        longest = 0
        while end < len(near) and end - at < 512 and max(1, -(-len(coded[near[end]][1]) // 63)) == words:
            longest = max(longest, len(coded[near[end]][0]))
            if end > at and (longest + 1) * (end + 1 - at) * words > 1 << 21:
                break
            end += 1
        some = near[at:end]
        xs, ys = ([coded[k][side] for k in some] for side in (0, 1))
        if any(map(len, xs)) and any(map(len, ys)):
            found = _ways(xs, ys)
        else:
            found = [[["delete", len(x)], ["insert", len(y)]] for x, y in zip(xs, ys, strict=True)]
        for k, way in zip(some, found, strict=True):
            tags[k] = way
        at = end
    return [_spans(t) for t in tags]


def _opcodes(a: str, b: str, most: int = 40_000) -> list[dict]:
    """The spans of one pair."""
    return opcodes([(a, b)], most)[0]


def cell_diff_spans(results: DataFrame, most: int = 40_000) -> DataFrame:
    """``pair_id, col, a, b, n, spans``: how each different pair of cell values differs, and how often it occurs.

    Places count code points.  Pairs whose lengths multiply to more than ``most`` are compared at both ends only.
    """
    pairs = diff_cells(results).groupBy("pair_id", "col", "a", "b").agg(F.count("*").alias("n"))
    find = opcodes

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("tag", pa.string()), *[(n, pa.int32()) for n in ("i1", "i2", "j1", "j2")]]))
        for batch in batches:
            spans = find(list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)), most)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], names=[*batch.schema.names, "spans"])

    return pairs.mapInArrow(work, T.StructType([*pairs.schema.fields, T.StructField("spans", SPANS)]))


# tasks get this module's functions themselves, so workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
