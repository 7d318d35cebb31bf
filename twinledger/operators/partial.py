"""Rows that nothing else pairs, paired by similarity."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.distances import edit_distances
from ..functions.strings import diff_columns
from ..sources.settle import settle


#: Pairs of rows with one value that are compared together.
BLOCK = 250_000
#: Pairs that are compared at once.
PIECE = 16_384
#: Rows in a task of blocks.
ROWS = 100_000
#: More than sums of similarities are off by rounding.
SLACK = 1e-9


def _blocks(a: DataFrame, b: DataFrame, block: int) -> DataFrame:
    """All rows with ``i`` and ``j`` and their ``side`` (0 or 1), dealt out by ``pair_id, v, i, j``: rows with one value meet in a grid of blocks of about
    ``block`` pairs, each pair in one.  A value that many rows share is so the work of many tasks, none of which holds all its rows."""
    n = lambda d, x: d.groupBy("pair_id", "v").agg(F.count("*").alias(x))
    cuts = settle(n(a, "na").join(n(b, "nb"), ["pair_id", "v"]).withColumn("cuts", F.ceil(F.sqrt(F.col("na") * F.col("nb") / block)).cast("int")))
    # by the pairs there are: values that few rows share are many, but little work
    pairs = cuts.agg(F.sum(F.col("na").cast("double") * F.col("nb"))).first()[0] or 0
    tasks = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(4096, math.ceil(pairs / block + (a.count() + b.count()) / ROWS)))
    # values with more than ``block`` pairs: few, as one side has very many rows of each
    crowded = F.broadcast(cuts.where("cuts > 1").select("pair_id", "v", "cuts"))

    def deal(d: DataFrame, own: str, other: str, id_: str) -> DataFrame:
        d = d.join(crowded, ["pair_id", "v"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
        d = d.withColumn(own, F.pmod(F.xxhash64(id_), F.col("cuts")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        return d.drop("cuts")

    a, b = deal(a, "i", "j", "a_id").withColumn("side", F.lit(0)), deal(b, "j", "i", "b_id").withColumn("side", F.lit(1))
    return a.unionByName(b, allowMissingColumns=True).repartition(tasks, "pair_id", "v", "i", "j")


def _scores(a: list[list[str]], b: list[list[str]], at: np.ndarray, to: np.ndarray, threshold: float) -> np.ndarray:
    """``similarity`` of the rows ``a[at]`` and ``b[to]``, by the same sums; what can't come to ``threshold`` is -1.

    Lengths bound what columns not yet compared can add, so most pairs go before all their columns are compared."""
    size = lambda rows, at: np.fromiter(map(len, rows), np.int64, len(rows))[at]
    width = np.maximum(size(a, at), size(b, to))
    cols = int(width.max(initial=0))
    column = lambda rows, c: [(r[c] or "") if c < len(r) else "" for r in rows]

    def bound(c: int) -> np.ndarray:
        x, y = (np.fromiter(map(len, column(rows, c)), np.int64, len(rows))[i] for rows, i in ((a, at), (b, to)))
        return np.where(c < width, 1 - np.abs(x - y) / np.maximum(np.maximum(x, y), 1), 0.0)

    most = sum((bound(c) for c in range(cols)), np.zeros(len(at)))
    score, live = np.zeros(len(at)), np.arange(len(at))
    for c in range(cols):
        most -= bound(c)
        live = live[(score[live] + most[live] + bound(c)[live]) / width[live] >= threshold - SLACK]
        mine = live[c < width[live]]
        x, y = column(a, c), column(b, c)
        ids = {v: i for i, v in enumerate(dict.fromkeys([*x, *y]))}
        i, j = (np.fromiter((ids[v] for v in z), np.int64, len(z))[k[mine]] for z, k in ((x, at), (y, to)))
        none = ids.get("", -1)
        part = (i == j).astype(float)
        other = np.flatnonzero((i != j) & (i != none) & (j != none))
        if len(other):
            p, t = at[mine[other]], to[mine[other]]
            long = np.maximum(*(np.fromiter(map(len, z), np.int64, len(z))[k] for z, k in ((x, p), (y, t))))
            part[other] = 1.0 - edit_distances(x, y, p, t) / long
        score[mine] += part
        live = live[(score[live] + most[live]) / width[live] >= threshold - SLACK]
    out = np.full(len(at), -1.0)
    out[live] = score[live] / width[live]
    out[out < threshold] = -1.0
    return out


def _similar(threshold: float, max_value_len: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Similar pairs of the rows of both sides, which come by block, A's first."""
    keys = ["pair_id", "v", "i", "j"]

    def fields(rows: pa.Table, used: np.ndarray) -> list[list[str]]:
        # as bytes, so that texts of no proper encoding are compared as well
        return [[x and x.decode("utf-8", "surrogateescape") for x in f] for f in rows["f"].take(pa.array(used)).to_pylist()]

    def compared(rows: pa.Table, at: np.ndarray, to: np.ndarray) -> pa.RecordBatch | None:
        used, mine = np.unique(at, return_inverse=True)
        have, theirs = np.unique(to, return_inverse=True)
        a, b = fields(rows, used), fields(rows, have)
        score = _scores(a, b, mine, theirs, threshold)
        found = np.flatnonzero(score >= 0)
        values = {j: {v for v in b[j] if v and len(v) <= max_value_len} for j in set(theirs[found].tolist())}
        first = rows["first_col"].take(pa.array(used)).to_pylist()
        # a pair counts where A's first shared column is
        found = np.array([k for k in found.tolist() if values[theirs[k]].isdisjoint(a[mine[k]][: first[mine[k]]])], np.int64)
        if not len(found):
            return None
        left, right = (rows.select([c for c in names if c in rows.column_names]).take(pa.array(x[found])) for names, x in ((("pair_id", "a_id", "first_col", "a_ord"), at), (("b_id", "b_ord"), to)))
        out = pa.table({"pair_id": left["pair_id"], "a_id": left["a_id"], "b_id": right["b_id"], "score": score[found], "first_col": left["first_col"], "a_ord": left["a_ord"], "b_ord": right["b_ord"]})
        return out.combine_chunks().to_batches()[0]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # A's rows of the block that goes on
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = (pa.concat_tables([held, rows]) if held is not None else rows).combine_chunks()
            n = rows.num_rows
            new = np.zeros(n, bool)
            new[:1] = True
            for c in keys:
                x = rows[c].combine_chunks()
                x = x if isinstance(x, pa.Array) else x.chunk(0)
                new[1:] |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], n)
            other = rows["side"].to_numpy() == 1
            # where each block's rows of B begin
            middle = ends - np.add.reduceat(other.astype(np.int64), starts)
            at, to, size = [], [], 0
            for start, mid, end in zip(starts.tolist(), middle.tolist(), ends.tolist(), strict=True):
                if start == mid or mid == end:
                    continue
                step = max(1, PIECE // (end - mid))
                for x in range(start, mid, step):
                    own = np.arange(x, min(x + step, mid))
                    for y in range(mid, end, PIECE):
                        theirs = np.arange(y, min(y + PIECE, end))
                        at.append(np.repeat(own, len(theirs)))
                        to.append(np.tile(theirs, len(own)))
                        size += len(at[-1])
                        if size >= PIECE:
                            out = compared(rows, np.concatenate(at), np.concatenate(to))
                            if out is not None:
                                yield out
                            at, to, size = [], [], 0
            if at:
                out = compared(rows, np.concatenate(at), np.concatenate(to))
                if out is not None:
                    yield out
            held = rows.slice(starts[-1], middle[-1] - starts[-1]) if n else None

    return work


def candidates(left_a: DataFrame, left_b: DataFrame, skip: list[int] = (), threshold: float = 0.6, max_value_len: int = 64, block: int = BLOCK) -> DataFrame:
    """``pair_id, a_id, b_id, score, first_col, a_ord, b_ord`` of rows that share a value in any column and are similar enough.

    Values are at most ``max_value_len`` characters and not empty.  Rows have ``pair_id, id, ord, fields``; ``ord`` orders a side,
    ``id`` is a row's own.  Rows meet at each value that they share, but count only where A's first shared column is.  Lengths and then
    the similarity decide there, so of a value that many rows share only the similar pairs leave the block.
    Rows of such a value meet in blocks of about ``block`` pairs.
    """
    kept = F.filter("fields", lambda x, i: ~i.isin(*skip)) if skip else F.col("fields")
    usable = lambda v: (v != "") & (F.length(v) <= max_value_len)
    side = lambda d, x: d.where("pair_id is not null").select("pair_id", F.col("id").alias(f"{x}_id"), F.col("ord").alias(f"{x}_ord"), kept.alias("f"))
    a = side(left_a, "a").select("*", F.posexplode("f").alias("first_col", "v")).where(usable(F.col("v")))
    b = side(left_b, "b").withColumn("v", F.explode(F.array_distinct(F.filter("f", usable))))
    a, b = (settle(d.withColumn("f", F.col("f").cast("array<binary>"))) for d in (a, b))
    both = _blocks(a, b, block)
    kind = {f.name: f.dataType for f in both.schema}
    out = T.StructType([T.StructField(c, kind.get(c, T.DoubleType())) for c in ("pair_id", "a_id", "b_id", "score", "first_col", "a_ord", "b_ord")])
    return both.sortWithinPartitions("pair_id", "v", "i", "j", "side").mapInArrow(_similar(threshold, max_value_len), out)


def assign(cands: DataFrame) -> DataFrame:
    """``pair_id, a_id, b_id``: each A in order takes its best free B (score, then its first shared column, then B's order).

    That is the same as proposals in rounds: every A asks the best B that is left to it, every B holds the first A
    in order and is lost to all behind that one.  It ends when every B that is asked is asked once.
    """
    # what very many tasks found becomes as many parts as its rows need
    open_ = settle(cands.repartition("pair_id", "a_id"))
    while True:
        ask = open_.groupBy("pair_id", "a_id").agg(F.min_by(F.struct("b_id", "a_ord"), F.struct((-F.col("score")).alias("s"), "first_col", "b_ord")).alias("x")).select("pair_id", "a_id", "x.*")
        ask = settle(ask)
        held = ask.groupBy("pair_id", "b_id").agg(F.min("a_ord").alias("held"), F.count("*").alias("n"))
        held = settle(held)
        if held.where("n > 1").isEmpty():
            return ask.select("pair_id", "a_id", "b_id")
        # who comes behind the one that a B holds can't get it
        open_ = settle(open_.join(held.drop("n"), ["pair_id", "b_id"], "left").where("held is null or a_ord <= held").drop("held"))


def partial_match(left_a: DataFrame, left_b: DataFrame, skip: list[int] = (), threshold: float = 0.6, max_value_len: int = 64) -> DataFrame:
    """Result rows of what similarity pairs (diff) and of what stays alone.

    Rows have ``pair_id, id, ord, fields, raw`` and perhaps ``display``, the lines of a folded record, which then are what
    differs.  No pair is dropped for being one of many: common values cost comparisons, but
    only similar pairs are written.
    """
    pairs = assign(candidates(left_a, left_b, skip, threshold, max_value_len))
    shown = lambda d: F.col("display") if "display" in d.columns else F.lit(None).cast("array<string>")
    side = lambda d, x: d.select("pair_id", F.col("id").alias(f"{x}_id"), F.coalesce(shown(d), "fields").alias(f"{x}_cols"), shown(d).isNotNull().alias(f"{x}_fold"), F.col("raw").alias(f"{x}_raw"))
    a, b = side(left_a, "a"), side(left_b, "b")
    both = a.join(pairs, ["pair_id", "a_id"], "left").join(b, ["pair_id", "b_id"], "full")
    two = F.col("a_id").isNotNull() & F.col("b_cols").isNotNull()
    status = F.when(two, "diff").when(F.col("b_cols").isNull(), "unmatched_a").otherwise("unmatched_b")
    fields = diff_columns(F.col("a_cols"), F.col("b_cols"), list(skip), missing=None)
    lines = diff_columns(F.when(F.col("a_fold"), F.col("a_cols")).otherwise(F.array("a_raw")), F.when(F.col("b_fold"), F.col("b_cols")).otherwise(F.array("b_raw")), missing=None)
    diff = F.when(two, F.when(F.col("a_fold") | F.col("b_fold"), lines).otherwise(fields)).otherwise(F.array().cast("array<int>"))
    return both.select("pair_id", F.trim(F.coalesce("a_raw", "b_raw")).alias("key"), status.alias("status"), F.lit("data").alias("section"), "a_cols", "b_cols", diff.alias("diff_cols"), "a_raw", "b_raw")
