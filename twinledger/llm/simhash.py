"""SimHash near-duplicates, with candidates pruned by the pigeonring principle.

A fingerprint has 64 bits, laid as a ring of five segments.  If two fingerprints differ in at
most 4 bits, some start on the ring has every chain of ``l`` segments with at most
``floor(4 l / 5)`` differences: none in the first segment, one in two, two in three, three in
four.  So they agree on the first segment and on two of three parts of the second, and
that is the key (15 for each fingerprint, about 22 bits each) by which candidates meet.
Pairs that meet must pass the longer chains, then the full Hamming check.

Groups of copies don't become pairs.  Equal fingerprints count once.  Inside a bucket
only a spanning forest of the links is returned: a reached fingerprint leaves the bucket, so a
dense group is done after few passes.  Large buckets are cut into blocks, and every pair of
blocks is a unit of work of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, add_columns, checkpoint, pick, texts_of, unused
from .components import components
from .pigeonring import SEGMENTS, budgets, chains, majority, mask, ring, signed, votes

_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Words in a shingle, differing bits that still link.
SHINGLE, BITS = 4, 4
_CHUNK = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash: a bit is 1 if set in over half of the shingles' XXH64 (seed 42)."""
    words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), (ends[shingle - 1 :] if len(words) > shingle else ends[-1:]).tolist()
    h = xxhash.xxh64_intdigest
    count = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        hashes = np.array([h(joined[s:e], 42) for s, e in zip(first[at : at + _CHUNK], last[at : at + _CHUNK], strict=True)], np.uint64)
        count += votes(hashes)
    return majority(count, n)


def add_fingerprint(docs: DataFrame, name: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as a signed long; null or wordless text has 0."""

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array(np.array([fingerprint(x) for x in texts_of(batch, "text")], np.uint64).view(np.int64))]

        return work

    return add_columns(docs, [T.StructField(name, T.LongType())], make)


def _keys() -> list[tuple[int, int]]:
    """(start on the ring, mask of the bits that must agree), one for each key."""
    parts, out = ring(), []
    for i in range(SEGMENTS):
        first, width = parts[(i + 1) % SEGMENTS]
        cuts = [round(width * j / 3) for j in range(4)]
        for j in range(3):  # one of the three parts may hold the one difference
            free = mask(first + cuts[j], cuts[j + 1] - cuts[j])
            out.append((i, mask(*parts[i]) | (mask(first, width) & ~free)))
    return out


KEYS = _keys()
#: Chains of 2, 3 and 4 segments; the key has seen to the first.
CHAINS, BUDGETS = chains()[:, 1:-1], budgets(BITS)[1:-1]


def _linked(x: np.ndarray, start: int) -> np.ndarray:
    """Which differences (xor of two fingerprints) pass every chain from ``start`` and the full check."""
    ok = np.ones(len(x), bool)
    for mask, most in zip(CHAINS[start], BUDGETS, strict=True):
        ok &= np.bitwise_count(x & mask) <= most
    ok[ok] = np.bitwise_count(x[ok]) <= BITS
    return ok


def _forest(fps: np.ndarray, start: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (places) that join everything which is joined inside one bucket, each newly reached fingerprint once."""
    rest = np.arange(len(fps))
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            ok = _linked(fps[rest] ^ fps[x], start)
            if ok.any():
                new, rest = rest[ok], rest[~ok]
                yield np.full(len(new), x), new
                queue.extend(new)


def links(fps: DataFrame, block: int = 2048) -> DataFrame:
    """Links ``a, b`` that have the components of the graph of all pairs within 4 bits.

    ``fps`` has one column ``fp`` of distinct longs, and perhaps ``node``, a different value of any type for each; the
    links are between nodes, or else between fingerprints.
    """
    fps = fps.select("fp", F.col("node" if "node" in fps.columns else "fp").alias("node"))
    kind = fps.schema["node"].dataType
    key = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("v")) for k, (_, m) in enumerate(KEYS)]))
    keyed = fps.select("fp", "node", key.alias("key")).select("key.k", "key.v", "fp", "node")
    shared = keyed.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(shared, ["k", "v"]).withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    met = met.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    unit = met.select("k", "v", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp", "node")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def done(rows: pa.Table) -> pa.RecordBatch:
            k, v, lo, hi, fp = (rows.column(i).to_numpy() for i in range(5))
            new = np.flatnonzero((k[1:] != k[:-1]) | (v[1:] != v[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            first = np.concatenate(([0], new))
            size = np.diff(np.concatenate((first, [len(k)])))
            found: list[tuple[np.ndarray, np.ndarray]] = []
            fp = fp.view(np.uint64)
            two = first[size == 2]
            for start in range(SEGMENTS):
                at = two[(k[two] // 3) == start]
                at = at[_linked(fp[at] ^ fp[at + 1], start)]
                found.append((at, at + 1))
            for at, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                found += [(a + at, b + at) for a, b in _forest(fp[at : at + n], int(k[at]) // 3)]
            nodes = rows.column(5).combine_chunks()
            return pa.RecordBatch.from_arrays([nodes.take(pa.array(np.concatenate(x))) for x in zip(*found, strict=True)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None and held.num_rows else rows
            same = np.ones(rows.num_rows, bool)
            for i in range(4):
                c = rows.column(i).to_numpy()
                same &= c == c[-1]
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            held = rows.slice(cut)
            if cut:
                yield done(rows.slice(0, cut))
        if held is not None and held.num_rows:
            yield done(held)

    at = ["k", "v", "lo", "hi"]
    out = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    return unit.repartition(*at).sortWithinPartitions(*at).mapInArrow(work, out).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs``.

    ``component_id`` is the smallest id in the component.  Null and empty texts have fingerprint 0 and
    link like any other.  Rows that repeat an id keep their own fingerprint and row.  A null id gets a
    component like any other row, and is never the smallest unless all are null.  An empty table gives no rows.  A text
    of any length is hashed whole, by the task that reads it.
    """
    marked = checkpoint(add_fingerprint(pick(docs, "doc_id", "text")).select("doc_id", "fp"))
    # a node carries its smallest id and sorts by it, so a component's root tells the component's smallest id
    node = F.struct(F.min("doc_id").isNull().alias("none"), F.min("doc_id").alias("id"), F.col("fp"))
    own = checkpoint(marked.groupBy("fp").agg(node.alias("node")))
    roots = components(links(own)).select(F.col("node.fp").alias("fp"), F.col("root.id").alias("root"), F.lit(True).alias("linked"))
    known = own.join(roots, "fp", "left").select("fp", F.when(F.col("linked"), F.col("root")).otherwise(F.col("node.id")).alias("component_id"))
    out = marked.join(known, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component with the columns of ``docs``: the one with the smallest id,
    of several such rows the one with the smallest hash of all its columns."""
    names, fp = docs.columns, unused(docs, "fp")
    marked = add_fingerprint(docs, fp)
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64(*[F.col(f"`{c}`") for c in names]))
    best = marked.groupBy(F.col(fp).alias("fp")).agg(F.min_by(F.struct(rank.alias("rank"), row.alias("row")), rank).alias("best"))
    roots = components(links(marked.select(F.col(fp).alias("fp")).distinct())).toDF("fp", "root")
    joined = best.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp")).agg(F.min_by("best.row", "best.rank").alias("row"))
    return joined.select("row.*")
