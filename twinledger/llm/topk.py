"""Exact top-k search over integer vectors by MaxScore, shard by shard.

A component is a term and a shard's column of that component its postings.  For a query, each
term has bounds on what it can add in the shard.  Terms go by the width of these bounds; the
essential ones are the shortest beginning without which the rest, at its best, can't lift a
vector over the k-th best score known.  Essential postings are summed for all vectors of the shard;
the others are probed only for vectors that can still compete.

Shards of candidates meet blocks of queries.  A task holds a block of queries and searches its shards one after the
other, so the k-th best of those before is the floor for the next; it returns at most k rows a
query, which are then merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, pick, prepare

_STEP = 8


def integers(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of every component as double.

    Vectors that are null, empty of an id, or hold null or non-finite components take no part.
    """
    x = F.col("embedding")
    sound = x.isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = pick(vectors, "vec_id", "embedding").where(sound)
    return rows.select("vec_id", F.transform(x, lambda c: F.floor(c.cast("double") * float(scale)).cast("long")).alias("v"))


class Best:
    """The best k of each query so far; blocks of vectors are searched one after the other."""

    def __init__(self, queries: np.ndarray, q_ids: np.ndarray, k: int):
        self.queries, self.q_ids, self.k = queries, q_ids, k
        self.ids = np.zeros((len(q_ids), k), np.int64)
        self.scores = np.full((len(q_ids), k), -np.inf)  # falling, ties by rising id; -inf where there is none yet

    def search(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        """MaxScore over one block: what can't reach a query's k-th best of the blocks before isn't looked at further."""
        k, width = self.k, min(self.queries.shape[1], vectors.shape[1])
        postings = np.ascontiguousarray(vectors.T[:width])
        low, high = postings.min(axis=1), postings.max(axis=1)
        some = np.ascontiguousarray(vectors[: 4 * k, :width])
        for n, (q, own) in enumerate(zip(self.queries[:, :width], self.q_ids, strict=True)):
            a, b = q * low, q * high
            least, most = np.minimum(a, b), np.maximum(a, b)
            terms = np.argsort(-(most - least), kind="stable")
            # rest[i]: the best that terms[i:] can add
            rest = np.concatenate((np.cumsum(most[terms][::-1])[::-1], [0.0]))
            floor = self.scores[n, -1]
            if floor == -np.inf:  # the k-th best of a few vectors scored in full
                first = (some @ q)[ids[: 4 * k] != own]
                floor = np.partition(first, len(first) - k)[len(first) - k] if len(first) >= k else floor
            base = np.concatenate(([0.0], np.cumsum(least[terms])))
            # the rest is non-essential as long as a vector that adds only the least elsewhere stays below the floor
            essential = int(np.argmax(base + rest < floor)) if (base + rest < floor).any() else len(terms)
            essential = max(essential, 1) if len(terms) else 0
            score = q[terms[:essential]] @ postings[terms[:essential]]
            live = np.flatnonzero((score + rest[essential] >= floor) & (ids != own))
            score = score[live]
            at = essential
            while at < len(terms) and len(live):
                step = terms[at : at + _STEP]
                score = score + q[step] @ postings[np.ix_(step, live)]
                at = min(at + _STEP, len(terms))
                if len(live) > k:  # what is certain of the rest lifts the floor
                    certain = score + base[-1] - base[at]
                    floor = max(floor, np.partition(certain, len(certain) - k)[len(certain) - k])
                keep = score + rest[at] >= floor
                live, score = live[keep], score[keep]
            if len(live):
                score, found = np.concatenate([self.scores[n], score]), np.concatenate([self.ids[n], ids[live]])
                best = np.lexsort((found, -score))[:k]
                self.ids[n], self.scores[n] = found[best], score[best]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, id and score, the best first."""
        have = np.isfinite(self.scores)
        return np.repeat(self.q_ids, have.sum(axis=1)), self.ids[have], self.scores[have].astype(np.int64)


def search_shard(queries: np.ndarray, q_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """Rows (query, id, score) of each query's best k in one shard, ties to smaller ids.

    ``queries`` and ``vectors`` hold integers as doubles, exact while scores stay below 2**53.
    """
    best = Best(queries, q_ids, k)
    best.search(vectors, ids)
    return best.rows()


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors side by side; a shorter one has zeros for what it lacks."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.list_value_length(rows).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(rows), int(size.max(initial=0))))
    out[np.repeat(np.arange(len(rows)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = rows.flatten().to_numpy()
    return out


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, shards: int | None = None, shard: int = 8192, block: int = 32768) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest inner products.

    Queries are the vectors whose id is divisible by ``every``, candidates all rows but those with the query's own
    id; ties go to smaller ids.  Rows that repeat are candidates each; a query id with several vectors
    takes its first in array order.  Vectors of unlike lengths meet as if the shorter ended in zeros.  Scores are
    exact below 2**53, far above what ``scale`` times unit vectors reach.

    The vectors are dealt over ``shards`` parts (by default one for each 262,144 of them, 12 at least) and the queries over blocks of
    ``block``; a task holds one block and the part's vectors stream by, ``shard`` of them at a time, so a task returns ``k`` rows
    a query at most.  An empty table gives no rows; null vectors and those with null or non-finite components take no part.
    """
    spark = prepare(vectors.sparkSession)
    rows = checkpoint(integers(vectors, scale))
    asked, total = rows.agg(F.count_if(F.col("vec_id") % every == 0), F.count("*")).first()
    shards = shards or max(12, -(-total // 262_144))
    blocks = -(-asked // block) or 1
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    as_query = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    as_query = as_query.withColumn("b", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)).cast("int")).withColumn("s", each(shards)).withColumn("stored", F.lit(False))
    stored = rows.withColumn("s", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int")).withColumn("b", each(blocks)).withColumn("stored", F.lit(True))
    at = ["s", "b", "stored"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, n, best = None, [], 0, None

        def out_of(best: Best | None) -> Iterator[pa.RecordBatch]:
            if best is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.rows()], names=["query_id", "vec_id", "score"])

        def flush() -> None:
            nonlocal best, n
            if held:
                table = pa.Table.from_batches(held)
                ids, m = table.column("vec_id").to_numpy(), _matrix(table.column("v"))
                if not unit[2]:
                    best = Best(m, ids, k)
                elif best is not None:
                    best.search(m, ids)
            held.clear()
            n = 0

        for batch in batches:
            marks = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1 if len(marks) else []
            for i, j in pairwise([0, *cuts, len(marks)] if len(marks) else []):
                now = tuple(marks[i].tolist())
                if unit is not None and now != unit:
                    flush()
                    if now[:2] != unit[:2]:
                        yield from out_of(best)
                        best = None
                unit = now
                held.append(batch.slice(i, j - i))
                n += j - i
                if now[2] and n >= shard:
                    flush()
        flush()
        yield from out_of(best)

    both = stored.select(*at, "vec_id", "v").unionByName(as_query.select(*at, "vec_id", "v"))
    near = both.repartition(min(shards * blocks, 1 << 15), "s", "b").sortWithinPartitions(*at).mapInArrow(work, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The registered query in DuckDB's SQL.
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id) q JOIN v c ON q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""
