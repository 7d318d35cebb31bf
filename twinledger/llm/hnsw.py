"""Near-duplicate vectors by hierarchical navigable small-world graphs, one for each shard.

Equal vectors count as one node of several rows.  Nodes are dealt to shards, each small
enough for one task.  A task builds its shard's graph, then the queries stream by; of every two
shards one asks the other, so every pair of vectors is looked for once.  Beams widen for a query while all that its beam holds
is near enough, and for a batch while an audit by brute force on some of its queries shows too low a
recall.  Every link is verified by its cosine in double precision.  A task returns numbers of
links for both ends, and only a spanning forest of the links themselves, so dense groups don't become
pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, give_back, pick, prepare
from .components import components

#: Neighbours of a node above the ground (twice as many on it), beam while building.
LINKS, BUILD_BEAM = 12, 40
#: Beams tried in turn; after the last the whole shard is looked at.
BEAMS = (32, 128, 512)
AUDIT, RECALL = 64, 0.99
_BATCH, _EXPAND = 512, 4
_ASKED = 8192  # queries that a task holds at a time


class Graph:
    """A navigable small-world graph over unit vectors, searched for many queries at once."""

    def __init__(self, x: np.ndarray, seed: int = 1):
        self.x = np.ascontiguousarray(x, dtype=np.float32)
        n = len(x)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int), 12)
        order = rng.permutation(n)
        top = int(self.level.max()) if n else 0
        self.near = [np.full((n, LINKS * (2 if h == 0 else 1)), -1, np.int32) for h in range(top + 1)]
        self.entry: np.ndarray = np.zeros(0, np.int64)
        self.size = 0
        while self.size < n:
            batch = order[self.size : self.size + max(64, min(_BATCH, self.size))]
            self._insert(batch)
            self.size += len(batch)
            done = order[: self.size]
            self.entry = done[np.argsort(-self.level[done], kind="stable")[:4]]

    def _sims(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out = np.einsum("bd,bcd->bc", q, self.x[np.maximum(ids, 0)])
        out[ids < 0] = -np.inf
        return out

    def _select(self, q: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` of the candidates (sorted by nearness): first those nearer to the node than
        to any chosen before, then the nearest of the rest."""
        v = self.x[np.maximum(ids, 0)]
        between = v @ v.transpose(0, 2, 1)
        b, c = ids.shape
        chosen = np.zeros((b, c), bool)
        for j in range(c):
            rival = np.where(chosen, between[:, j], -np.inf).max(axis=1)
            chosen[:, j] = (ids[:, j] >= 0) & (sims[:, j] > rival) & (chosen.sum(axis=1) < most)
        order = np.argsort(np.where(ids < 0, 2, np.where(chosen, 0, 1)), axis=1, kind="stable")[:, :most]
        return np.take_along_axis(ids, order, axis=1)

    def _insert(self, batch: np.ndarray) -> None:
        q = self.x[batch]
        own = q @ q.T  # the batch's members are candidates for one another
        np.fill_diagonal(own, -np.inf)
        start = None
        for h in range(len(self.near) - 1, -1, -1):
            if self.size:
                ids, sims = self._beam(q, start, BUILD_BEAM if (self.level[batch] >= h).any() else 4, h)
                start = ids[:, :8]
            else:
                ids, sims = np.full((len(batch), 1), -1, np.int64), np.full((len(batch), 1), -np.inf)
            here = np.flatnonzero(self.level[batch] >= h)
            if not len(here):
                continue
            peers = np.where(self.level[batch] >= h, own[here], -np.inf)
            k = min(LINKS, len(batch))
            best = np.argpartition(-peers, k - 1, axis=1)[:, :k]
            near = np.take_along_axis(peers, best, axis=1)
            ids = np.concatenate([ids[here], np.where(np.isfinite(near), batch[best], -1)], axis=1)
            sims = np.concatenate([sims[here], near], axis=1)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
            ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
            new = self._select(q[here], ids, sims, LINKS)
            self.near[h][batch[here], : new.shape[1]] = new
            self._back_links(batch[here], new, h)

    def _back_links(self, nodes: np.ndarray, new: np.ndarray, h: int) -> None:
        """Let the chosen neighbours know their new neighbours, and prune those with too many."""
        near, most = self.near[h], self.near[h].shape[1]
        a, b = np.repeat(nodes, new.shape[1]), new.ravel()
        a, b = a[b >= 0], b[b >= 0]
        touched = np.unique(b)
        if not len(touched):
            return
        old = near[touched]
        src = np.concatenate([b, np.repeat(touched, most)])
        dst = np.concatenate([a, old.ravel()])
        src, dst = src[dst >= 0], dst[dst >= 0]
        pair = np.unique(src.astype(np.int64) * len(self.x) + dst)
        src, dst = pair // len(self.x), pair % len(self.x)
        sims = np.einsum("ed,ed->e", self.x[src], self.x[dst])
        order = np.lexsort((-sims, src))
        src, dst, sims = src[order], dst[order], sims[order]
        first = np.concatenate(([0], np.flatnonzero(src[1:] != src[:-1]) + 1))
        rank = np.arange(len(src)) - np.repeat(first, np.diff(np.concatenate((first, [len(src)]))))
        wide = most + 8
        keep = rank < wide
        row = np.searchsorted(touched, src[keep])
        ids, s = np.full((len(touched), wide), -1, np.int64), np.full((len(touched), wide), -np.inf, np.float32)
        ids[row, rank[keep]], s[row, rank[keep]] = dst[keep], sims[keep]
        full = (ids >= 0).sum(axis=1) > most
        near[touched[~full]] = ids[~full, :most]
        if full.any():
            near[touched[full]] = self._select(self.x[touched[full]], ids[full], s[full], most)

    def _beam(self, q: np.ndarray, start: np.ndarray | None, beam: int, h: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``beam`` nodes found on level ``h`` for each query, sorted by nearness (-1: none)."""
        b = len(q)
        entry = np.broadcast_to(self.entry, (b, len(self.entry)))
        start = np.sort(entry if start is None else np.concatenate([start, entry], axis=1), axis=1)
        start[:, 1:][start[:, 1:] == start[:, :-1]] = -1
        start = np.where(self.level[np.maximum(start, 0)] >= h, start, -1)
        ids = np.full((b, beam), -1, np.int64)
        sims = np.full((b, beam), -np.inf, np.float32)
        seen = np.zeros((b, len(self.x)), bool)
        first = self._sims(q, start)
        order = np.argsort(-first, axis=1, kind="stable")[:, :beam]
        width = order.shape[1]
        ids[:, :width], sims[:, :width] = np.take_along_axis(start, order, axis=1), np.take_along_axis(first, order, axis=1)
        row = np.repeat(np.arange(b), start.shape[1])
        seen[row[start.ravel() >= 0], start.ravel()[start.ravel() >= 0]] = True
        open_ = ids >= 0
        live = np.flatnonzero(open_.any(axis=1))
        near = self.near[h]
        while len(live):
            todo = np.argsort(~open_[live], axis=1, kind="stable")[:, :_EXPAND]
            ready = np.take_along_axis(open_[live], todo, axis=1)
            center = np.where(ready, np.take_along_axis(ids[live], todo, axis=1), -1)
            flag = open_[live]
            np.put_along_axis(flag, todo, False, axis=1)
            open_[live] = flag
            found = np.where(center[:, :, None] >= 0, near[np.maximum(center, 0)], -1).reshape(len(live), -1).astype(np.int64)
            found = np.sort(found, axis=1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
            at = live[:, None]
            found[(found >= 0) & seen[at, np.maximum(found, 0)]] = -1
            r, c = np.nonzero(found >= 0)
            seen[live[r], found[r, c]] = True
            s = np.full(found.shape, -np.inf, np.float32)
            s[r, c] = np.einsum("ed,ed->e", q[live[r]], self.x[found[r, c]])
            all_ids = np.concatenate([ids[live], found], axis=1)
            all_sims = np.concatenate([sims[live], s], axis=1)
            all_open = np.concatenate([open_[live], found >= 0], axis=1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[live], sims[live] = np.take_along_axis(all_ids, order, axis=1), np.take_along_axis(all_sims, order, axis=1)
            open_[live] = np.take_along_axis(all_open, order, axis=1)
            live = live[open_[live].any(axis=1)]
        return ids, sims

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        start = None
        for h in range(len(self.near) - 1, 0, -1):
            start = self._beam(q, start, 4, h)[0]
        return self._beam(q, start, beam, 0)


def near_in_shard(graph: Graph, raw: np.ndarray, queries: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each query its verified links in the shard, as places in ``raw``; in batches."""
    norm = np.sqrt((raw * raw).sum(axis=1))
    n = len(raw)

    def verified(k: int, ids: np.ndarray) -> np.ndarray:
        ids = ids[ids >= 0]
        q = queries[k]
        return np.sort(ids[(raw[ids] @ q) / (norm[ids] * np.sqrt(q @ q)) >= least])

    def exact(ks: np.ndarray) -> list[np.ndarray]:
        unit = (queries[ks] / np.sqrt((queries[ks] ** 2).sum(axis=1))[:, None]).astype(np.float32)
        out: list[np.ndarray] = []
        for at in range(0, len(ks), 64):
            s = unit[at : at + 64] @ graph.x.T
            out += [verified(k, np.flatnonzero(r >= least - 1e-3)) for k, r in zip(ks[at : at + 64], s, strict=True)]
        return out

    for at in range(0, len(queries), _BATCH):
        ks = np.arange(at, min(at + _BATCH, len(queries)))
        links: dict[int, np.ndarray] = {}
        audit = ks[np.random.default_rng(at).permutation(len(ks))[:AUDIT]]
        truth = dict(zip(audit.tolist(), exact(audit), strict=True))
        todo = ks
        for beam in (*BEAMS, n):
            if beam >= n:
                links.update(zip(todo.tolist(), exact(todo), strict=True))
                break
            wide = []
            for part in np.array_split(todo, -(-len(todo) * beam // (_BATCH * BEAMS[0]))):
                unit = (queries[part] / np.sqrt((queries[part] ** 2).sum(axis=1))[:, None]).astype(np.float32)
                ids, sims = graph.search(unit, beam)
                for k, i, s in zip(part.tolist(), ids, sims, strict=True):
                    links[k] = verified(k, i[s >= least - 1e-3])
                wide.append(part[sims[:, -1] >= least])
            full = np.concatenate(wide)  # they go on whatever the audit says
            told = set(truth) - set(full.tolist())
            want = np.array([len(truth[k]) for k in sorted(told)])
            got = np.array([len(np.intersect1d(links[k], truth[k])) for k in sorted(told)])
            some = want > 0
            # by links and by queries, so that neither dense nor lone ones hide the others' misses
            low = some.any() and min(got.sum() / want.sum(), (got[some] / want[some]).mean()) < RECALL
            todo = todo if low else full
            if not len(todo):
                break
        yield from sorted(links.items())


class Shard:
    """The graph of a shard, and what is joined among its nodes so far."""

    def __init__(self, rows: pa.Table):
        order = np.argsort(rows.column("node").to_numpy(), kind="stable")
        self.ids, self.least, self.weight = (rows.column(c).to_numpy()[order] for c in ("node", "least", "n"))
        self.raw = _matrix(rows.column("embedding"))[order]
        self.graph = Graph(self.raw / np.sqrt((self.raw * self.raw).sum(axis=1))[:, None])
        self.root = np.arange(len(self.ids))

    def answer(self, rows: pa.Table, limit: float) -> pa.RecordBatch:
        """Links of some queries: numbers of links for each end, and links that join what isn't joined yet."""
        ids, least, weight, own = (rows.column(c).to_numpy() for c in ("node", "least", "n", "own"))
        n = len(self.ids)
        place = np.minimum(np.searchsorted(self.ids, ids), n - 1)
        at = np.where(self.ids[place] == ids, place, n + np.arange(len(ids)))
        root = np.concatenate([self.root, n + np.arange(len(ids))])
        counted, edges, seen = np.zeros(len(ids), np.int64), [], np.zeros(n, np.int64)

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for k, found in near_in_shard(self.graph, self.raw, _matrix(rows.column("embedding")), limit):
            found = found[found != at[k]]
            if not len(found):
                continue
            counted[k] = self.weight[found].sum()
            if not own[k]:  # the shard's nodes don't ask the query's shard
                seen[found] += weight[k]
            up = root[found]
            while (root[up] != up).any():
                up = root[up]
            root[found] = up
            for u, i in zip(*np.unique(up, return_index=True), strict=True):
                a, b = top(int(at[k])), top(int(u))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    edges.append((k, int(found[i])))
        self.root = root[:n].copy()  # the smaller place is the root, so these lie among the nodes
        asked, near = np.flatnonzero(counted), np.flatnonzero(seen)
        k, i = (np.array(x, np.int64) for x in (zip(*edges, strict=True) if edges else ((), ())))
        columns = (
            (least[asked], self.least[near], least[k]), (ids[asked], self.ids[near], ids[k]),
            (least[asked], self.least[near], self.least[i]), (ids[asked], self.ids[near], self.ids[i]),
            (counted[asked], seen[near], np.zeros(len(k), np.int64)),
        )
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=OUT.names)


OUT = T.StructType([T.StructField(c, T.LongType()) for c in ("a_least", "a", "b_least", "b", "links")])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows of doubles, each by its largest component: squares of others could overflow or vanish, and the cosine doesn't change."""
    out = column.combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(column), -1)
    return out / np.abs(out).max(axis=1, keepdims=True)


def near_duplicates(
    vectors: DataFrame, least: float = 0.95, shards: int = 12, shard_size: int = 32768, shard_bytes: int = 1 << 24, asked_together: int = 1 << 20
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors``.

    A link joins rows whose vectors have a cosine of ``least`` or more.  ``n_links`` counts the other rows
    linked directly, ``component_id`` is the smallest id reachable, ``kept`` tells whether it is the row's own.
    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do rows
    without an id (component null, kept).  Rows that repeat are rows of their own that link with each
    other.  Vectors of different lengths don't link.  An empty table gives no rows.

    There are ``shards`` shards or more, of ``shard_size`` vectors and ``shard_bytes`` of doubles at most on average.
    Of two shards one asks the other, each asks itself.  A shard's graph is built once for each ``asked_together`` vectors of
    the table (building costs about as much as 50,000 queries); queries stream by it.
    """
    spark = prepare(vectors.sparkSession)
    x = F.col("embedding")
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = pick(vectors, "vec_id", "embedding")
    sound = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists(x, lambda c: c != 0), F.lit(False))
    reps = rows.where(sound).groupBy("embedding").agg(F.min(F.col("vec_id").cast("long")).alias("least"), F.count("*").alias("n"))
    reps = checkpoint(reps.withColumn("node", F.monotonically_increasing_id()).withColumn("width", F.size("embedding")))
    total, widest = reps.agg(F.count("*"), F.coalesce(F.max("width"), F.lit(1))).first()
    s = max(shards, -(-total // shard_size), -(-total * 8 * widest // shard_bytes))
    groups = -(-total // asked_together) or 1
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    home = F.pmod(F.xxhash64("node"), F.lit(s)).cast("int")
    stored = reps.withColumn("s", home).withColumn("g", each(groups)).withColumns({"q": F.lit(False), "own": F.lit(True)})
    # half of the ring of shards behind the query's own; of two shards that face each other the first half asks
    asked = reps.withColumn("home", home).withColumn("step", each(s // 2 + 1)).where((F.col("step") < s - s // 2) | (F.col("home") < s // 2))
    asked = asked.withColumn("s", F.pmod(F.col("home") + F.col("step"), F.lit(s)).cast("int")).withColumn("own", F.col("step") == 0)
    asked = asked.withColumn("g", F.pmod(F.xxhash64("node", F.lit(5)), F.lit(groups)).cast("int")).withColumn("q", F.lit(True))
    at = ["width", "s", "g", "q"]
    cols = [*at, "own", "node", "least", "n", "embedding"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, shard = None, [], None

        def flush() -> pa.RecordBatch | None:
            """Build the shard of what is held, or ask it."""
            nonlocal shard
            table = pa.Table.from_batches(held)
            held.clear()
            if not key[3]:
                shard = (key[:3], Shard(table))
            elif shard and shard[0] == key[:3]:  # a shard without vectors answers nothing
                return shard[1].answer(table, least)
            return None

        for batch in batches:
            marks = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1 if len(marks) else []
            for a, b in pairwise([0, *cuts, len(marks)] if len(marks) else []):
                now = tuple(marks[a].tolist())
                if held and (now != key or (key[3] and sum(x.num_rows for x in held) >= _ASKED)):
                    out = flush()
                    if out is not None:
                        yield out
                key = now
                held.append(batch.slice(a, b - a))
        if held:
            out = flush()
            if out is not None:
                yield out
        shard = None
        give_back()

    both = stored.select(cols).unionByName(asked.select(cols))
    found = both.repartition(min(s * groups, 1 << 15), "width", "s", "g").sortWithinPartitions(*at, "node").mapInArrow(work, OUT)
    found = checkpoint(found)
    # a node carries its smallest id and sorts by it, so a component's root tells the component's smallest id
    ends = [F.struct(F.col(f"{c}_least").alias("least"), F.col(c).alias("node")).alias(c) for c in "ab"]
    edges = found.where("a <> b").select(*ends)
    counted = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("found"))
    # a link found from one end only also counts at the other
    pairs = edges.select(F.col("a.node").alias("node"), F.col("b.node").alias("other"))
    pairs = pairs.union(pairs.select("other", "node")).distinct()
    sure = pairs.join(reps.select(F.col("node").alias("other"), "n"), "other").groupBy("node").agg(F.sum("n").alias("sure"))
    roots = components(edges).select("node.node", F.col("root.least").alias("component_id"))
    known = reps.join(roots, "node", "left").join(counted, "node", "left").join(sure, "node", "left").select(
        "embedding", F.coalesce("component_id", "least").alias("component_id"), (F.coalesce(F.greatest("found", "sure"), F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links")
    )
    linked = rows.where(sound).join(known, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
