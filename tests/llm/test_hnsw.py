import math
import os
import random

import numpy as np
import pytest

from twinledger.llm import hnsw

TABLE = "/root/testdata/check_s/embeddings.parquet"
SCHEMA = "vec_id long, embedding array<float>, kept string"


def brute(rows, least=0.95):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    root = list(range(len(ok)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(ok)
    for a in range(len(ok)):
        for b in range(a):
            u, v = ok[a][1], ok[b][1]
            if len(u) == len(v) and u @ v / math.sqrt(u @ u) / math.sqrt(v @ v) >= least:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(ok):
        low[find(k)] = min(low.get(find(k), i), i)
    return sorted((i, links[k], low[find(k)], i == low[find(k)]) for k, (i, _) in enumerate(ok))


def made(seed, n):
    rng = random.Random(seed)
    rows = []
    while len(rows) < n:
        base = [rng.gauss(0, 1) for _ in range(16)]
        for _ in range(rng.choice([1, 1, 1, 2, 5, 60])):
            rows.append((len(rows) + 3, [x + rng.gauss(0, 0.03) for x in base], "x"))
    return rows


def test_graph_recall():
    rng = np.random.default_rng(5)
    u = rng.normal(size=(1500, 32))
    u /= np.linalg.norm(u, axis=1)[:, None]
    g = hnsw.Graph(u)
    s = u[:200] @ u.T
    ids, _ = g.search(u[:200].astype(np.float32), 64)
    assert np.mean([len(np.intersect1d(ids[k][:10], np.argsort(-s[k])[:10])) / 10 for k in range(200)]) > 0.9
    for n in (0, 1, 2, 40):
        ids, _ = hnsw.Graph(u[:n]).search(u[:3].astype(np.float32), 8) if n else (np.zeros((0, 0)), None)
        assert n == 0 or set(ids[0][ids[0] >= 0]) <= set(range(n))


def test_links_and_components(spark):
    rows = made(4, 700)
    rows += [rows[5], rows[5], (1, rows[5][1], "x"), (2, [2 * x for x in rows[9][1]], "x")]
    odd = [(9001, None, "x"), (9002, [], "x"), (9003, [0.0] * 16, "x"), (9004, [float("nan")] * 16, "x"), (9005, [1.0, None], "x"), (9006, [float("inf")] * 16, "x")]
    lone = [(9007, [1.0, 2.0], "x"), (9008, [1e-30, 2e-30], "x")]
    df = spark.createDataFrame(rows + odd + lone + [(None, rows[0][1], "x")], SCHEMA)
    out = hnsw.near_duplicates(df)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = [tuple(r) for r in out.collect()]
    assert (None, 0, None, True) in got and {(i, 0, i, True) for i, *_ in odd} <= set(got)
    want = brute(rows + lone)
    got = sorted(r for r in got if r[0] is not None and not 9001 <= r[0] <= 9006)
    assert len(got) == len(want) and sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want)
    assert all(g[1] <= w[1] and g[0] == w[0] for g, w in zip(got, want, strict=True))
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.99 * len(want)
    assert hnsw.near_duplicates(df.limit(0)).count() == 0


def test_recall_on_a_dense_group(spark):
    """10,200 vectors, 600 of them one dense group, dealt over shards of which some are asked in several groups."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(9600, 24))
    v[4800:5400] = v[:600] + rng.normal(0, 0.15, (600, 24))  # single links
    dense = rng.normal(size=24) + rng.normal(0, 0.1, (600, 24))
    v = np.concatenate([v, dense]).astype(np.float32)
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(8)
    got = sorted(tuple(r) for r in hnsw.near_duplicates(frame, shards=3, asked_together=4000).collect())
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    links = np.concatenate([(u[i : i + 1000] @ u.T >= 0.95).sum(axis=1) - 1 for i in range(0, len(u), 1000)])
    found = np.array([r[1] for r in got])
    assert (found <= links).all() and found.sum() >= 0.999 * links.sum() > 300000
    few = (links > 0) & (links < 20)
    assert few.sum() > 300 and found[few].sum() >= 0.98 * links[few].sum()


@pytest.mark.skipif(not os.path.exists(TABLE), reason="needs a table with near copies")
def test_recall_on_the_table(spark):
    e = spark.read.parquet(TABLE)
    got = sorted(tuple(r) for r in hnsw.near_duplicates(e).collect())
    rows = e.select("vec_id", "embedding").toPandas().sort_values("vec_id")
    v = np.stack(rows["embedding"]).astype(float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    links = (v @ v.T >= 0.95).sum(axis=1) - 1
    assert sum(r[1] for r in got) >= 0.99 * links.sum() > 0
    assert all(r[1] <= n for r, n in zip(got, links, strict=True))
