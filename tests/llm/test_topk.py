import math
import random

import numpy as np

from twinledger.llm import topk

SCHEMA = "vec_id long, embedding array<float>, rank int, label int"


def brute(rows, k, every):
    ok = []
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.append((i, tuple(math.floor(64 * float(np.float32(x))) for x in v)))
    ok = sorted(ok)
    out, done = [], set()
    for i, q in ok:
        if i % every == 0 and i not in done:
            done.add(i)
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def test_top_k(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(6)], 1, 1) for i in range(500)]
    rows += [(i, [0.5, -0.5, 0.25, 0.0, 0.1, 0.1], 1, 1) for i in range(600, 760)]  # ties
    rows += [rows[20], rows[40], rows[600]] + [(800, None, 1, 1), (820, [1.0, None], 1, 1), (840, [float("nan")] * 6, 1, 1), (860, [float("inf")] * 6, 1, 1), (None, [9.0] * 6, 1, 1), (880, [], 1, 1), (900, [0.3, 0.2], 1, 1), (-20, [0.1] * 9, 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for shards, shard, block in ((5, 64, 9), (1, 5000, 5000), (12, 8192, 32768)):
        got = topk.top_k(df, shards=shards, shard=shard, block=block)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, 20, 20)
    few = rows[:8]
    assert sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(few, SCHEMA)).collect()) == brute(few, 20, 20)
    assert topk.top_k(df.limit(0)).count() == 0


def test_shard_search_is_exact_on_hard_cases():
    rng = np.random.default_rng(1)
    for width, spread in ((1, 2), (3, 1), (64, 30), (64, 2)):
        v = rng.integers(-spread, spread + 1, (300, width)).astype(float)
        ids = rng.permutation(300)
        q, own, got = topk.search_shard(v[:50], ids[:50], v, ids, 20)
        for x, me in zip(v[:50], ids[:50]):
            s = v @ x
            want = sorted((-s[i], ids[i]) for i in range(300) if ids[i] != me)[:20]
            on = q == me
            assert [(-a, b) for a, b in want] == list(zip(got[on], own[on]))
