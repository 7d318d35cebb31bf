import random
import re

import xxhash

from twinledger.llm import simhash

DOCS = "doc_id long, text string, lang string"


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    if not words:
        return 0
    n = max(1, len(words) - 3)
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > n)


def brute_components(fps):
    """fps: {fp: least id}"""
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = list(fps)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for f, i in fps.items():
        r = find(f)
        least[r] = min(least.get(r, i), i)
    return {f: least[find(f)] for f in fps}


def test_fingerprint_is_the_plain_one():
    rng = random.Random(3)
    texts = ["", " \t\n", "One", "a b c", "A b\x0bC d", "x " * 70000, "naïve Ünï ★ " * 9, "ÀB cÉ d e f"]
    texts += [" ".join(rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    for t in texts:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_every_near_pair_meets_under_some_key():
    rng = random.Random(5)
    for _ in range(4000):
        x = 0
        for b in rng.sample(range(64), rng.randint(1, 4)):
            x |= 1 << b
        import numpy as np

        assert any(x & m == 0 and simhash._linked(np.array([x], np.uint64), s)[0] for s, m in simhash.KEYS)


def test_components_of_chains_and_dense_groups(spark):
    rng = random.Random(7)
    fps = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 40, 150])):
            x = base
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            fps.add(x)
            if rng.random() < 0.2:
                base = x  # chains
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    want = brute_components({f: signed(f) for f in fps})
    for block in (16, 2048):
        from twinledger.llm.components import components

        got = {r["node"]: r["root"] for r in components(simhash.links(frame, block)).collect()}
        assert {signed(f): r for f, r in want.items() if list(want.values()).count(r) > 1} == got


def test_rows(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    near = long.replace("w77 ", "other ")
    rows = [(5, long, "en"), (9, near, "en"), (3, None, None), (8, "", "x"), (None, long, "en"), (7, "one two", "en"), (7, "one two", "en"), (7, "Three", "en")]
    out = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    want = brute_components({brute_fingerprint(t): min((i for i, u, _ in rows if i is not None and brute_fingerprint(u) == brute_fingerprint(t)), default=99) for _, t, _ in rows})
    assert sorted(map(str, ((r.doc_id, r.fingerprint, r.component_id) for r in out))) == sorted(str((i, f"{brute_fingerprint(t):016x}", want[brute_fingerprint(t)])) for i, t, _ in rows)
    kept = simhash.keep_one(spark.createDataFrame(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "lang"]
    assert sorted((r.doc_id, r.text[:9] if r.text else r.text) for r in kept.collect()) == [(3, None), (5, long[:9]), (7, "Three"), (7, "one two")]
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    assert simhash.keep_one(spark.createDataFrame([], DOCS)).count() == 0


def test_against_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fp = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    least = {}
    for i, f in fp.items():
        least[f] = min(least.get(f, i), i)
    want = brute_components(least)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{f:016x}", want[f]) for i, f in fp.items()}
