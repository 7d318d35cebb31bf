import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import tokenizers
from twinledger.llm import packing, tokens

from .test_alignment import odd_texts


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(tokens.BYTE_BPE)


def check(rows, want, window=2048):
    """Every id in one piece, sequences without gaps; returns the share of padding and the number of cut rests."""
    docs, sequences, cuts = defaultdict(list), defaultdict(list), 0
    for r in rows:
        assert r["length"] > 0
        docs[r["doc_id"], r["doc_tokens"]].append(r)
        sequences[r["sequence_id"]].append(r)
    found = []
    for (doc, n), pieces in docs.items():
        copies = sum(p["start"] == 0 for p in pieces)
        by_place = defaultdict(int)
        for p in pieces:
            by_place[p["start"]] += 1
        assert sum(p["length"] for p in pieces) == copies * n
        for ids in (x for d, x in want if d == doc and len(x) == n):
            mine = [p for p in pieces if zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"]]
            assert {p["start"] for p in mine} >= {0} and sum(p["length"] for p in mine) >= n
        found += [(doc, n)] * copies
        cuts += len(pieces) - copies * (n // window + (n % window > 0))
    assert sorted(map(str, found)) == sorted(str((d, len(x))) for d, x in want)
    pad = 0
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window and all(p["tier"] == at for p in pieces) and len({p["step_id"] for p in pieces}) == 1
        pad += 0 if at & (at - 1) == 0 else window - at
    return pad, cuts


def test_pack(spark, library):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choices(["one", "two", "three", "pack", "windows", "étoile"], k=int(rnd.lognormvariate(5, 1.3)))) for _ in range(300)]
    texts += [None, "", "x" * 30000, "a <|endoftext|>b", "word " * 9000, *odd_texts(120, 5), texts[3], texts[3]]
    ids = [i if i not in (7, 9) else None for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, step_id int")
    want = [(i, np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for i, t in zip(ids, texts, strict=True)]
    for parts, block in ((1, 1 << 20), (5, 20_000), (1, 5000)):
        rows = packing.pack(docs.repartition(parts), block=block).collect()
        pad, cuts = check(rows, want)
        assert pad == 0 and cuts < 0.25 * len(texts)
        if parts == 1:
            steps = defaultdict(dict)
            for r in rows:
                steps[r["step_id"], r["tier"]][r["sequence_id"]] = r["tier"]
            assert all(sum(s.values()) <= 1 << 15 for s in steps.values())
    assert any(r["tier"] < 1024 for r in rows) and len({r["tier"] for r in rows}) > 4
    small = packing.pack(docs, window=128)
    assert check(small.collect(), want, 128)[0] == 0
    assert sorted(map(str, packing.pack(docs).collect())) == sorted(map(str, packing.pack(docs).collect()))
    assert packing.pack(docs.limit(0)).count() == 0 and packing.pack(docs.where("text is null")).count() == 1
    with pytest.raises(ValueError):
        packing.pack(docs, window=1000)


def test_block_is_full():
    rnd = random.Random(6)
    tiers = packing.tiers_of(2048)
    for _ in range(200):
        pieces = [(k, 0, rnd.choice([rnd.randint(1, 2047), rnd.randint(1, 60), rnd.randint(1500, 2047)])) for k in range(rnd.randint(0, 80))]
        full, left = packing.pack_block(pieces, tiers)
        full += packing.powers(left)
        assert all(sum(p[2] for p in w) == t for t, w in full) and sum(p[2] for p in left) < 2048
        spans = defaultdict(list)
        for _, w in full:
            for doc, start, size in w:
                spans[doc].append((start, size))
        for doc, _, n in pieces:
            at = 0
            for start, size in sorted(spans[doc]):
                assert start == at
                at += size
            assert at == n
