import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import tokenizers
from twinledger.llm import alignment, tokens

ODD = [" ", "  ", "\n", "\t", "a", "'s", "<|endoftext|>", "é", "\xa0", "1", "\0", "▁", "<0x41>", "　", "\x1c", "...", "ﬁ", "日本", "word", "\r\n", "The"]


def odd_texts(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(ODD, k=rnd.randint(0, 12))) for _ in range(n)]


@pytest.fixture(scope="module")
def libraries():
    a = tokenizers.Tokenizer.from_file(tokens.BYTE_BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokens.PIECE_BPE)


def brute(texts, a, b):
    """The contract word by word, one document after the other."""
    letters = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
    back = {chr(c): c for c in letters}
    back |= {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in letters)}
    word = {i: bytes(back[x] for x in w) for w, i in a.get_vocab().items() if w != "<|endoftext|>"}
    piece = lambda i: bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    rows, counts, every = [], Counter(), []
    for t in texts:
        if t:
            ia, ib = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            pa, pb = [word[i] for i in ia], [piece(i) for i in ib]
        if not t or b"".join(pa) != (" " + t).encode() or b"".join(pb) != (" " + t).encode():
            rows.append((0, 0, 0, 0, ""))
            every.append([])
            continue
        spans = lambda parts: list(zip(np.cumsum([0, *map(len, parts)]).tolist(), np.cumsum([*map(len, parts)]).tolist(), strict=False))
        sa, sb = spans(pa), spans(pb)
        links = [(x, y) for x, (p, q) in zip(ia, sa, strict=True) for y, (r, s) in zip(ib, sb, strict=True) if max(p, r) < min(q, s)]
        cuts = sorted({q for _, q in sa} & {s for _, s in sb})
        groups = []
        for lo, hi in zip([0, *cuts], cuts, strict=False):
            part = lambda ids, where: ",".join(str(i) for i, (p, q) in zip(ids, where, strict=True) if lo <= p and q <= hi)  # noqa: B023, E731
            groups.append(f"{part(ia, sa)}|{part(ib, sb)}")
        rows.append((len(ia), len(ib), len(cuts), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        every.append(links)
        counts.update(set(links))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return [(*r, sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links)) for r, links in zip(rows, every, strict=True)]


def test_chunks_give_the_libraries_ids(libraries):
    a, b = libraries
    texts = [t for t in odd_texts(1500) if "▁" not in t] + ["", " ", "x" * 3000, "a b " * 2000]
    for room in (8 << 20, 200):  # with everything kept, and beginning anew all the time
        enc = tokens.Encoder([tokens.ByteBpe(tokens.read(tokens.BYTE_BPE)), tokens.PieceBpe(tokens.read(tokens.PIECE_BPE))], lead=True, room=room)
        for lo, hi in tokens.in_parts(texts, 5000):
            chunks, at = enc(texts[lo:hi])
            for n, want in enumerate(([a.encode(" " + t, add_special_tokens=False).ids if t else [] for t in texts[lo:hi]], b.encode(texts[lo:hi]))):
                ids, size = enc.ids(n, chunks)
                cut = np.concatenate(([0], np.cumsum(size)))[at]
                assert [ids[x:y].tolist() for x, y in zip(cut[:-1], cut[1:], strict=True)] == want


def test_align(spark, libraries):
    base = ["the cat sat on the mat", "The unbelievable antidisestablishmentarianism!", "naïve café – 日本語 and <0x41>", "the cat sat on the mat", "a\nb  c\t d", "x" * 700]
    texts = [*base, None, "", " ", "▁ literal", *odd_texts(60, 2), "long text of words that go on " * 60]
    docs = spark.createDataFrame([(i if i != 5 else None, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, pairs string")
    want = sorted(map(str, zip([i if i != 5 else None for i in range(len(texts))], *zip(*brute(texts, *libraries), strict=True), strict=True)))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    for table in (alignment.TABLE, 0):  # by a table in every task, and by the join
        got = alignment.align(docs.repartition(3), table=table)
        assert got.columns == names
        assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert alignment.align(docs.limit(0)).count() == 0
    assert alignment.align(docs.where("text is null")).first()[1:] == (0, 0, 0, 0, "", 0, 0)


def test_lockstep_lanes():
    rnd = np.random.default_rng(3)
    ends, docs = [[], []], [[0], [0]]
    byte = 0
    for _ in range(20):
        size = int(rnd.integers(1, 400))
        for n in (0, 1):
            inner = np.sort(rnd.choice(np.arange(1, size), int(rnd.integers(0, size)), replace=False)) if size > 1 else np.zeros(0, int)
            ends[n] += [*(byte + inner).tolist(), byte + size]
            docs[n].append(len(ends[n]))
        byte += size
    a, b, da = np.array(ends[0]), np.array(ends[1]), np.array(docs[0])
    whole = alignment.lockstep(a, b, da, lane=10**6)
    for lane in (1, 3, 64):
        for x, y in ((0, 1), (2, 3)):
            got, want = alignment.lockstep(a, b, da, lane=lane), whole
            assert sorted(zip(got[x].tolist(), got[y].tolist(), strict=True)) == sorted(zip(want[x].tolist(), want[y].tolist(), strict=True))
    begin = lambda e: np.concatenate(([0], e[:-1]))
    over = np.maximum(begin(a)[:, None], begin(b)) < np.minimum(a[:, None], b)
    links = {(int(i), int(j)) for i, j in zip(*np.nonzero(over), strict=True)}
    assert links == set(zip(whole[0].tolist(), whole[1].tolist(), strict=True)) and len(links) == len(whole[0])
