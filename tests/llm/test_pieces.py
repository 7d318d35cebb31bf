import itertools
import random

import numpy as np
import pytest
import sentencepiece

from twinledger.llm import pieces

SCHEMA = "doc_id long, text string, rank string, lang string"


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(pieces.read_model())


def every(text, v):
    """All segmentations of a short text, by plain recursion: {ids: log weight}."""
    weight = {v.part(i).decode(): (i, w) for i, w in enumerate(v.weight) if np.isfinite(w)}

    def go(rest):
        if not rest:
            yield (), 0.0
            return
        for n in range(1, len(rest) + 1):
            if rest[:n] in weight and len(pieces._CHUNK.findall(rest[:n])) == 1:
                i, w = weight[rest[:n]]
                for ids, total in go(rest[n:]):
                    yield (i, *ids), w + total
        if rest[0] not in weight:
            b = rest[0].encode()
            for ids, total in go(rest[1:]):
                yield (*(v.byte[x] for x in b), *ids), len(b) * v.byte_weight + total

    out = dict(go(" " + text))
    z = np.logaddexp.reduce(list(out.values()))
    return {ids: w - z for ids, w in out.items()}


def test_probabilities_are_those_of_all_segmentations(vocabulary):
    for text in ("the", "so on", "a b", "né\nx", "漢x", "x  y"):
        want = every(text, vocabulary)
        got = pieces.sample([text], np.array([7]), vocabulary, len(want) + 5)[0]
        assert {tuple(i.tolist()) for i, _, _ in got} == set(want)
        for ids, p, q in got:
            assert abs(p - want[tuple(ids.tolist())]) < 1e-6 and q == 0.0


def test_order_is_that_of_sampling_without_replacement(vocabulary):
    want = {i: np.exp(p) for i, p in every("the", vocabulary).items()}
    n = 6000
    got = pieces.sample(["the"] * n, np.arange(n), vocabulary, 2)
    first, both = {}, {}
    for (a, _, _), (b, _, _) in got:
        a, b = tuple(a.tolist()), tuple(b.tolist())
        first[a] = first.get(a, 0) + 1
        both[a, b] = both.get((a, b), 0) + 1
    for a, b in itertools.permutations(want, 2):
        p = want[a] * want[b] / (1 - want[a])
        assert abs(both.get((a, b), 0) / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-3
    for a, p in want.items():
        assert abs(first.get(a, 0) / n - p) < 5 * np.sqrt(p / n) + 1e-3
    # weighting by inclusion scores gives every segmentation its own probability
    est = {}
    for f in got:
        for i, p, q in f:
            est[tuple(i.tolist())] = est.get(tuple(i.tolist()), 0) + np.exp(p - q) / n
    assert abs(sum(est.values()) - 1) < 0.05 and all(abs(est.get(a, 0) - p) < 0.05 for a, p in want.items())


def test_round_trip(vocabulary):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "the ", " ", "\n", "é", "漢", "▁", "😀", "\t", "Straße", "", "\0", "x1"]) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    texts += [" lead", "trail ", "  ", "z" * 5000, "word " * 5000]
    for text, found in zip(texts, pieces.sample(texts, np.arange(len(texts)), vocabulary, 3), strict=True):
        assert len({tuple(i.tolist()) for i, _, _ in found}) == len(found) >= 1
        assert all(q <= 1e-9 for _, _, q in found)
        for ids, p, _ in found:
            assert vocabulary.decode(ids.tolist()) == text and p <= 1e-9
            if not text.startswith(" ") and "▁" not in text:
                assert sp.decode(ids.tolist()) == text


def test_rows(spark):
    rows = [(1, "one two three", "x", "en"), (1, "one two three", "x", "en"), (2, None, "x", None), (3, "", "x", "en"), (None, "no key", "x", "en"), (4, "long text " * 30000, "x", "en")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = pieces.encode(df, k=3)
    assert out.columns == ["doc_id", "lang", "rank", "pieces", "log_prob", "log_inclusion", "exact"]
    got = out.collect()
    assert all(r.exact for r in got)
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r["rank"]), []).append(tuple(r.pieces))
    assert len(by[1, 1]) == 2 and len(set(by[1, 1])) == 1 and by[2, 1] == [()] and by[3, 1] == [()] and (3, 2) not in by and (None, 3) in by and (4, 3) in by
    again = {(r.doc_id, r["rank"]): tuple(r.pieces) for r in pieces.encode(df.repartition(5), k=3).collect()}
    assert again == {k: v[0] for k, v in by.items()}
    back = pieces.decode(out).collect()
    assert {(r.doc_id, r.text) for r in back} == {(i, t or "") for i, t, *_ in rows}
    assert pieces.encode(df.limit(0)).count() == 0
