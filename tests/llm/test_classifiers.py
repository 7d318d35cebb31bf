import random
import zlib

import numpy as np
import pytest

from twinledger.llm import quality, toxicity

SF = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, score string"


def model(weights=None):
    rng = np.random.default_rng(2)
    return toxicity.Model(rng.normal(0, 1.5, toxicity.BUCKETS) if weights is None else weights, np.array([[0.5, -2.0], [-1.0, 0.3]]), -1.5, np.array([0.1, 0.5, 0.4, -0.1]))


def brute_marginals(scores, m):
    """Sums over all paths of one text, by the plain recursions."""
    psi = np.stack([np.ones(len(scores)), np.exp(scores)], axis=1)
    a = np.exp(m.moves)
    f, b = np.zeros_like(psi), np.ones_like(psi)
    for t in range(len(psi)):
        f[t] = psi[t] * (np.array([1, np.exp(m.first)]) if t == 0 else f[t - 1] @ a)
        f[t] /= f[t].sum()
    for t in range(len(psi) - 2, -1, -1):
        b[t] = a @ (psi[t + 1] * b[t + 1])
        b[t] /= b[t].sum()
    p = f * b
    return (p / p.sum(axis=1, keepdims=True))[:, 1]


def test_marginals_are_those_of_the_plain_recursions():
    rng = np.random.default_rng(4)
    m = model()
    sizes = np.array([0, 1, 5, 0, 300, 2, 0])
    scores = rng.normal(-1, 3, sizes.sum())
    scores[50:200] = 6.0  # a long toxic run
    got = np.split(toxicity.marginals(scores, sizes, m), np.cumsum(sizes)[:-1])
    for own, p in zip(np.split(scores, np.cumsum(sizes)[:-1]), got, strict=True):
        if len(own):
            np.testing.assert_allclose(p, brute_marginals(own, m), rtol=1e-9, atol=1e-12)


def test_toxicity_rows(spark):
    m = model(np.where(np.arange(toxicity.BUCKETS) % 7 == 0, 4.0, -0.5))
    long = "plain words here " * 40000
    rows = [(1, None, "x"), (None, "", "x"), (2, "İstanbul BAD bad word ünï", None), (2, "İstanbul BAD bad word ünï", None), (3, long, "x")]
    out = toxicity.tag(spark.createDataFrame(rows, DOCS), m).collect()
    assert len(out) == 5
    for r in out:
        assert 0 <= r.toxicity <= 1
        text = r.text or ""
        own = [(t.start(), t.end(), w) for t, w in zip(toxicity.TOKEN.finditer(text), toxicity.tokenize(text), strict=True)]
        p = brute_marginals(np.array([m.weights[toxicity.feature_ids(w)].sum() for _, _, w in own]), m) if own else []
        covered = {i for s in r.toxic_spans for i in range(s.start, s.end)}
        for (a, b, _), q in zip(own[:2000], p, strict=False):
            assert (a in covered) == (q >= 0.5) or abs(q - 0.5) < 1e-9
    assert toxicity.tag(spark.createDataFrame([], DOCS), m).count() == 0


@pytest.mark.parametrize("what, modulus, held", [("quality", 3, 1), ("toxic", 5, 0)])
def test_held_out_rows(spark, what, modulus, held):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    module = quality if what == "quality" else toxicity
    got = {r.doc_id: r for r in module.score_documents(docs, labels).collect()}
    assert len(got) == docs.count()
    truth = {r.doc_id: r[what] for r in labels.collect()}
    right = [got[i].predicted == y for i, y in truth.items() if zlib.crc32(str(i).encode()) % modulus == held]
    assert len(right) > 500 and sum(right) / len(right) > 0.95
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % modulus == held) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    # labels of held-out rows change nothing
    from pyspark.sql import functions as F

    flipped = labels.withColumn(what, F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == held, 1 - F.col(what)).otherwise(F.col(what)))
    again = {r.doc_id: r.score for r in module.score_documents(docs, flipped).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_quality_is_the_plain_definition(spark):
    """Mean of a word's n-gram vectors, mean over the document's words, softmax: all written out, without the folding."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["dog", "Dog", "running", "naïve", "漢字", "x"]) + rng.choice(["", "s", "!!"]) for _ in range(rng.randint(1, 20))), "x") for i in range(60)]
    rows += [(90, None, "x"), (91, " \t", "x"), (92, "same same same", "x")]
    examples = [(t, i % 2) for i, t, _ in rows[:60]]
    vectors, layer, bias = quality.learn(examples, epochs=3)

    def bucket(name):
        return zlib.crc32(name.encode()) % quality.BUCKETS

    def plain(text):
        words = (text or "").split()
        parts = []
        for w in words:
            marked = f"<{w}>"
            grams = sorted({marked[i : i + n] for n in (3, 4) for i in range(len(marked) - n + 1)})
            parts.append(np.mean([vectors[bucket("=" + w)], *[vectors[bucket(g)] for g in grams]], axis=0, dtype=np.float64))
        same = "\x00same"
        marked = f"<{same}>"
        again = np.mean([vectors[bucket("=" + same)], *[vectors[bucket(g)] for g in sorted({marked[i : i + n] for n in (3, 4) for i in range(len(marked) - n + 1)})]], axis=0, dtype=np.float64)
        parts += [again] * sum(a == b for a, b in zip(words, words[1:]))
        out = layer.astype(float) @ (np.mean(parts, axis=0) if parts else np.zeros(quality.DIM)) + bias
        p = np.exp(out - out.max())
        return p[1] / p.sum()

    got = {r.doc_id: r.score for r in quality.score(spark.createDataFrame(rows, DOCS), quality.train(examples, epochs=3), "score").collect()}
    for i, t, _ in rows:
        assert abs(got[i] - plain(t)) < 1e-5, (i, t)
    assert max(got.values()) - min(got.values()) > 0.01


def test_quality_rows(spark):
    rng = random.Random(1)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma"]) + str(rng.randint(0, 9)) for _ in range(30)) for _ in range(80)]
    bad = [" ".join(["SPAM!!"] * 30) for _ in range(40)]
    m = quality.train([(t, 1) for t in good] + [(t, 0) for t in bad] + [("", 1)])
    rows = [(1, None, "x"), (None, " \n", "x"), (2, good[0], "x"), (2, good[0], "x"), (3, bad[0] * 900, "x"), (4, "y" * 300000, "x")]
    out = {(r.doc_id, (r.text or "")[:5]): r.score for r in quality.score(spark.createDataFrame(rows, DOCS), m, "score").collect()}
    assert out[2, good[0][:5]] > 0.5 > out[3, "SPAM!"] and out[1, ""] == out[None, " \n"]
    assert quality.score(spark.createDataFrame([], DOCS), m).count() == 0
    assert quality.train([]).bias == 0
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score_documents(docs, labels).collect()} == {0.5}
    assert toxicity.score_documents(docs, labels).count() == 6
