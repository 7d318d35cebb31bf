import numpy as np
import pytest

import corpus_pipeline
from twinledger.llm import pieces, pii, quality
from twinledger.llm.common import labelled_sample

from .test_jaccard import brute_kept
from .test_mixing_urls import fill

SF = "/root/testdata/sf0.01"


def test_stages_on_their_own(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    (_, good), (_, dedup), (_, clean), (_, mixed), (_, encoded) = corpus_pipeline.STAGES
    rows = docs.collect()

    kept = good(spark, docs, SF)
    assert kept.columns == docs.columns
    model = quality.train(labelled_sample(docs, labels, "quality", quality.MODULUS, quality.HELD, quality.SAMPLE))
    words = quality.Words(model.parts)
    z = {r.doc_id: model.bias + (np.mean([words[w] for w in quality.words_of(r.text)]) if r.text.split() else 0) for r in rows}
    want = {i for i, x in z.items() if x >= 0}
    assert {r.doc_id for r in kept.collect()} == want and len(want) < len(rows)

    one = dedup(spark, docs, SF)
    assert one.columns == docs.columns
    assert sorted(r.doc_id for r in one.collect()) == brute_kept([(r.doc_id, r.text) for r in rows])

    safe = clean(spark, docs, SF)
    assert safe.columns == docs.columns
    changed = 0
    for r in safe.collect():
        text = next(x.text for x in rows if x.doc_id == r.doc_id)
        found = pii.base_spans(text) or pii.added_spans([text], pii.field())[0]
        assert (r.text != text) == bool(found) and r.n_chars == len(r.text) and not pii.base_spans(r.text)
        changed += r.text != text
    assert changed > 5

    mix = mixed(spark, docs, SF)
    assert mix.columns == docs.columns
    sizes, took, largest = {}, {}, {}
    for r in rows:
        largest[r.source] = max(largest.get(r.source, 0), len(r.text.split()))
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    for r in mix.collect():
        took[r.source] = took.get(r.source, 0) + len(r.text.split())
    for s, t in fill(sizes).items():
        assert abs(took.get(s, 0) - t) <= largest[s]  # whole documents come no nearer than that

    out = encoded(spark, docs, SF).collect()
    v = pieces.Vocabulary(pieces.read_model())
    assert len(out) == len(rows)
    text = {r.doc_id: r.text for r in rows}
    assert all(r.exact and v.decode(r.pieces) == text[r.doc_id] for r in out)


@pytest.mark.parametrize("n", [0, 200])
def test_run(spark, tmp_path, n):
    for t in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(n).write.parquet(str(tmp_path / f"{t}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "source", "pieces", "log_prob", "log_inclusion", "exact"]
    rows = out.collect()
    assert bool(rows) == bool(n) and all(r.exact for r in rows)
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, rows))


def test_copies_have_encodings_of_their_own(spark):
    rows = [(1, "s", "some words that go two ways"), (2, "s", "other words"), (1, "s", "some words that go two ways"), (3, "t", ""), (3, "t", ""), (None, "t", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in rows) and all(r.exact for r in out)
    one, two = (r.pieces for r in out if r.doc_id == 1)
    assert one != two
    want = {(r.doc_id, r.rank): tuple(r.pieces) for r in pieces.encode(docs.distinct(), k=2).collect()}
    assert {tuple(one), tuple(two)} == {want[1, 1], want[1, 2]}
    # a document taken once is one sample, whatever stands beside it
    alone = pieces.encode(docs.where("doc_id = 2"), k=1).collect()[0]
    assert next((r.pieces, r.log_prob, r.log_inclusion) for r in out if r.doc_id == 2) == (alone.pieces, alone.log_prob, alone.log_inclusion)
