"""Every operator and stage on tables whose extra columns have the operators' own names."""

import corpus_pipeline
from pyspark.sql import functions as F
from twinledger.llm import hnsw, jaccard, mixing, pieces, pii, quality, simhash, templates, topk, toxicity, urls

NAMES = "root best __host __s __at_slot fp key node row rank n src slot place hits probes host_ __key __key_ __quality __label __pii __clean __fp __samples __template".split()


def extra(df, *more):
    return df.select("*", *[F.lit(f"own {n}").alias(n) for n in (*NAMES, *more)])


def same(out, *more):
    """The extra columns still hold what they held."""
    rows = out.select(*NAMES, *more).distinct().collect()
    return [tuple(r) for r in rows] == [tuple(f"own {n}" for n in (*NAMES, *more))]


def test_documents(spark):
    rows = [(i, f"w{i} some words to look at , mail a{i}@b.org or +44 20 7946 {1000 + i} {'x ' * i}", "en", f"s{i % 3}") for i in range(40)]
    rows += [(90, rows[5][1], "en", "s1"), (91, None, None, None), (None, "", "x", "s0")]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = extra(plain)
    labels = extra(spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int"))
    assert same(quality.score(docs, quality.fit(docs, labels)))
    assert quality.score_documents(docs, labels).count() == toxicity.score_documents(docs, labels).count() == len(rows)
    assert simhash.near_duplicates(docs).count() == pii.report(docs).count() == len(rows)
    assert same(pii.find(docs)) and same(pii.redact(docs))
    for keep in (simhash.keep_one, jaccard.keep_one):
        kept = keep(docs)
        assert kept.columns == docs.columns and same(kept) and kept.where("doc_id = 90").count() == 0
    sized = docs.select("*", F.lit("own size").alias("size"), F.lit("own target").alias("target"))
    mixed = mixing.mixed_rows(sized)
    assert mixed.columns == sized.columns and same(mixed, "size", "target")
    out = mixing.mix(sized)
    assert same(out) and out.select(*mixing.OUT).dtypes == mixing.mix(plain).select(*mixing.OUT).dtypes
    encoded = pieces.encode(docs)
    assert "own rank" not in [r["rank"] for r in encoded.select("rank").distinct().collect()]
    assert [tuple(r) for r in encoded.select(*[n for n in NAMES if n != "rank"]).distinct().collect()] == [tuple(f"own {n}" for n in NAMES if n != "rank")]
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, docs, "").columns == docs.columns


def test_pages_and_vectors(spark):
    pages = extra(spark.createDataFrame([(i, f"http://a.net/{i}", f"<nav>m</nav><p>Text {i}</p>") for i in range(20)] + [(None, None, None)], "page_id long, url string, html string"), "template", "salt")
    out = templates.extract(pages)
    assert same(out, "template", "salt") and {r.text for r in out.collect()} == {"", *[f"Text {i}" for i in range(20)]}
    assert same(templates.extract(pages, small=0), "template", "salt")
    rules = spark.createDataFrame(urls.RULES, "rule_host string, rule_path string, verdict string")
    out = urls.judge_urls(pages, rules, rules.limit(0))
    assert same(out) and out.where("verdict = 'block'").count() == 20
    vectors = extra(spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(40)], "vec_id long, embedding array<float>"), "v", "s", "b", "stored", "width", "least")
    assert topk.top_k(vectors).count() == 40 and hnsw.near_duplicates(vectors).count() == 40
