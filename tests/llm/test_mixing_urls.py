import math

from twinledger.llm import mixing, urls

DOCS = "doc_id long, text string, source string, size string"


def fill(sizes, weights=(5, 2, 1), share=1.5, ceiling=2.0):
    """Targets by repeated sharing of the excess."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if ceiling * sizes[s] <= level * w[s]}
        if not full:
            for s in open_:
                target[s] = level * w[s]
            break
        for s in full:
            target[s] = ceiling * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mix(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), f"s{i % 5 if i % 3 else 0}", "x") for i in range(900)]
    rows += [(i, "a b", None, "x") for i in range(1000, 1060)] + [(None, "a b c", "s1", "x"), (7, None, "s1", "x"), (7, "", "only", None), (8, "q r s", "s2", "x"), (8, "q r s", "s2", "x")]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df).collect()
    assert mixing.mix(df).columns == ["doc_id", "text", "source", *mixing.OUT] and len(got) == len(rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    target = fill(sizes)
    taken = {}
    for r in got:
        assert r["size"] == len((r["text"] or "").split()) and r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], target[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in taken.items():
        assert abs(t - target[s]) <= max(0.02 * target[s], 50)
    again = sorted(map(str, mixing.mix(df.repartition(7)).select(*mixing.OUT).collect()))
    assert again == sorted(map(str, mixing.mix(df).select(*mixing.OUT).collect()))
    out = mixing.mixed_rows(df)
    assert out.columns == df.columns and out.count() == sum(r["copies"] for r in got)
    assert mixing.mix(df.limit(0)).count() == 0


def test_urls(spark):
    rules = spark.createDataFrame(urls.RULES, "rule_host string, rule_path string, verdict string")
    listed = spark.createDataFrame(urls.LISTED, "rule_host string, rule_path string")
    cases = {
        None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no scheme/x": ("", "", None, "allow"),
        "http://A.NET/x?y#z": ("a.net", "/x", "net/", "block"), "https://a.example.net/en/1": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "http://net/": ("net", "/", "net/", "block"), "http://a.net": ("a.net", "", None, "allow"), "http://anet/": ("anet", "/", None, "allow"),
        "http://x.example.com/de/": ("x.example.com", "/de/", "example.com/de/", "block"), "http://x.example.com/de": ("x.example.com", "/de", None, "allow"),
        "http://myexample.com/de/": ("myexample.com", "/de/", None, "allow"), "ftp://b.org/fr/q#t://u": ("b.org", "/fr/q", "org/fr/", "allow"),
        "http://www.cheap-pills.example.com/fr/1": ("www.cheap-pills.example.com", "/fr/1", None, "block"),
        "http://spam-farm.example.org/fr/1": ("spam-farm.example.org", "/fr/1", "org/fr/", "allow"), "://?x": ("", "", None, "allow"),
        "http://h/" + "a" * 100000: ("h", "/" + "a" * 100000, None, "allow"),
    }
    rows = [(i, u, "extra") for i, u in enumerate([*cases, *cases])] + [(None, "http://net/", "extra")]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    for blocks in (1, 4096):
        out = urls.judge_urls(df, rules, listed, blocks).collect()
        assert len(out) == len(rows)
        assert all((r.host, r.path, r.rule, r.verdict) == cases[r.url] for r in out)
    assert urls.judge_urls(df, rules.limit(0), listed.limit(0)).where("verdict <> 'allow'").count() == 0
    assert urls.judge_urls(df.limit(0), rules, listed).count() == 0


def test_bloom_has_no_false_negative(spark):
    from pyspark.sql import functions as F

    keys = spark.range(3000).select(F.xxhash64("id").alias("h"))
    words = urls.bloom(keys, 64)
    import numpy as np

    h = np.array([r.h for r in keys.collect()], np.int64)
    block, bits = urls._places(h, 64)
    assert ((words[block[:, None] * 8 + (bits >> 6)] >> (bits & 63).astype(np.uint64)) & np.uint64(1)).all()
