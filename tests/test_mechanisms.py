import gzip
import random

import pytest
from pyspark.sql import functions as F

from twinledger.operators import cells, compare, directory, export, features, monitor, pairing, patterns, reports, rules, segments, summary
from twinledger.plans import pairs
from twinledger.plans.queries_text import charsets
from twinledger.sources import charset, pages, parts, ranges, scan

LINES = "pair_id string, seq long, value string"


def lines(spark, text, pair="p"):
    return spark.createDataFrame([(pair, i, v) for i, v in enumerate(text.split("\n"))], LINES)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- virtual columns ----


def dynamic(spark):
    a = scan.scan_delimited(lines(spark, "k1 | ~~1Bd~~1Cx\nk2 | ~~1Bq\nk3 | ~~zz"))[0]
    b = scan.scan_delimited(lines(spark, "k1 | ~~1C9~~1Bd\nk3 | ~~zz\nk4 | -~~1B7"))[0]
    about = spark.createDataFrame([("p", 1, "107", "MSG")], "pair_id string, col int, label string, dyn_name string")
    items = spark.createDataFrame([("MSG", "1B", "名")], "dyn_name string, item_code string, item_name string")
    return compare.keyed_compare_dynamic(a, b, [0], [1], about=about, items=items)


def test_virtual_columns_everywhere(spark):
    rows, registry = dynamic(spark)
    assert {(r.k, r.label, r.name) for r in registry.collect()} == {("1B", "107-1B", "107-1B（名）"), ("1C", "107-1C", "107-1C"), ("zz", "107-zz", "107-zz"), ("#1", "107-1", "107-1")}
    assert {tuple(r) for r in cells.registry_of(rows).collect()} == {(r.pair_id, r.idx, r.c, r.k, r.label, r.name) for r in registry.collect()}
    (f,) = export.export_diff_fields(rows).collect()
    assert (f.key, f.label, f.name, f.a, f.b) == ("k1", "107-1C", "107-1C", "x", "9")
    full = {(r.key, r.line): r for r in export.export_full_csv(rows).collect()}
    assert full["k1", 0].diff == "107-1C；" and list(full["k1", 1]["values"])[0] == "k1"
    # in the order of their numbers: k1's two, then those of k3, k4 and k2
    at = [r.k for r in registry.orderBy("idx").collect()]
    assert dict(zip(at, full["k1", 0].virtual, strict=True))["1C"] == "x" and dict(zip(at, full["k1", 1].virtual, strict=True))["1C"] == "9"
    assert dict(zip(at, full["k4", 0].virtual, strict=True)) == {"1B": "7", "1C": "", "zz": "", "#1": "-"}
    shown = export.full_csv_columns(export.export_full_csv(rows), 2, ["KEY"], [r.name for r in registry.orderBy("idx").collect()])
    assert shown.columns[:5] == ["键值", "状态", "差异栏位", "KEY(1)", "栏位2"] and "107-1B（名）" in shown.columns
    assert {r.detail for r in export.export_diff_records(rows).collect()} >= {"[栏位不一致 @107-1C] A:'x' B:'9'"}
    pairs = spark.createDataFrame([("p", "b", 1, "N", "*", "a", "b", "t")], "pair_id string, batch string, round int, nickname string, glob string, file_a string, file_b string, team string")
    assert {(r.column, r.content) for r in export.export_cases(rows, pairs).collect()} == {("107-1C", "A:'x' B:'9'"), ("0", "A:'k2 | ~~1Bq'"), ("0", "B:'k4 | -~~1B7'")}
    (x,) = features.diff_features(rows).collect()
    assert (x.label, x.empty_a, x.empty_b, x.top_patterns) == ("107-1C", 0, 0, "x>9=1")
    (s,) = features.cell_diff_spans(rows).collect()
    assert [t.tag for t in s.spans] == ["delete", "insert"]


# ---- directories ----


def test_directory_with_rules_as_data(spark):
    sides = {
        "a": {"one.txt": "k1 | x | y\nk2 | z\n|||||RecNum=2", "two.csv": "1,a,b\n2,c,d", "three.txt": "p;q\np;q", "inc.txt": "1 | A\n2 | B", "only.txt": "x", "none.txt": "1 | A"},
        "b": {"one.txt": "k1 | x | Y\nk2 | Z\n|||||RecNum=9", "two.csv": "9,a,b\n2,c,D\nx", "three.txt": "p;q\nr", "inc.txt": "1 | A\n2 | C\n3 | A", "none.txt": "1 | B"},
    }
    text = "\n".join(["ONE:one.*:KEYSEQ=1:IGNORESEQ=3", "TWO:*.csv:KEYSEQ=2/3:DELIM=,:OMITSEQ=1", "THREE:thr??.txt:DELIM=;", "INC:inc.txt:KEYSEQ=1:ADDMOD=2", "NONE:none.txt:KEYSEQ=1:ADDMOD=2", "LATE:one.txt:KEYSEQ=2", "BAD:x:PRISEQ=9"])
    given = spark.createDataFrame([("f", 0, i, x) for i, x in enumerate(text.split("\n"))], "file string, file_order int, line_no int, value string")
    frame = lambda side: spark.createDataFrame([(n, i, v) for n, t in sides[side].items() for i, v in enumerate(t.split("\n"))], LINES)
    files = lambda side: spark.createDataFrame([(n, f"/{side}/{n}") for n in sides[side]], "name string, path string")
    conds = spark.createDataFrame([("INC", ["A, x"]), ("NONE", ["Q"]), ("ONE", ["A"])], "nickname string, conds array<string>")
    pairs = directory.plan_pairs(files("a"), files("b"), rules.effective_rules(rules.rules_from_lines(given))[0], conds)
    assert {(r.pair_id, r.nickname) for r in pairs.collect()} == {("one.txt", "ONE"), ("two.csv", "TWO"), ("three.txt", "THREE"), ("inc.txt", "INC"), ("none.txt", "NONE")}
    out = directory.compare_directories(frame("a"), frame("b"), pairs)
    got = sorted((r.pair_id, r.key.replace("\x1f", "/"), r.status, tuple(r.diff_cols)) for r in out.results.collect())
    assert got == [
        ("inc.txt", "1", "equal", ()), ("inc.txt", "3", "unmatched_b", ()), ("one.txt", "RecNum", "diff", (0,)), ("one.txt", "k1", "equal", ()), ("one.txt", "k2", "diff", (1,)),
        ("three.txt", "p/q", "equal", ()), ("three.txt", "r", "unmatched_b", ()), ("two.csv", "a/b", "equal", ()), ("two.csv", "c/D", "unmatched_b", ()), ("two.csv", "c/d", "unmatched_a", ()),
    ]
    s = {r.pair_id: r for r in out.summary.collect()}
    assert [(s[n].before_a, s[n].after_a, s[n].before_b, s[n].after_b, s[n].incremental) for n in ("inc.txt", "none.txt")] == [(2, 1, 3, 2, "增量"), (1, 0, 1, 0, "增量-空文本")]
    assert s["one.txt"].trailer_rows_a == 1 and s["two.csv"].malformed_b == 1 and s["two.csv"].incremental is None


# ---- features ----


def test_shapes_and_deltas(spark):
    cases = [("20240102123456", "2024/1/2"), ("2024年1月2日", "2024-01-02 10:00"), ("2024.01.02", "20240102"), ("1e5", "-.5E+2"), ("1e", "1"), (" 7. ", "+7")]
    rows = [("p", str(i), "diff", "data", ["k", a], ["k", b], [1], (0, i)) for i, (a, b) in enumerate(cases)]
    schema = "pair_id string, key string, status string, section string, a_cols array<string>, b_cols array<string>, diff_cols array<int>, seq struct<part:int,seq:long>"
    (r,) = features.diff_features(spark.createDataFrame(rows, schema)).collect()
    assert (r.date_pairs, r.numeric_pairs) == (2, 2)
    big = [(f"{10**24 + i}", f"{10**24 + i + 70}") for i in range(4)] + [("1e3", "1070"), ("1.0", "3")]
    rows = [("p", str(i), "diff", "data", ["k", a], ["k", b], [1], (0, i)) for i, (a, b) in enumerate(big)]
    assert [tuple(x) for x in features.numeric_delta_mode(spark.createDataFrame(rows, schema)).collect()] == [("p", 1, "+70", 5)]
    rows = [("p", str(i), "unmatched_b" if i % 2 else "unmatched_a", "data", None if i % 2 else [str(i)], [str(i)] if i % 2 else None, [], (1 - i % 2, i)) for i in range(30)]
    assert [x.key for x in features.one_sided_samples(spark.createDataFrame(rows, schema)).orderBy("n").collect()] == [str(i) for i in range(1, 20, 2)]


def plain_tags(a, b):
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    tags, i, j = [], 0, 0
    while i < n and j < m:
        tag = "equal" if a[i] == b[j] else "delete" if best[i + 1][j] >= best[i][j + 1] else "insert"
        tags.append([tag, 1])
        i, j = i + (tag != "insert"), j + (tag != "delete")
    return [*tags, ["delete", n - i], ["insert", m - j]]


def test_spans_by_bits():
    rng = random.Random(1)
    text = lambda: "".join(rng.choices("ab日 c", k=rng.randint(0, 140)))
    pairs = [(text(), text()) for _ in range(150)] + [("", ""), ("a", ""), ("", "b"), ("same", "same"), ("x" * 300, "y" * 90), ("😀a", "a😀")]
    assert features.opcodes(pairs) == [features._spans(plain_tags(a, b)) for a, b in pairs]
    assert [t["tag"] for t in features.opcodes([("ab" * 200 + "x", "ab" * 200 + "yz")], 100)[0]] == ["equal", "delete", "insert"]


# ---- files ----


def test_ranges_give_the_same_records(spark, tmp_path):
    rng = random.Random(7)
    want, raw = [], b""
    for i in range(400):
        wide = "".join(rng.choices("Ċ文a\x0b字", k=6))
        want.append(f"{i} | {wide} | 客")
        raw += str(i).encode() + b" | " + wide.encode("utf-16-be") + b" | " + "客".encode("gb18030") + (b"\r\n" if i % 3 else b"\n")
    (tmp_path / "plain.txt").write_bytes(raw)
    (tmp_path / "whole.txt.gz.000000001").write_bytes(gzip.compress(raw[:5000]) + gzip.compress(raw[5000:]))
    (tmp_path / "empty.txt").write_bytes(b"")
    old = {k: spark.conf.get(k, None) for k in scan.SETTINGS}
    for k, v in scan.SETTINGS.items():
        spark.conf.set(k, v)
    try:
        for size in (1 << 20, 997, 331):
            got = ranges.read_mixed(spark, str(tmp_path), "gb18030", " | ", {1: 6}, size=size, piece=64)
            by_file = {}
            for r in got.collect():
                by_file.setdefault(r.file_path.rsplit("/", 1)[1], []).append((r.seq, r.value))
            assert {n: [v for _, v in sorted(x)] for n, x in by_file.items()} == {"plain.txt": want, "whole.txt.gz.000000001": want}
            assert all([s for s, _ in sorted(x)] == list(range(400)) for x in by_file.values())
        (tmp_path / "plain.txt").write_bytes(b"\xef\xbb\xbfx")
        assert {r.file_path.rsplit("/", 1)[1]: r.encoding for r in charset.detect_encoding(spark, str(tmp_path)).collect()}["plain.txt"] == "utf-8-sig"
        host = tmp_path / "host"
        host.mkdir()
        (host / "f").write_bytes("one\ntwo\n".encode("cp037").replace(b"\x15", b"\x25") + "three\x85four".encode("cp037"))
        assert [r.value for r in scan.scan_lines(spark, str(host), "cp037").orderBy("seq").collect()][:2] == ["one", "two"]
        assert ranges.host_table(spark, "cp1047")[0xAD] == "[" and len(ranges.host_table(spark, "cp1047")) == 256
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_parts_are_files(spark, tmp_path):
    rows = spark.createDataFrame([("p/1", i, f'say "{i}",\nx') for i in range(7)], "pair_id string, seq long, v string")
    cut = export.export_parts(rows, "seq", size=3).withColumn("line", export.csv_line(F.col("seq").cast("string"), F.col("v")))
    pairs = spark.createDataFrame([("p/1",), ("none",)], "pair_id string")
    parts.write_parts(cut, str(tmp_path / "out"), ["键", 'a"b'], [F.col("seq")], pairs)
    files = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert files == ["none.00000.csv", "p_1.00000.csv", "p_1.00001.csv", "p_1.00002.csv"]
    head = "﻿键,\"a\"\"b\"\r\n"
    assert (tmp_path / "out" / "none.00000.csv").read_bytes().decode() == head
    assert (tmp_path / "out" / "p_1.00001.csv").read_bytes().decode() == head + "".join(f'{i},"say ""{i}"",\nx"\r\n' for i in (3, 4, 5))
    broken = cut.withColumn("line", F.when(F.col("seq") == 6, F.raise_error(F.lit("no"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="no"):
        parts.write_parts(broken, str(tmp_path / "bad"), ["k"], [F.col("seq")])
    assert not [p for p in (tmp_path / "bad").rglob("*")] if (tmp_path / "bad").exists() else True


def test_pages_read_only_their_files(spark, tmp_path):
    rows = spark.createDataFrame([("p" if i % 4 else "q", str(i), "diff" if i % 3 else "equal", "data", i) for i in range(4000)], "pair_id string, key string, status string, section string, seq long")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small ranges stay apart
    try:
        pages.write_paged(rows, str(tmp_path / "r"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    mine = [i for i in range(4000) if i % 4]
    every = len(spark.read.parquet(str(tmp_path / "r" / "rows")).inputFiles())
    for status, want in ((None, mine), ("diff", [i for i in mine if i % 3])):
        for at in (0, 1234, len(want) - 5, len(want) + 3):
            page = pages.read_page(spark, str(tmp_path / "r"), "p", at, 10, status)
            assert [int(r.key) for r in page.collect()] == want[at : at + 10]
            assert len(page.inputFiles()) <= 2 < every or at > len(want)
            assert {r.total for r in page.collect()} <= {len(want)}


# ---- summaries ----


def test_monitor_gives_few_rows_to_the_shuffle(spark):
    rng = random.Random(2)
    text = [f"v{rng.randint(0, 400)}" for _ in range(6000)]
    data = spark.createDataFrame([("p", i, [v, str(i % 3)]) for i, v in enumerate(text)], "pair_id string, seq long, cols array<string>").repartition(5)
    rows = data.select("pair_id", F.lit(0).alias("col"), "seq", F.get("cols", F.lit(0)).alias("value"))
    assert rows.mapInArrow(monitor.first_places(21), rows.schema).count() <= 5 * 21
    fields = spark.createDataFrame([("p", 0), ("p", 1), ("p", 5)], "pair_id string, col int")
    got = {r.col: (list(r["values"]), r.truncated) for r in monitor.monitor_values(data, fields, 20).collect()}
    assert got == {0: (list(dict.fromkeys(text))[:20], True), 1: (["0", "1", "2"], False), 5: ([""], False)}


def test_first_keys_to_repeat_from_any_prefix(spark):
    rng = random.Random(4)
    rows = [(p, i, [str(rng.randint(0, n))]) for p, n in (("a", 5), ("b", 10**6), ("c", 300)) for i in range(500)] + [("b", 500, ["x"]), ("b", 501, ["x"]), ("d", 0, [])]
    data = spark.createDataFrame(rows, "pair_id string, seq long, cols array<string>")
    want = set()
    for p in "abc":
        seen, top = {}, []
        for q, _, cols in rows:
            if q == p and cols:
                seen[cols[0]] = seen.get(cols[0], 0) + 1
                if seen[cols[0]] == 2:
                    top.append(cols[0])
        want |= {(p, i + 1, k, seen[k] - 1) for i, k in enumerate(top[:4])}
    for prefix in (3, 100, 65_536):
        assert {tuple(r) for r in summary.duplicate_key_top(data, [0], 4, prefix).collect()} == want


# ---- segments and blocks ----


def test_segments_by_fingerprint(spark):
    rng = random.Random(9)
    text = lambda: [rng.choice(["##A", "##B", "##", "x", "y", "z", "--"]) for _ in range(120)]
    frame = lambda side: spark.createDataFrame([(f"p{p}", i, v) for p, t in enumerate(side) for i, v in enumerate(t)], LINES)
    left = [text() for _ in range(6)]
    right = [t if i % 2 else [v if rng.random() < 0.9 else "x" for v in t] for i, t in enumerate(left)]
    for args in (("^##", None, r"^##(\w+)"), ("^##", "^--", r"^##(\w+)")):
        a, b = frame(left), frame(right)
        (ha, la, oa), (hb, lb, _) = segments.segment_lines(a, *args), segments.segment_lines(b, *args)
        results, apart = segments.compare_segment_lines((ha, la), (hb, lb))
        (sa, loose), (sb, _) = segments.scan_segments(a, *args), segments.scan_segments(b, *args)
        whole = segments.segment_compare(sa, sb).unionByName(segments.segment_compare_unkeyed(sa, sb)).collect()
        assert sorted((r.pair_id, r.key, r.status, len(r.diff_cols)) for r in whole) == sorted((r.pair_id, r.key, r.status, r.n_diff) for r in results.collect())
        assert sorted(map(str, oa.collect())) == sorted(map(str, loose.collect()))
        n = {"diff": sum(len(r.diff_cols) for r in whole), "unmatched_a": sum(len(r.a_cols) for r in whole if r.status == "unmatched_a"), "unmatched_b": sum(len(r.b_cols) for r in whole if r.status == "unmatched_b")}
        assert {r.status: r.n for r in apart.groupBy("status").agg(F.count("*").alias("n")).collect()} == {k: v for k, v in n.items() if v}


def test_a_segment_as_long_as_its_file(spark):
    n = 300_000
    side = lambda word: spark.range(n).select(F.lit("p").alias("pair_id"), F.col("id").alias("seq"), F.when(F.col("id") == 0, "##A").when(F.col("id") == n - 1, word).otherwise(F.concat(F.lit("line "), F.col("id").cast("string"))).alias("value"))
    a, b = (segments.segment_lines(side(w), "^##", "^never", r"^##(\w)")[:2] for w in ("old", "new"))
    assert "collect_list" not in plan_of(a[0])
    results, apart = segments.compare_segment_lines(a, b)
    assert [(r.key, r.status, r.n_a, r.n_diff) for r in results.collect()] == [("A", "diff", n, 1)]
    assert [(r.line_no, r.a, r.b) for r in apart.collect()] == [(n, "old", "new")]


def test_blocks_by_fingerprint_are_those_of_the_held_ones(spark):
    rng = random.Random(12)

    def control(seed):
        own = random.Random(seed)
        out = []
        for s in range(5):
            out += [f"{s}@OD@|PRODUCT:{'XYZ'[own.randrange(3)]}|", "BRCH : 1", "NO  NAME"] if own.random() < 0.8 else [f"{s}@OD@|PRODUCT:X|"]
            out += [f"{i}  n{i}" for i in range(own.randrange(4))] + [own.choice(["END", "", "no more"]) for _ in range(own.randrange(4))]
        return out

    template = ["TITLE", "DATE:", "NO| NAME|", "----", "", "", "TOTAL:"]

    def plain(seed):
        own = random.Random(seed)
        return [v for s in range(own.randrange(1, 5)) for v in ["TITLE", f"DATE: {own.randrange(2)}", "NO| NAME|", "----", f"{s}| a|", "", f"TOTAL: {own.randrange(2)}"][own.random() < 0.1 :]]

    frame = lambda texts: spark.createDataFrame([(f"p{p}", i, v) for p, t in enumerate(texts) for i, v in enumerate(t)], LINES)
    statuses = set()
    for make, hold, keep, ways in ((control, reports.scan_report_control, reports.report_control_lines, (True, False)),
                                   (plain, lambda d: reports.scan_report_template(d, template), lambda d: reports.report_template_lines(d, template), (False,))):
        seeds = [rng.randrange(1000) for _ in range(5)]
        sides = [frame([make(s) for s in seeds]), frame([make(s + (i % 2)) for i, s in enumerate(seeds)])]
        held, kept = [hold(x)[1].checkpoint() for x in sides], [keep(x)[1:3] for x in sides]
        assert "collect_list" not in plan_of(kept[0][0])
        for signed in ways:
            whole = (reports.block_compare_signature if signed else reports.block_compare_positional)(*held).collect()
            results, apart = reports.compare_block_lines(*kept, signed)
            size = lambda x: None if x is None else len(x)
            want = sorted((r.pair_id, r.key, r.section, r.status, str(size(r.a_cols)), str(size(r.b_cols)), len(r.diff_cols)) for r in whole)
            assert want == sorted((r.pair_id, r.key, r.section, r.status, str(r.n_a), str(r.n_b), r.n_diff) for r in results.collect())
            at = lambda x, i: x[i] if x is not None and i < len(x) else None
            lines = [(r.pair_id, r.key, r.section, i + 1, str(at(r.a_cols, i)), str(at(r.b_cols, i))) for r in whole for i in (r.diff_cols if r.status == "diff" else range(len(r.a_cols or r.b_cols or [])) if r.status != "equal" else [])]
            assert sorted(lines) == sorted((r.pair_id, r.key, r.section, r.line_no, str(r.a), str(r.b)) for r in apart.collect())
            statuses |= {r.status for r in whole}
    assert statuses == {"equal", "diff", "unmatched_a", "unmatched_b"}


def test_a_broken_page_as_long_as_its_report(spark):
    n = 300_000
    head = ["1@OD@|PRODUCT:X|", "BRCH : 1", "NO  NAME", "1  ann", "no record"]
    text = F.get(F.array(*map(F.lit, head)), F.col("id").cast("int"))
    side = lambda last: spark.range(n).select(F.lit("p").alias("pair_id"), F.col("id").alias("seq"), F.coalesce(text, F.when(F.col("id") == n - 1, last), F.concat(F.lit("line "), F.col("id").cast("string"))).alias("value"))
    (rows, a, la, _), (_, b, lb, _) = (reports.report_control_lines(side(x)) for x in ("old", "new"))
    assert rows.count() == 1
    results, apart = reports.compare_block_lines((a, la), (b, lb), by_signature=True)
    assert sorted((r.key, r.section, r.status, r.n_a, r.n_diff) for r in results.collect()) == [("X·1", "footer", "diff", n - 4, 1), ("X·1", "header", "equal", 3, 0)]
    assert [(r.line_no, r.a, r.b) for r in apart.collect()] == [(n - 4, "old", "new")]


def test_blocks_apart_are_the_greedy_choice(spark):
    rng = random.Random(5)
    found, want = [], set()
    for p in range(12):
        h = rng.randint(1, 5)
        ps = sorted(rng.sample(range(h - 1, 400), rng.randint(1, 300)))
        if p == 11:
            h, ps = 3, list(range(2, 20_000))  # one long run
        last = None
        for x in ps:
            found.append((f"p{p}", x, h))
            if last is None or x - h >= last:
                want.add((f"p{p}", x))
                last = x
    out = reports.blocks_apart(spark.createDataFrame(found, "pair_id string, p long, h int"))
    got = [(r.pair_id, r.p) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want


# ---- patterns ----


def test_patterns_by_their_rarest_gram(spark):
    import re

    rng = random.Random(6)
    word = lambda k: "".join(rng.choices("abc1_.", k=k))
    names = sorted({word(rng.randint(0, 9)) for _ in range(150)} | {"日本_1.TXT", "a\nb"})
    globs = sorted({"".join(rng.choice(["*", "?", "#N1", word(2), word(5), "A"]) for _ in range(rng.randint(0, 4))) for _ in range(200)} | {"*", "", "???", "日*", "**"})
    def fits(n, g):
        plain = re.sub(r"#[A-Za-z0-9_]+", "*", g)
        return re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in plain), n, re.I | re.S) is not None

    left = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    right = spark.createDataFrame([(j, g) for j, g in enumerate(globs)], "j int, glob string")
    out = patterns.fitting(left, right, "name", "glob")
    assert {(r.i, r.j) for r in out.collect()} == {(i, j) for i, n in enumerate(names) for j, g in enumerate(globs) if fits(n, g)}
    assert out.count() == len({(r.i, r.j) for r in out.collect()})
    assert "NestedLoop" not in plan_of(out) and "Cartesian" not in plan_of(out)


def test_many_patterns_and_names(spark):
    names = spark.range(40_000).select(F.concat(F.lit("REP_"), F.lpad((F.col("id") % 2000).cast("string"), 6, "0"), F.lit("_"), F.col("id").cast("string"), F.lit(".txt")).alias("name"))
    globs = spark.range(4000).select(F.col("id").alias("j"), F.concat(F.lit("rep?"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit("_*.TXT")).alias("glob"))
    out = patterns.fitting(names, globs, "name", "glob")
    assert out.count() == 40_000 and "NestedLoop" not in plan_of(out)


@pytest.mark.parametrize("crowd", [2, 50_000])
def test_long_runs_and_crowded_grams(spark, crowd):
    rng = random.Random(8)
    names = sorted({f"{rng.choice('ab')}{rng.choice(['x' * 40, 'report-of-the-day-', 'r'])}{rng.randint(0, 30):03}.txt" for _ in range(120)})
    globs = sorted({rng.choice(["*", "?", "a", "b"]) + rng.choice(["x" * 40, "x" * 33 + "*", "REPORT-of-the-day-", "r", "*"]) + rng.choice(["*", f"{rng.randint(0, 30):03}*", "0*.txt"]) for _ in range(80)})
    left = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    right = spark.createDataFrame([(j, g) for j, g in enumerate(globs)], "j int, glob string")
    out = patterns.fitting(left, right, "name", "glob", crowd=crowd)
    fits = lambda n, g: __import__("re").fullmatch("".join(".*" if c == "*" else "." if c == "?" else __import__("re").escape(c) for c in g.lower()), n) is not None
    assert sorted((r.i, r.j) for r in out.collect()) == [(i, j) for i, n in enumerate(names) for j, g in enumerate(globs) if fits(n, g)]


def test_neither_names_nor_patterns_are_sent_to_all_tasks(spark):
    names = spark.range(1000).select(F.concat(F.lit("REP_"), F.col("id").cast("string")).alias("name"))
    globs = spark.range(100).select(F.col("id").alias("j"), F.concat(F.lit("rep_"), F.col("id").cast("string"), F.lit("?")).alias("glob"))
    # the crowded grams alone are
    assert plan_of(patterns.fitting(names, globs, "name", "glob")).count("BroadcastExchange") == 1


def test_types_with_one_pattern_meet_names_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pairing, "fitting", lambda names, marks, *a: seen.append(marks.count()) or patterns.fitting(names, marks, *a))
    files = spark.createDataFrame([("r1_a.txt",), ("R2_b.TXT",), ("r3",)], "name string")
    types = spark.createDataFrame([(f"R{i:03}", f"{'rR'[i % 2]}{i % 3}_*.txt", 300 - i // 3) for i in range(600)] + [("X", "r3.txt", 9), ("Y", "R3.dat", 8)], "report_id string, pattern string, import_order int")
    got = {r.name: r.report_id for r in pairing.file_to_report(files, types).collect()}
    assert got == {"r1_a.txt": "R598", "R2_b.TXT": "R599", "r3": "Y"} and max(seen) == 3


# ---- one row a pair meets its rows where they are ----


def test_no_pair_is_one_task(spark):
    rows, _ = dynamic(spark)
    data, trailer, _ = scan.scan_delimited(lines(spark, "a | b\n|||||x=1"))
    for d in (rows, data, trailer, export.export_full_csv(rows)):
        plan = plan_of(d)
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_sub_fields_are_cut_once(spark):
    d = spark.createDataFrame([("~~1Bd~~1Cx~~1By~~q",), ("x~~",), (None,)], "t string").select(compare.sub_fields(F.col("t")).alias("x"))
    assert plan_of(d).count("RLIKE(") == 1
    assert [[tuple(f) for f in r.x] for r in d.collect()] == [[("1B", "d"), ("1C", "x"), ("1B*2", "y"), ("#1", "q")], [("#1", "x")], []]


def test_orders_are_dealt_by_key(spark):
    """However few splits their file is read in."""
    for d in pairs.order_pair(spark, "/root/testdata/sf0.001"):
        plan = plan_of(d)
        assert "hashpartitioning(k#" in plan and plan.index("Generate explode") < plan.index("hashpartitioning(k#")


# ---- the end of a file's beginning ----


@pytest.mark.parametrize("name, text", [("gb18030", "7 | 客户"), ("utf-8", "7 | é")])
def test_a_character_cut_at_the_end_is_no_mark_against_its_charset(spark, name, text):
    raw = (text + "\n").encode(name)
    found = set()
    for shift in range(len(raw)):
        head = (b"x" * shift + raw * (charset.HEAD // len(raw) + 2))[: charset.HEAD]
        with charsets(spark):
            found |= {(r.encoding,) for r in charset.choose_encoding(spark.createDataFrame([("f", head)], "file_path string, h binary")).collect()}
    assert found == {(name,)}


def test_both_joins_share_the_last_records_of_a(spark):
    rows = lambda v: spark.createDataFrame([("p", i, [str(i % 7), f"{v}{i % 3}"]) for i in range(20)], "pair_id string, seq long, cols array<string>")
    rows = [rows("x").where(f"cols[0] <> '{n}'").withColumn("pair_id", F.lit("p")).localCheckpoint() for n in (5, 6)]  # no pair_id is null
    out = compare.keyed_compare(*rows, [0])
    assert {r.key for r in out.where("status = 'unmatched_a'").collect()} == {"6"}
    assert {r.key for r in out.where("status = 'unmatched_b'").collect()} == {"5"}
    out.collect()
    assert "ReusedExchange" in plan_of(out)


def test_counts_share_the_last_records_of_a(spark):
    """Keys alone would be shuffled once more, millions to a task."""
    rows = lambda n: spark.createDataFrame([("p", i, [str(i % n), f"x{i % 4}"]) for i in range(20)], "pair_id string, seq long, cols array<string>").withColumn("pair_id", F.lit("p")).localCheckpoint()
    out = summary.zone_counts(compare.keyed_compare(rows(7), rows(6), [0]))
    assert {(r.zone, r.n) for r in out.collect()} == {("diff", 12), ("equal", 8), ("unmatched", 1)}
    assert plan_of(out).count("ReusedExchange") > 0


def test_last_records_without_a_place_stay(spark):
    rows = lambda seq, key: spark.createDataFrame([("p", seq, [key])], "pair_id string, seq long, cols array<string>")
    assert {(r.key, r.status) for r in compare.keyed_compare(rows(None, "k"), rows(0, "z"), [0]).collect()} == {("k", "unmatched_a"), ("z", "unmatched_b")}


def test_sub_fields_of_odd_texts(spark):
    texts = ["", "~~", "head", "~~1Ba~~1Cb", "~~1Ba~~1Bb~~1B", "x~~1Ba~~ y~~~~é9z", "~~~1B~~1", "~~1Ba~~x", "~~#1a~~##b~~1B~~1B"]

    def expected(text):
        out, seen = [], {}
        for i, s in enumerate(text.split("~~")):
            if s:
                c = s[:2] if i and len(s) > 1 and s[:2].isalnum() else None
                n = seen[c] = seen.get(c, 0) + 1
                out.append((f"#{n}" if c is None else c if n == 1 else f"{c}*{n}", s if c is None else s[2:]))
        return out

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", compare.sub_fields(F.col("t")).alias("f")).collect()
    assert {r.t: [tuple(x) for x in r.f] for r in got} == {t: expected(t) for t in texts}


def test_a_directory_settles_no_lines_with_their_rules(spark, monkeypatch):
    settled, settle = [], directory.settle
    monkeypatch.setattr(directory, "settle", lambda df: settled.append(df.columns) or settle(df))
    pairs = spark.createDataFrame(
        [("p", [1, 0, 1], [2], [], "|", "", [1], [" b , c"]), ("q", [0], [], [1], ";", "#", [], [])],
        "pair_id string, keys array<int>, omit array<int>, ignore array<int>, delim string, trailer string, incremental array<int>, conds array<string>",
    )
    lines = lambda x: spark.createDataFrame([("p", 0, f"1|b|{x}"), ("p", 1, f"2|d|{x}"), ("p", 2, f"3|c|0|{x}"), ("q", 0, f"1;{x};k"), ("q", 1, f"2;{x};{x}"), ("q", 2, "#T=1"), ("none", 0, "z")], "pair_id string, seq long, value string")
    out = directory.compare_directories(lines("x"), lines("y"), pairs)
    got = {(r.pair_id, r.key.replace("\x1f", ":"), r.status, tuple(r.diff_cols)) for r in out.results.where("section = 'data'").collect()}
    assert got == {("p", "1:b", "equal", ()), ("p", "3:c", "diff", (3,)), ("q", "1", "equal", ()), ("q", "2", "diff", (2,))}
    assert not any("value" in c for c in settled)
