import random

from pyspark.sql import functions as F

from twinledger.functions.strings import UNIT
from twinledger.operators import compare, export, features, filters, monitor, rules, summary
from twinledger.sources import charset, scan

# The small files of this module's first tests are examples whose expected results must match.
LINES = "pair_id string, seq long, value string"


def lines(spark, text, pair="p"):
    return spark.createDataFrame([(pair, i, v) for i, v in enumerate(text.split("\n"))], LINES)


def records(spark, text, pair="p"):
    return scan.scan_delimited(lines(spark, text, pair))


def statuses(r):
    return sorted((x.key, x.status, tuple(x.diff_cols)) for x in r.collect())


def test_delimited_and_trailer(spark):
    data, trailer, stats = records(spark, "a | b | \n\n  \nc\n|||||RecNum=2\nSysID=\"X=1\"\n|||||bare")
    assert [list(r.cols) for r in data.orderBy("seq").collect()] == [["a", "b", ""], ["c"]]
    assert [(r.key, r.value, r.meta) for r in trailer.orderBy("seq").collect()] == [("RecNum", "2", "2"), ("SysID", '"X=1"', "X=1"), ("bare", "", "")]
    assert [tuple(r) for r in stats.collect()] == [("p", 2, 3, 2)]
    assert compare.recnum_check(trailer, stats).collect()[0].ok
    assert sorted((r.width, r.n) for r in scan.column_count_dist(data).collect()) == [(1, 1), (3, 1)]


def test_keyed_compare_with_trailer(spark):
    a, ta, sa = records(spark, "k1 | a | x\nk2 | b | y\nk3 | only | a\n|||||RecNum=3\n|||||SysID=AAA")
    b, tb, sb = records(spark, "k1 | a | x\nk2 | b | YYY\nk4 | only | b\n|||||RecNum=3\n|||||SysID=BBB")
    r = compare.keyed_compare(a, b, [0])
    assert statuses(r) == [("k1", "equal", ()), ("k2", "diff", (2,)), ("k3", "unmatched_a", ()), ("k4", "unmatched_b", ())]
    assert statuses(compare.trailer_compare(ta, tb)) == [("RecNum", "equal", ()), ("SysID", "diff", (0,))]
    s = summary.compare_summary(r, sa, sb, summary.malformed(a, [0]), summary.malformed(b, [0])).collect()[0]
    assert (s.equal, s.diff, s.only_a, s.only_b, s.total_a) == (1, 1, 1, 1, 5)
    assert statuses(compare.keyed_compare(a, b, [0], skip=[2])) == [("k1", "equal", ()), ("k2", "equal", ()), ("k3", "unmatched_a", ()), ("k4", "unmatched_b", ())]
    assert {(x.field, x.a, x.equal) for x in compare.trailer_fields(ta, tb).collect()} == {("RecNum", "3", True), ("SysID", "AAA", False)}


def test_malformed_ragged_and_duplicates(spark):
    a, *_ = records(spark, "onlyonecol\ng1 | g2")
    b, *_ = records(spark, "g1 | g2")
    assert statuses(compare.keyed_compare(a, b, [1])) == [("g2", "equal", ())]
    assert summary.malformed(a, [1]).collect()[0].malformed == 1
    a, *_ = records(spark, "k1 | 1\nk1 | 2\nk2 | 3")
    b, *_ = records(spark, "k2 | 3\nk2 | 9\nk1 | 1\nk1 | 1")
    assert [x[1] for x in statuses(compare.keyed_compare(a, b, [0]))] == ["diff", "diff", "diff", "equal"]
    assert summary.duplicate_keys(a, [0]).collect()[0].duplicates == 1 and summary.duplicate_keys(b, [0]).collect()[0].duplicates == 2
    a, *_ = records(spark, "k | a")
    b, *_ = records(spark, "k | a | \nk | a | z")
    assert statuses(compare.keyed_compare(a, b, [0])) == [("k", "diff", (2,)), ("k", "equal", ())]


def test_whole_rows(spark):
    a, *_ = records(spark, "k1 | a | x\nk2 | b | y\nk3 | c | z")
    b, *_ = records(spark, "k1 | a | x\nk2 | b | Y\nk4 | d | w")
    assert [x[1] for x in statuses(compare.whole_row_compare(a, b))].count("equal") == 1 and len(statuses(compare.whole_row_compare(a, b))) == 5


def test_first_keys_to_repeat(spark):
    a, *_ = records(spark, "k1\nk1\nk2\nk2\nk2\nk3")
    b, *_ = records(spark, "k1\nk9\nk9")
    assert [(r.key, r.repeats) for r in summary.duplicate_key_top(a, [0]).orderBy("rank").collect()] == [("k1", 1), ("k2", 2)]
    assert [r.key for r in summary.duplicate_key_samples(a, b, [0]).orderBy("rank").collect()] == ["k1", "k2", "k9"]


def plain_sub_fields(text):
    out, natural, seen = [], 0, {}
    for i, part in enumerate(text.split("~~")):
        if not part:
            continue
        if i and len(part) >= 2 and part[:2].isalnum():
            seen[part[:2]] = seen.get(part[:2], 0) + 1
            out.append((part[:2] + (f"*{seen[part[:2]]}" if seen[part[:2]] > 1 else ""), part[2:]))
        else:
            natural += 1
            out.append((f"#{natural}", part))
    return out


def test_sub_fields(spark):
    rng = random.Random(3)
    texts = ["", "~~", "prefix~~1Ba~~1Bb~~-x~~1C", "~~~~AAx", "1B"] + ["".join(rng.choice(["~~", "1B", "x", "-", " ", "2C"]) for _ in range(rng.randint(0, 9))) for _ in range(80)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", compare.sub_fields(F.col("t")).alias("x")).collect()
    assert {r.i: [(x.k, x.v) for x in r.x] for r in rows} == {i: plain_sub_fields(t) for i, t in enumerate(texts)}


def test_dynamic_columns(spark):
    a, *_ = records(spark, "k1 | ~~1B20261018~~1C1\nk2 | ~~1B20261017~~1C2\nk3 | ~~1Cx~~1By\nk4 | ~~1Ba~~1C\nk5 | ~~1Bz")
    b, *_ = records(spark, "k1 | ~~1B20261018~~1C1\nk2 | ~~1B20261018~~1C2\nk3 | ~~1By~~1Cx\nk4 | ~~1Ba\nk6 | ~~1Bq")
    rows, registry = compare.keyed_compare_dynamic(a, b, [0], [1])
    assert [(k, s) for k, s, _ in statuses(rows)] == [("k1", "equal"), ("k2", "diff"), ("k3", "equal"), ("k4", "diff"), ("k5", "unmatched_a"), ("k6", "unmatched_b")]
    assert sorted((r.k, r.idx) for r in registry.collect()) == [("1B", 1000001), ("1C", 1000002)]
    dyn = {r.key: [(x.k, x.a, x.b) for x in r.dyn] for r in rows.collect()}
    assert dyn["k4"] == [("1B", "a", "a"), ("1C", "", None)] and dyn["k5"] == [("1B", "z", None)]


def test_any_partitioning_gives_the_same(spark):
    rng = random.Random(5)
    text = lambda: "\n".join(f"k{rng.randint(0, 60)} | {rng.randint(0, 3)}" + (" | x" if rng.random() < 0.1 else "") for _ in range(200))
    a, b = records(spark, text())[0], records(spark, text())[0]
    want = statuses(compare.keyed_compare(a, b, [0]))
    assert statuses(compare.keyed_compare(a.repartition(7), b.repartition(3), [0])) == want
    assert compare.keyed_compare(a.where("false"), b, [0]).where("status <> 'unmatched_b'").count() == 0


def test_many_pairs_at_once(spark):
    a = records(spark, "k | 1", "p")[0].unionByName(records(spark, "k | 1", "q")[0])
    b = records(spark, "k | 1", "p")[0].unionByName(records(spark, "k | 2", "q")[0])
    assert sorted((r.pair_id, r.status) for r in compare.keyed_compare(a, b, [0]).collect()) == [("p", "equal"), ("q", "diff")]


def test_rules(spark):
    text = "=>N1:f*.txt:KEYSEQ=3/1/3:DELIM= ; :ADDMOD=2,3\n# no\n\nN2:x:PRISEQ=9\nbad\nN3:y:KEYSEQ=0\nN4:z:TRAILER=##:KEYSEQ=2:KEYSEQ=1:SRCA=:COLS=WyJBIiwiQiJd"
    got = {r.nickname: r for r in rules.rules_from_lines(lines(spark, text)).collect()}
    assert (list(got["N1"]["keys"]), got["N1"].delim, list(got["N1"].incremental), got["N1"].priority) == ([0, 2], " ; ", [1, 2], 5)
    assert got["N2"].error and got["bad"].error and got["N3"].error
    assert (list(got["N4"]["keys"]), got["N4"].trailer, got["N4"].source_a, list(got["N4"].names), got["N4"].error) == ([0], "##", "A", ["A", "B"], None)


def test_split_and_incremental(spark):
    data, *_ = records(spark, "k1 | 养老 | 101\nk2 | 健康 | 901\nk3 | 医疗 | 50\nk5 | 医疗 | 950\n\n|||||REC=4")
    rule = [filters.Rule("养老", "all", (filters.Cond(2, "eq", "养老"),)), filters.Rule("健康", "any", (filters.Cond(2, "eq", "健康"), filters.Cond(3, "range", "800~1000")))]
    routed = filters.split_route(data, rule)
    assert {(r.grp, r.n) for r in filters.split_counts(routed, rule).collect()} == {("养老", 1), ("健康", 2), ("其他", 1)}
    data, *_ = records(spark, "k1 | 20260701 | a\nk2 | 20260702 | b\nk3 | 20260702 | c\nk4 | 20260703 | d")
    assert filters.incremental_filter(data, [1, 2], ["20260702,20260703", "c"]).count() == 1
    assert filters.incremental_filter(data, [1, 2], ["20260702", ""]).count() == 2 and filters.incremental_filter(data, [1], [" "]).count() == 4
    for bad in (filters.Cond(0, "eq", "x"), filters.Cond(1, "eq", ""), filters.Cond(1, "range", "5~1"), filters.Cond(1, "range", "~"), filters.Cond(1, "range", "x"), filters.Cond(1, "regex", "(")):
        try:
            filters.predicate(bad)
        except Exception:
            continue
        raise AssertionError(bad)


def test_monitor(spark):
    a, *_ = records(spark, "k1 | A1 | T1 | S1")
    b, *_ = records(spark, "k1 | B1 | T1 | S2")
    f = spark.createDataFrame([("p", 1, 1), ("p", 2, 2), ("p", 3, 3)], "pair_id string, col int, field_type int")
    v = monitor.monitor_verdict(f, monitor.monitor_values(a, f), monitor.monitor_values(b, f)).orderBy("col").collect()
    assert [(x.matched, x.verdict) for x in v] == [(False, "新线不为旧线子集"), (True, "新旧线一致"), (None, "不监控")]
    many, *_ = records(spark, "\n".join(f"k | v{i % 1500}" for i in range(3000)))
    r = monitor.monitor_values(many, f.where("col = 1")).collect()[0]
    assert len(r["values"]) == 1000 and r.truncated and r["values"][:2] == ["v0", "v1"]


def test_grades(spark):
    g = spark.range(1).select(summary.volume_grade(F.lit(1000), F.lit(1150)).alias("a"), summary.volume_grade(F.lit(0), F.lit(0)).alias("b"), summary.grade(summary.count_deviation(F.lit(0), F.lit(5))).alias("c"), summary.content_deviation(F.lit(0), F.lit(0)).alias("d")).collect()[0]
    assert tuple(g) == ("保持关注", "正常", "严重问题", None)


def test_exports(spark, tmp_path):
    a, *_ = records(spark, 'k1 | a"b | 1234567890123456\nk2 | x | ')
    b, *_ = records(spark, "k1 | a,b | 1234567890123456\nk3 | y")
    r = compare.keyed_compare(a, b, [0])
    full = export.export_full_csv(r, ["KEY"], "旧", "")
    assert sorted((x.status, x.line, tuple(x["values"])) for x in full.collect())[-1][0].startswith("有差异·旧")
    assert [x.detail for x in export.export_diff_records(r).where("key = 'k1'").collect()] == ["[栏位不一致 @2] A:'a\"b' B:'a,b'"]
    assert {(x.key, x.no, x.name) for x in export.export_diff_fields(r).collect()} == {("k1", 2, "栏位2")}
    path = str(tmp_path / "out")
    export.write_csv(export.export_diff_fields(r).select("key", "a"), path, ["键值", "A值"])
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "out").glob("*.csv")) if p.stat().st_size)
    assert text == '﻿键值,A值\r\nk1,"a""b"\r\n'
    assert spark.range(1).select(export.csv_line(F.lit("a\nb"), F.lit('q"'), F.lit("z"))).first()[0] == '"a\nb","q""",z'
    parts = export.export_parts(spark.range(0, 95, 1, 9).select(F.lit("p").alias("pair_id"), F.col("id").alias("seq")), "seq", size=20)
    assert all(x.part == x.seq // 20 for x in parts.collect())


def test_scan_lines_over_many_blocks(spark, tmp_path):
    rows = [f"line {i} é" for i in range(5000)]
    (tmp_path / "f.txt").write_bytes(("﻿" + "\r\n".join(rows) + "\n").encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "6000")
    got = scan.scan_lines(spark, str(tmp_path / "f.txt")).orderBy("seq").collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.seq for r in got] == list(range(5000)) and [r.value for r in got] == rows


def test_versions_and_mixed_charset(spark):
    files = spark.createDataFrame([("/d/x.gz.000000001",), ("/d/x.gz.000000002",), ("/d/y.gz",), ("/d/y",), ("/d/z.GZ",)], "path string")
    assert {(r.logical_name, r.path, r.plain) for r in scan.scan_versions(files).collect()} == {("x", "/d/x.gz.000000002", False), ("y", "/d/y", True), ("z", "/d/z.GZ", False)}
    content = b"a | " + "中文".encode("utf-16-be") + b" | c\nd | plain | e\n"
    out = charset.normalize_mixed_charset(spark.createDataFrame([("f", bytearray(content))], "file_path string, content binary"), "gb18030", " | ", {1: 2}).collect()
    assert [r.value for r in out] == ["a | 中文 | c", "d | plain | e"]
    import gzip

    z = charset.unzip(spark.createDataFrame([("f", bytearray(gzip.compress(b"hi"))), ("g", bytearray(b"raw"))], "file_path string, content binary")).collect()
    assert {(r.file_path, bytes(r.content)) for r in z} == {("f", b"hi"), ("g", b"raw")}


def test_labels_and_cases(spark):
    a, ta, _ = records(spark, "k1 | x | 1.00\nk2 | y\nk5 | v | 3\n|||||DataStartDate=\"20250916\"")
    b, tb, _ = records(spark, "k1 | z | 2.00\nk3 | w | 0\nk5 | v | 4\n|||||DataStartDate=20250917")
    r = compare.keyed_compare(a, b, [0])
    label = {x.key: x.diff for x in export.export_full_csv(r, ["KEY", "NAME"]).collect()}
    assert label == {"k1": "2-NAME；3-栏位3；", "k2": "", "k3": "", "k5": "3-栏位3；"}
    pairs = spark.createDataFrame([("p", "b1", 1, "N", "f_#BANKNO_*.v01", "f", "g", "team", "T")], "pair_id string, batch string, round int, nickname string, glob string, file_a string, file_b string, team string, type string")
    cases = export.export_cases(r.unionByName(compare.trailer_compare(ta, tb)), pairs)
    got = {(c.key, c.column_no): c for c in cases.collect()}
    assert {k: c.content for k, c in got.items()} == {("k1", 2): "A:'x' B:'z'", ("k1", 3): "A:'1.00' B:'2.00'", ("k2", 0): "A:'k2 | y'", ("k3", 0): "B:'k3 | w | 0'", ("k5", 3): "A:'3' B:'4'"}
    assert {(c.date, c.wildcard, c.extension, c.type) for c in got.values()} == {("20250916", "#BANKNO", "v01", "T")}
    sheet = export.case_table(cases).where("`问题状态` = '' and `栏位索引` = '0'").collect()
    assert len(sheet) == 2 and sheet[0].asDict().keys() == dict.fromkeys(export.CASE_COLUMNS).keys() and sheet[0]["分析团队"] == "team"
    names = spark.createDataFrame([("a_20260231_20269999.dat",), ("120250101",), ("x_20240101_20250202",)], "n string")
    assert [x.d for x in names.select(export.file_date(F.col("n")).alias("d")).collect()] == ["20260231", None, "20250202"]
    # 1.00 and 1 are different differences, so neither is the rule
    assert features.numeric_delta_mode(r).collect() == []
    more, *_ = records(spark, "k1 | z | 2.00\nk5 | v | 4.00")
    assert [(x.delta, x.n) for x in features.numeric_delta_mode(compare.keyed_compare(a, more, [0])).collect()] == [("+1.00", 2)]


def test_cell_spans():
    tags = lambda a, b, most=40_000: [(x["tag"], x["i1"], x["i2"], x["j1"], x["j2"]) for x in features._opcodes(a, b, most)]
    assert tags("", "") == [("equal", 0, 0, 0, 0)] and tags("ab", "") == [("delete", 0, 2, 0, 0)] and tags("", "é") == [("insert", 0, 0, 0, 1)]
    assert tags("abc", "axc") == [("equal", 0, 1, 0, 1), ("delete", 1, 2, 1, 1), ("insert", 2, 2, 1, 2), ("equal", 2, 3, 2, 3)]
    assert tags("aab", "ab") == [("equal", 0, 1, 0, 1), ("delete", 1, 2, 1, 1), ("equal", 2, 3, 1, 2)]
    assert tags("xaby", "xbay", 1) == [("equal", 0, 1, 0, 1), ("delete", 1, 3, 1, 1), ("insert", 3, 3, 1, 3), ("equal", 3, 4, 3, 4)]
    assert tags("aaa", "aa", 1) == [("equal", 0, 2, 0, 2), ("delete", 2, 3, 2, 2)]
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab1") for _ in range(rng.randint(0, 9))) for _ in range(2))
        for most in (0, 40_000):
            spans = features._opcodes(a, b, most)
            assert "".join(a[x["i1"] : x["i2"]] for x in spans if x["tag"] != "insert") == a and "".join(b[x["j1"] : x["j2"]] for x in spans if x["tag"] != "delete") == b
            assert all(a[x["i1"] : x["i2"]] == b[x["j1"] : x["j2"]] for x in spans if x["tag"] == "equal")


def test_monitor_of_an_empty_side(spark):
    fields = spark.createDataFrame([("p", 0, 1), ("p", 1, 2), ("p", 2, 3)], "pair_id string, col int, field_type int")
    a, *_ = records(spark, "x | y")
    none = spark.createDataFrame([], "pair_id string, seq long, cols array<string>")
    told = lambda x, y: {r.col: r.matched for r in monitor.monitor_verdict(fields, monitor.monitor_values(x, fields), monitor.monitor_values(y, fields)).collect()}
    assert told(a, none) == {0: True, 1: False, 2: None} and told(none, a) == {0: False, 1: False, 2: None} and told(none, none) == {0: True, 1: True, 2: None}


def test_key_label():
    assert UNIT == "\x1f"
