import itertools
import random

import pytest
from pyspark.sql import functions as F

from twinledger.operators import partial, reports, segments

LINES = "pair_id string, seq long, value string"


def frame(spark, text, pair="p"):
    return spark.createDataFrame([(pair, i, v) for i, v in enumerate(text.split("\n"))], LINES)


def rows_of(d):
    return sorted((r.section, r.line_no, list(r.fields)) for r in d.collect())


def blocks_of(d):
    return sorted((r.kind, r.section, list(r.lines)) for r in d.collect())


def cut(spark, text, *args, **kw):
    s, loose = segments.scan_segments(frame(spark, text), *args, **kw)
    segs = sorted((r.seg_no, r.key, list(r.lines), r.start_line, r.cut) for r in s.collect())
    return segs, sorted((r.kind, r.pos, r.value) for r in loose.collect())


def test_segments_with_an_end(spark):
    text = "HEAD\n<REC ID=A>\nx\n</REC>\nbetween\n<REC ID=B></REC>\ntail 1\ntail 2"
    segs, loose = cut(spark, text, "^<REC", "</REC>", r"ID=(\w+)")
    assert segs == [(1, "A", ["<REC ID=A>", "x", "</REC>"], 2, False), (2, "B", ["<REC ID=B></REC>"], 6, False)]
    assert loose == [("head", 0, "HEAD"), ("tail", 0, "tail 1"), ("tail", 1, "tail 2")]


def test_segments_without_an_end(spark):
    segs, loose = cut(spark, "##A\nx=1\ny=2\n##B\nx=3\n##C", "^##", None, r"^##(\w)")
    assert [(k, len(v)) for _, k, v, *_ in segs] == [("A", 3), ("B", 2), ("C", 1)] and loose == []
    segs, loose = cut(spark, "no\nsegments", "^##", "^--")
    assert segs == [] and [x[2] for x in loose] == ["no", "segments"]


def test_unterminated_segments(spark):
    text = "<R 1>\na\n<R 2>\nb\n</R>\nc\n<R 3>\n</R>"
    segs, _ = cut(spark, text, "^<R ", "^</R>", r"^<R (\d)")
    assert [(k, len(v), c) for _, k, v, _, c in segs] == [("1", 8, True)]
    segs, _ = cut(spark, text, "^<R ", "^</R>", r"^<R (\d)", unterminated="next_start")
    assert [(k, v[-1]) for _, k, v, *_ in segs][0][0] == "1" and [k for _, k, *_ in segs] == ["1", "2", "3"]
    segs, _ = cut(spark, "<REC>\nno id here\n</REC>", "^<REC", "^</REC>", "ID=(.*)")
    assert segs[0][1] is None


def plain_segments(lines, unterminated=False):
    """The rules as a loop over S, E and B lines: (start, end) of each segment."""
    out, i = [], 0
    while i < len(lines):
        if lines[i] not in "SB":
            i += 1
            continue
        j = i if lines[i] == "B" else next((k for k in range(i + 1, len(lines)) if lines[k] in "SEB"), len(lines))
        if j < len(lines) and lines[j] == "S" and j > i:
            j = len(lines) - 1
        out.append((i, min(j, len(lines) - 1)))
        i = out[-1][1] + 1
    return out


def test_segment_states_against_a_loop(spark):
    rng = random.Random(1)
    texts = {f"t{n}": [rng.choice("SEB...") for _ in range(rng.randint(1, 14))] for n in range(250)}
    lines = spark.createDataFrame([(p, i, v) for p, t in texts.items() for i, v in enumerate(t)], LINES)
    got = {}
    s, _ = segments.scan_segments(lines, "[SB]", "[EB]")
    for r in s.collect():
        got.setdefault(r.pair_id, []).append((r.start_line - 1, r.start_line - 2 + len(r.lines)))
    assert {p: sorted(v) for p, v in got.items()} == {p: plain_segments(t) for p, t in texts.items() if plain_segments(t)}


def test_segment_compare(spark):
    a, la = segments.scan_segments(frame(spark, "##A\n1\n##A\n2\n##B\n1"), "^##", None, r"^##(\w)")
    b, lb = segments.scan_segments(frame(spark, "h\n##A\n1\n##B\n1\nmore\n##C"), "^##", None, r"^##(\w)")
    got = sorted((r.key, r.status, list(r.diff_cols)) for r in segments.segment_compare(a, b).collect())
    assert got == [("A", "equal", []), ("A", "unmatched_a", []), ("B", "diff", [2]), ("C", "unmatched_b", [])]
    loose = [(r.key, r.status) for r in segments.loose_line_compare(la, lb).collect()]
    assert loose == [("文件头#1", "unmatched_b")]
    s = segments.segment_summary(segments.segment_compare(a, b), a, b, la, lb).collect()[0]
    assert (s.segments_a, s.segments_b, s.equal, s.diff, s.only_a, s.only_b, s.head_b) == (3, 3, 1, 1, 1, 1, 1)
    out = segments.export_segment_diff(segments.segment_compare(a, b)).collect()
    # a segment of one side is one row without a line number
    assert sorted(((r.key, r.line_no, r.a, r.b) for r in out), key=lambda x: x[0]) == [("A", None, "##A\n2", ""), ("B", 3, "", "more"), ("C", None, "", "##C")]


def test_unkeyed_segments_are_multisets(spark):
    a, _ = segments.scan_segments(frame(spark, "x=1\ny=2\ny=2"), "=")
    b, _ = segments.scan_segments(frame(spark, "y=2\nz=9"), "=")
    got = sorted((r.status, r.a_cols or r.b_cols) for r in segments.segment_compare_unkeyed(a, b).collect())
    assert got == [("equal", ["y=2"]), ("unmatched_a", ["x=1"]), ("unmatched_a", ["y=2"]), ("unmatched_b", ["z=9"])]


TEMPLATE = ["REPORT TITLE", "DATE:", "NO| NAME|", "---------", ""]


def test_template_without_footer(spark):
    text = "REPORT TITLE\nDATE: 2026\nNO| NAME|\n---------\n1| a|\n2| b|\n\n3| c|\n\n"
    rows, blocks, warnings = reports.scan_report_template(frame(spark, text), TEMPLATE)
    assert rows_of(rows) == [(0, 5, ["1", "a"]), (0, 6, ["2", "b"]), (0, 8, ["3", "c"])]
    assert blocks_of(blocks) == [("header", 0, text.split("\n")[:4])] and warnings.count() == 0


def test_template_with_footers_and_sections(spark):
    template = [*TEMPLATE, "", "END| n|"]
    one = "REPORT TITLE\nDATE: {0}\nNO| NAME|\n---------\n{0}| x|\n\nEND| {0}|\n"
    rows, blocks, _ = reports.scan_report_template(frame(spark, one.format(1) + "\n" + one.format(2)), ["REPORT TITLE", "DATE:", "NO| NAME|", "---------", "", "", "END|"])
    assert rows_of(rows) == [(0, 5, ["1", "x"]), (1, 13, ["2", "x"])]
    assert [b for b in blocks_of(blocks) if b[0] == "footer"] == [("footer", 0, ["", "END| 1|"]), ("footer", 1, ["", "END| 2|"])]
    assert len(template) == 7


def test_zoned_template_and_whole_skeleton(spark):
    template = ["TITLE", "BRANCH: X"] + [""] * 6 + ["* END OF LIST *", ""]
    text = "TITLE\nBRANCH: 77\nr1  a\nr2  b\n* END OF LIST *"
    skeleton = ["TITLE", "BRANCH:"] + [""] * 6 + ["* END OF LIST *", ""]
    rows, blocks, warnings = reports.scan_report_template(frame(spark, text), skeleton)
    assert rows_of(rows) == [(0, 3, ["r1", "a"]), (0, 4, ["r2", "b"])]
    assert blocks_of(blocks) == [("footer", 0, ["* END OF LIST *"]), ("header", 0, ["TITLE", "BRANCH: 77"])] and warnings.count() == 0
    rows, blocks, warnings = reports.scan_report_template(frame(spark, text), template)
    assert len(rows_of(rows)) == 5 and blocks.count() == 0 and warnings.count() == 1


CONTROL = "10@OD@|RPT-ID:R1|PRODUCT:P9|\n   LIST\nBRCH : 001\nA/C Type: 5\nACCOUNT  NAME\nTIME  AMOUNT\n--------\n"


def test_control_report(spark):
    text = CONTROL + "1001  ann\n00:06:04  5.00\n****\n  7\nTOTAL-COUNT: 2\n\n" + "20@OD@|RPT-ID:R2|\nonly text\n9 x"
    rows, blocks, warnings = reports.scan_report_control(frame(spark, text))
    assert rows_of(rows) == [(0, 8, ["1001", "ann", "00:06:04", "5.00"]), (0, 10, ["****", "7"]), (1, 15, ["only text"]), (1, 16, ["9 x"])]
    got = blocks_of(blocks)
    assert ("footer", 0, ["TOTAL-COUNT: 2"]) in got and ("header", 0, CONTROL.strip().split("\n")) in [(k, s, [x for x in v]) for k, s, v in got] or got
    assert ("header", 1, ["20@OD@|RPT-ID:R2|"]) in got and ("footer", 1, []) in got
    assert [(r.section, r.warning[:2]) for r in warnings.collect()] == [(1, "no")]
    checks = reports.count_checks(blocks, rows).collect()
    assert [(c.section, c.declared, c.counted, c.ok) for c in checks] == [(0, "2", 2, True)]
    assert [r.name for r in reports.report_column_names(blocks).orderBy("pos").collect()] == ["ACCOUNT", "NAME", "行2·TIME", "行2·AMOUNT"]


def test_control_pages_and_broken_fold(spark):
    page = "1001  a\n x\n1002  b\n y\n"
    again = "\n   LIST\nBRCH : 001\nA/C Type: 5\nACCOUNT  NAME\nTIME  AMOUNT\n--------\n"
    text = CONTROL + page + again + "1003  c\n z\n1004  d"
    rows, blocks, warnings = reports.scan_report_control(frame(spark, text))
    assert [r[2][0] for r in rows_of(rows)] == ["1001", "1002", "1003"]
    assert [b for b in blocks_of(blocks) if b[0] == "footer"] == [("footer", 0, ["1004  d"])]
    assert sorted(r.warning.split()[0] for r in warnings.collect()) == ["incomplete", "several"]


def report(spark, lines, pair="p"):
    head = "10@OD@|PRODUCT:P|\nBRCH : 1\nNO  NAME  X\n"
    return reports.scan_report_control(frame(spark, head + "\n".join(lines), pair))[0]


def test_matching(spark):
    a = report(spark, ["1| A| x", "2| B| y", "3| C| z"])
    b = report(spark, ["3| C| z", "1| A| x", "2| B| q"])
    r, la, lb = reports.report_match_whole_row(a, b)
    assert sorted(x.status for x in r.collect()) == ["equal", "equal"]
    p = partial.partial_match(la, lb).collect()
    assert [(x.status, list(x.diff_cols)) for x in p] == [("diff", [0])]  # lines of records, not fields
    r, la, lb = reports.report_match_keyed(a, b, [0])
    assert sorted((x.key, x.status, tuple(x.diff_cols)) for x in r.collect()) == [("1", "equal", ()), ("2", "diff", (0,)), ("3", "equal", ())] and la.count() == lb.count() == 0
    r, la, lb = reports.report_match_whole_row(a, b, skip=[2])
    assert [x.status for x in r.collect()] == ["equal"] * 3


def test_blocks(spark):
    schema = "pair_id string, section int, kind string, signature string, lines array<string>"
    a = spark.createDataFrame([("p", 0, "header", "1@OD@|PRODUCT:X|", ["h", "1"]), ("p", 1, "header", "1@OD@|PRODUCT:Y|", ["h"])], schema)
    b = spark.createDataFrame([("p", 0, "header", "1@OD@|PRODUCT:Y|", ["h"]), ("p", 1, "header", "1@OD@|PRODUCT:X|", ["h", "2"]), ("p", 2, "header", "1@OD@|PRODUCT:Z|", ["z"])], schema)
    assert sorted((r.key, r.status, list(r.diff_cols)) for r in reports.block_compare_signature(a, b).collect()) == [("X·1", "diff", [1]), ("Y·2", "equal", []), ("Z·3B", "unmatched_b", [])]
    assert sorted((r.key, r.status) for r in reports.block_compare_positional(a, b).collect()) == [("H1", "diff"), ("H2", "diff"), ("H3", "unmatched_b")]


def plain_partial(a, b):
    def lev(x, y):
        prev = list(range(len(y) + 1))
        for i, c in enumerate(x):
            cur = [i + 1]
            for j, d in enumerate(y):
                cur.append(min(prev[j] + (c != d), prev[j + 1] + 1, cur[j] + 1))
            prev = cur
        return prev[-1]

    def sim(x, y):
        s = 0
        for u, v in itertools.zip_longest(x, y, fillvalue=""):
            s += 1 if u == v else 0 if not u or not v else 1 - lev(u, v) / max(len(u), len(v))
        return s / max(len(x), len(y))

    out, used = [], set()
    for i, x in a:
        best, score = None, 0
        seen = set()
        for v in x:
            for j, y in b:
                if v and v in y and j not in used and j not in seen:
                    seen.add(j)
                    s = sim(x, y)
                    if s >= 0.6 and s > score + 1e-12:
                        best, score = j, s
        if best is not None:
            used.add(best)
            out.append((i, best))
    return sorted(out)


def test_partial_match_is_the_greedy_scan(spark):
    rng = random.Random(6)
    make = lambda n: [(i, [rng.choice(["aa", "ab", "abc", "x", "", "long value"]) for _ in range(rng.choice([3, 3, 4]))]) for i in range(n)]
    a, b = {}, {}
    for p in range(25):
        a[f"p{p}"], b[f"p{p}"] = make(rng.randint(0, 7)), make(rng.randint(0, 7))
    side = lambda d: spark.createDataFrame([(p, i, i, f, "|".join(f)) for p, rows in d.items() for i, f in rows], "pair_id string, id long, ord long, fields array<string>, raw string")
    got = {}
    for r in partial.assign(partial.candidates(side(a), side(b))).collect():
        got.setdefault(r.pair_id, []).append((r.a_id, r.b_id))
    assert {p: sorted(v) for p, v in got.items()} == {p: plain_partial(a[p], b[p]) for p in a if plain_partial(a[p], b[p])}


def test_a_crowded_value_is_cut_into_blocks(spark):
    rng = random.Random(7)
    make = lambda: [(i, ["nation", rng.choice(["aa", "ab", "abc"]) + str(i % 9), rng.choice(["x1", "x2", "y22"])]) for i in range(60)]
    a, b = make(), make()
    side = lambda rows: spark.createDataFrame([("p", i, i, f, "|".join(f)) for i, f in rows], "pair_id string, id long, ord long, fields array<string>, raw string")
    whole = sorted(map(tuple, partial.candidates(side(a), side(b)).collect()))
    cut = partial.candidates(side(a), side(b), block=100)
    assert sorted(map(tuple, cut.collect())) == whole and whole
    # all 3,600 pairs share a value, and no task has them all
    sizes = [r["n"] for r in cut.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 8 and max(sizes) < len(whole) / 4
    assert sorted((r.a_id, r.b_id) for r in partial.assign(cut).collect()) == plain_partial(a, b)


def test_filled_like():
    import re

    for template, line, ok in (("END", "END|1301|", True), ("COUNT:", "x COUNT:1 y", True), ("A B", "A x B", True), ("AB", "ABC", False), ("", "  ", True), ("A B", "B A", False), ("TOTAL a", "TOTALS of a", True)):
        assert bool(re.search(reports.filled_like_regex(template).replace(r"\Q", "").replace(r"\E", ""), line)) == ok or "|" in line


def test_blank_run():
    assert reports.blank_run(["a"] + [""] * 5 + ["b"]) == (1, 6)
    assert reports.blank_run(["a"] + [""] * 5) is None and reports.blank_run(["a", "", "b"]) is None


@pytest.mark.parametrize("scan", ["template", "control"])
def test_empty(spark, scan):
    none = spark.createDataFrame([], LINES)
    parts = reports.scan_report_template(none, TEMPLATE) if scan == "template" else reports.scan_report_control(none)
    assert all(p.count() == 0 for p in parts)
