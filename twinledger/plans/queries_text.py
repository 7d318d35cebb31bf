"""Registered queries on messages, reports and charsets, over texts that Spark makes from the tables."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from ..operators import partial, reports, segments
from ..sources import charset, scan
from .pairs import table
from .queries import joined, query

# ---- messages: a conversation is a segment ----

STEP = 100_000


def chat_lines(spark, sf_dir, changed: bool):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.max(F.concat(F.col("role"), F.lit(" "), F.regexp_replace("text", "[\\r\\n]+", " "))).alias("value"))
    if changed:
        c = c.where("conv_id % 11 <> 0").withColumn("value", F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") % 3 == 0), F.concat("value", F.lit("!"))).otherwise(F.col("value")))
    pair = F.concat(F.lit("c"), (F.col("conv_id") % 8).cast("string")).alias("pair_id")
    body = c.select(pair, (F.col("conv_id") * STEP + F.col("turn") + 1).alias("seq"), "value")
    head = c.select("conv_id").distinct().select(pair, (F.col("conv_id") * STEP).alias("seq"), F.concat(F.lit("##"), F.col("conv_id").cast("string")).alias("value"))
    loose = body.select("pair_id").distinct().select("pair_id", F.explode(F.array(*[F.struct(F.lit(i - 3).cast("long").alias("seq"), F.lit(f"file {i if i < 2 else changed}").alias("value")) for i in range(2 + changed)])).alias("x")).select("pair_id", "x.*")
    return body.unionByName(head).unionByName(loose)


def chats(spark, sf_dir):
    return tuple(segments.scan_segments(chat_lines(spark, sf_dir, x), "^##", None, r"^##([0-9]+)") for x in (False, True))


CHATS = """t AS (SELECT conv_id, turn, max(role || ' ' || regexp_replace(text, '[\\r\\n]+', ' ', 'g')) AS value FROM conversations GROUP BY 1, 2),
u AS (SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 AND turn % 3 = 0 THEN value || '!' ELSE value END AS value FROM t WHERE conv_id % 11 <> 0),
sa AS (SELECT conv_id, ['##' || conv_id] || list(value ORDER BY turn) AS l FROM t GROUP BY 1), sb AS (SELECT conv_id, ['##' || conv_id] || list(value ORDER BY turn) AS l FROM u GROUP BY 1)"""


@query(f"WITH {CHATS} SELECT 'c' || (conv_id % 8) AS pair_id, CAST(conv_id AS VARCHAR) AS key, array_to_string(l, '/') AS lines, conv_id * {STEP} + 1 AS start_line FROM sa")
def scan_segments(spark, sf_dir):
    (s, _), _ = chats(spark, sf_dir)
    return s.select("pair_id", "key", joined("lines", "/").alias("lines"), "start_line")


@query(f"""WITH {CHATS} SELECT CAST(conv_id AS VARCHAR) AS key, CASE WHEN sb.l IS NULL THEN 'unmatched_a' WHEN sa.l = sb.l THEN 'equal' ELSE 'diff' END AS status,
  CASE WHEN sb.l IS NULL THEN '' ELSE array_to_string(list_filter(range(0, len(sa.l)), lambda i: sa.l[i + 1] <> sb.l[i + 1]), ',') END AS diff FROM sa LEFT JOIN sb USING (conv_id)""")
def segment_compare(spark, sf_dir):
    (a, _), (b, _) = chats(spark, sf_dir)
    return segments.segment_compare(a, b).select("key", "status", joined("diff_cols", ",").alias("diff"))


@query(f"""WITH {CHATS}, x AS (SELECT array_to_string(l[2:], '/') AS text, count(*) AS n FROM sa GROUP BY 1), y AS (SELECT array_to_string(l[2:], '/') AS text, count(*) AS n FROM sb GROUP BY 1)
  SELECT CAST(sum(least(coalesce(x.n, 0), coalesce(y.n, 0))) AS BIGINT) AS equal, CAST(sum(greatest(coalesce(x.n, 0) - coalesce(y.n, 0), 0)) AS BIGINT) AS only_a, CAST(sum(greatest(coalesce(y.n, 0) - coalesce(x.n, 0), 0)) AS BIGINT) AS only_b FROM x FULL JOIN y USING (text)""")
def segment_compare_unkeyed(spark, sf_dir):
    """Conversations without their numbers, as a multiset of texts over all files."""
    side = lambda d: d.select(F.lit("all").alias("pair_id"), F.lit(None).cast("string").alias("key"), F.col("key").cast("long").alias("seg_no"), F.expr("slice(lines, 2, size(lines) - 1)").alias("lines"), "start_line")
    (a, _), (b, _) = chats(spark, sf_dir)
    r = segments.segment_compare_unkeyed(side(a), side(b))
    n = lambda s, x: F.count_if(F.col("status") == s).alias(x)
    return r.agg(n("equal", "equal"), n("unmatched_a", "only_a"), n("unmatched_b", "only_b"))


@query("SELECT DISTINCT 'c' || (conv_id % 8) AS pair_id, unnest(['文件头#1', '文件头#2', '文件头#3']) AS key, unnest(['equal', 'equal', 'unmatched_b']) AS status FROM conversations WHERE conv_id % 11 <> 0")
def loose_line_compare(spark, sf_dir):
    (_, a), (_, b) = chats(spark, sf_dir)
    rank = lambda d: d.withColumn("pos", F.col("pos") + 3)
    return segments.loose_line_compare(rank(a), rank(b)).select("pair_id", "key", "status")


@query(f"""WITH {CHATS}, p AS (SELECT 'c' || (conv_id % 8) AS pair_id, sa.l AS a, sb.l AS b FROM sa LEFT JOIN sb USING (conv_id))
  SELECT pair_id, count(*) AS segments_a, count(b) AS segments_b, count(*) FILTER (WHERE a = b) AS equal, count(*) FILTER (WHERE a <> b) AS diff, count(*) FILTER (WHERE b IS NULL) AS only_a, 2::BIGINT AS head_a, 3::BIGINT AS head_b FROM p GROUP BY 1""")
def segment_summary(spark, sf_dir):
    (a, la), (b, lb) = chats(spark, sf_dir)
    return segments.segment_summary(segments.segment_compare(a, b), a, b, la, lb).select("pair_id", "segments_a", "segments_b", "equal", "diff", "only_a", "head_a", "head_b")


@query(f"""WITH {CHATS}, d AS (SELECT CAST(conv_id AS VARCHAR) AS key, sa.l AS a, sb.l AS b, unnest(CASE WHEN sb.l IS NULL THEN [NULL] ELSE list_filter(range(0, len(sa.l)), lambda i: sa.l[i + 1] <> sb.l[i + 1]) END) AS i FROM sa LEFT JOIN sb USING (conv_id))
  SELECT key, CAST(i + 1 AS INTEGER) AS line_no, CASE WHEN i IS NULL THEN array_to_string(a, chr(10)) ELSE a[i + 1] END AS a, coalesce(b[i + 1], '') AS b FROM d""")
def export_segment_diff(spark, sf_dir):
    (a, _), (b, _) = chats(spark, sf_dir)
    return segments.export_segment_diff(segments.segment_compare(a, b)).select("key", "line_no", "a", "b")


# ---- reports: customers by nation ----

GAP = 10_000_000_000
TEMPLATE = ["CUSTOMERS OF THE NATION", "NATION:", "NO| NAME| SEGMENT|", "------------------", "", "", "TOTAL-COUNT:"]


def report_lines(spark, sf_dir, changed: bool):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    c = table(spark, sf_dir, "customer")
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    if changed:
        c = c.where(k % 13 != 0)
        name, segment = F.when(k % 17 == 0, F.concat(name, F.lit("x"))).otherwise(name), F.when(k % 19 == 0, "NEW").otherwise(segment)
    at = lambda place: (n.cast("long") * GAP + place).alias("seq")
    rows = c.select(F.lit("r").alias("pair_id"), at(k + 4), F.concat_ws("| ", k.cast("string"), name, F.concat(segment, F.lit("|"))).alias("value"))
    count = c.groupBy("c_nationkey").agg((F.count("*") + F.when(n % 3 == 0, 1).otherwise(0)).alias("m"))
    nation = F.concat(F.lit("NATION: "), (n + (F.when(n % 4 == 0, 100).otherwise(0) if changed else 0)).cast("string"))
    fixed = [(0, F.lit(TEMPLATE[0])), (1, nation), (2, F.lit(TEMPLATE[2])), (3, F.lit(TEMPLATE[3])), (GAP - 3, F.lit("")), (GAP - 2, F.concat(F.lit("TOTAL-COUNT: "), F.col("m").cast("string"))), (GAP - 1, F.lit(" "))]
    frame = count.select(F.lit("r").alias("pair_id"), "c_nationkey", F.explode(F.array(*[F.struct(F.lit(p).cast("long").alias("p"), v.alias("value")) for p, v in fixed])).alias("x"))
    return rows.unionByName(frame.select("pair_id", at(F.col("x.p")), "x.value"))


def report(spark, sf_dir, changed: bool):
    return reports.scan_report_template(report_lines(spark, sf_dir, changed), TEMPLATE)


REPORTS = """ca AS (SELECT c_custkey AS k, c_nationkey AS n, c_name AS name, c_mktsegment AS seg FROM customer),
cb AS (SELECT k, n, CASE WHEN k % 17 = 0 THEN name || 'x' ELSE name END AS name, CASE WHEN k % 19 = 0 THEN 'NEW' ELSE seg END AS seg FROM ca WHERE k % 13 <> 0),
na AS (SELECT n, count(*) AS m, row_number() OVER (ORDER BY n) - 1 AS section FROM ca GROUP BY 1), nb AS (SELECT n, count(*) AS m, row_number() OVER (ORDER BY n) - 1 AS section FROM cb GROUP BY 1)"""


@query(f"WITH {REPORTS} SELECT CAST(section AS INTEGER) AS section, CAST(n AS BIGINT) * {GAP} + k + 5 AS line_no, k || '|' || name || '|' || seg AS fields FROM ca JOIN na USING (n)")
def scan_report_template(spark, sf_dir):
    return report(spark, sf_dir, False)[0].select("section", "line_no", joined("fields").alias("fields"))


@query(f"""WITH {REPORTS} SELECT CAST(section AS INTEGER) AS section, 'header' AS kind, 'CUSTOMERS OF THE NATION/NATION: ' || n || '/NO| NAME| SEGMENT|/------------------' AS lines FROM na
  UNION ALL SELECT CAST(section AS INTEGER), 'footer', '/TOTAL-COUNT: ' || (m + CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END) FROM na""")
def report_blocks(spark, sf_dir):
    return report(spark, sf_dir, False)[1].select("section", "kind", joined("lines", "/").alias("lines"))


ZONED = [*TEMPLATE[:4], "", " ", "", "", "", "TOTAL-COUNT:"]


@query(f"""WITH {REPORTS} SELECT CAST(section AS INTEGER) AS section, 'header' AS kind, 'CUSTOMERS OF THE NATION/NATION: ' || n || '/NO| NAME| SEGMENT|/------------------' AS lines, 0::BIGINT AS n FROM na
  UNION ALL SELECT CAST(section AS INTEGER), 'footer', 'TOTAL-COUNT: ' || (m + CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END), 0 FROM na UNION ALL SELECT CAST(section AS INTEGER), 'rows', string_agg(name, '/' ORDER BY k), count(*) FROM ca JOIN na USING (n) GROUP BY section""")
def scan_report_zoned(spark, sf_dir):
    """A template whose header and footer stand before and behind a run of blank lines."""
    rows, blocks, _ = reports.scan_report_template(report_lines(spark, sf_dir, False), ZONED)
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.get("fields", F.lit(1)).alias("name")))), lambda x: x["name"]), "/")
    rows = rows.groupBy("section").agg(F.lit("rows").alias("kind"), names.alias("lines"), F.count("*").alias("n"))
    return blocks.select("section", "kind", joined("lines", "/").alias("lines"), F.lit(0).cast("long").alias("n")).unionByName(rows.select("section", "kind", "lines", "n"))


@query(f"WITH {REPORTS} SELECT CAST(section AS INTEGER) AS section, CAST(m + CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS declared, m AS counted, n % 3 <> 0 AS ok FROM na")
def count_checks(spark, sf_dir):
    rows, blocks, _ = report(spark, sf_dir, False)
    return reports.count_checks(blocks, rows).drop("pair_id")


@query(f"""WITH {REPORTS} SELECT 'H' || (na.section + 1) AS key, CASE WHEN na.n % 4 = 0 THEN 'diff' ELSE 'equal' END AS status FROM na
  UNION ALL SELECT 'T' || (na.section + 1), CASE WHEN na.m = nb.m THEN 'equal' ELSE 'diff' END FROM na JOIN nb USING (n)""")
def block_compare_positional(spark, sf_dir):
    return reports.block_compare_positional(report(spark, sf_dir, False)[1], report(spark, sf_dir, True)[1]).select("key", "status")


@query(f"""WITH {REPORTS} SELECT CAST(k AS VARCHAR) AS key, CASE WHEN ca.name = cb.name AND ca.seg = cb.seg THEN 'equal' ELSE 'diff' END AS status,
  concat_ws(',', CASE WHEN ca.name <> cb.name THEN '1' END, CASE WHEN ca.seg <> cb.seg THEN '2' END) AS diff FROM ca JOIN cb USING (k)""")
def report_match_keyed(spark, sf_dir):
    r, _, _ = reports.report_match_keyed(report(spark, sf_dir, False)[0], report(spark, sf_dir, True)[0], [0])
    return r.select("key", "status", joined("diff_cols", ",").alias("diff"))


@query(f"""WITH {REPORTS} SELECT 'matched' AS part, count(*) AS n FROM ca JOIN cb USING (k, name, seg) UNION ALL SELECT 'left_a', count(*) FROM (SELECT k, name, seg FROM ca EXCEPT SELECT k, name, seg FROM cb)
  UNION ALL SELECT 'left_b', count(*) FROM (SELECT k, name, seg FROM cb EXCEPT SELECT k, name, seg FROM ca)""")
def report_match_whole_row(spark, sf_dir):
    r, a, b = reports.report_match_whole_row(report(spark, sf_dir, False)[0], report(spark, sf_dir, True)[0])
    n = lambda d, x: d.agg(F.lit(x).alias("part"), F.count("*").alias("n"))
    return n(r, "matched").unionByName(n(a, "left_a")).unionByName(n(b, "left_b"))


def similar_names(spark, sf_dir):
    """All suppliers against B's: names are a letter longer, a sixth are others under other numbers.

    Numbers and names are hashed, so that different suppliers aren't similar; all of a nation share its name, so they
    are candidates of each other."""
    s = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    number, name = F.col("s_suppkey").cast("string"), F.col("s_name")
    side = lambda number, name: s.select(F.lit("s").alias("pair_id"), F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("ord"), F.array(F.md5(number.cast("binary")), name, "n_name").alias("fields")).withColumn("raw", F.array_join("fields", "|"))
    hashed = lambda c: F.md5(c.cast("binary"))
    other = F.col("s_suppkey") % 6 == 4
    return side(number, hashed(name)), side(F.when(other, F.concat(F.lit("x"), number)).otherwise(number), F.when(other, hashed(F.concat(F.lit("y"), name))).otherwise(F.concat(hashed(name), F.lit("~"))))


@query("""WITH s AS (SELECT s_suppkey AS k, md5(CAST(s_suppkey AS VARCHAR)) || '|' || md5(s_name) || '|' || n_name AS a, md5('x' || s_suppkey) || '|' || md5('y' || s_name) || '|' || n_name AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey)
  SELECT a AS key, CASE WHEN k % 6 = 4 THEN 'unmatched_a' ELSE 'diff' END AS status, CASE WHEN k % 6 = 4 THEN '' ELSE '1' END AS diff FROM s UNION ALL SELECT b, 'unmatched_b', '' FROM s WHERE k % 6 = 4""")
def partial_match(spark, sf_dir):
    return partial.partial_match(*similar_names(spark, sf_dir)).select("key", "status", joined("diff_cols", ",").alias("diff"))


@query(f"""WITH {REPORTS} SELECT (SELECT count(*) FROM na) AS sections_a, (SELECT count(*) FROM nb) AS sections_b, (SELECT count(*) FROM ca) AS rows_a, (SELECT count(*) FROM cb) AS rows_b,
  (SELECT count(*) FROM na WHERE n % 4 = 0) AS header_line_diff, (SELECT count(*) FROM na JOIN nb USING (n) WHERE na.m <> nb.m) AS footer_line_diff,
  count(*) FILTER (WHERE ca.name = cb.name AND ca.seg = cb.seg) AS equal, count(*) FILTER (WHERE ca.name <> cb.name OR ca.seg <> cb.seg) AS partial FROM ca JOIN cb USING (k)""")
def report_summary(spark, sf_dir):
    (ra, ba, _), (rb, bb, _) = report(spark, sf_dir, False), report(spark, sf_dir, True)
    r, _, _ = reports.report_match_keyed(ra, rb, [0])
    s = reports.report_summary(reports.block_compare_positional(ba, bb), r, ra, rb, ba, bb)
    return s.select("sections_a", "sections_b", "rows_a", "rows_b", "header_line_diff", "footer_line_diff", "equal", "partial")


@query(f"""WITH {REPORTS}, d AS (SELECT k, ca.name AS an, cb.name AS bn, ca.seg AS sa, cb.seg AS sb FROM ca JOIN cb USING (k))
  SELECT CAST(k AS VARCHAR) AS key, 2 AS no, '栏位2' AS name, an AS a, bn AS b FROM d WHERE an <> bn UNION ALL SELECT CAST(k AS VARCHAR), 3, '栏位3', sa, sb FROM d WHERE sa <> sb""")
def export_report_diff(spark, sf_dir):
    r, _, _ = reports.report_match_keyed(report(spark, sf_dir, False)[0], report(spark, sf_dir, True)[0], [0])
    return reports.export_report_diff(r).select("key", "no", "name", "a", "b")


def control_lines(spark, sf_dir, changed: bool = False):
    """A section for each nation with records of two lines; the changed side has other products and totals for some."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    c = table(spark, sf_dir, "customer")
    at = lambda place: (n.cast("long") * GAP + place).alias("seq")
    line = lambda p, v: F.struct(F.lit(p).cast("long").alias("p"), v.alias("value"))
    product = F.when(F.lit(changed) & (n % 5 == 0), "Q").otherwise("P")
    head = [F.concat((n + 1).cast("string"), F.lit("@OD@|PRODUCT:"), product, n.cast("string"), F.lit("|")), F.lit("  LIST"), F.concat(F.lit("BRCH : "), n.cast("string")), F.lit(""), F.lit("ACCOUNT  NAME"), F.lit("SEGMENT"), F.lit("---------------")]
    heads = c.select("c_nationkey").distinct().select("c_nationkey", F.explode(F.array(*[line(i, v) for i, v in enumerate(head)])).alias("x"))
    from pyspark.sql import Window

    # a section's records stand close together, so they are numbered within their nation
    nth = (F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1).cast("long")
    rows = c.withColumn("i", nth).select("c_nationkey", F.explode(F.array(F.struct((F.col("i") * 2 + 7).alias("p"), F.concat(k.cast("string"), F.lit("  "), "c_name").alias("value")), F.struct((F.col("i") * 2 + 8).alias("p"), F.concat(F.lit("    "), "c_mktsegment").alias("value")))).alias("x"))
    end = c.groupBy("c_nationkey").agg(F.count("*").alias("m")).select("c_nationkey", F.struct((F.col("m") * 2 + 7).alias("p"), F.concat(F.lit("Total QTY: "), (F.col("m") + F.when(F.lit(changed) & (n % 4 == 1), 1).otherwise(0)).cast("string")).alias("value")).alias("x"))
    return heads.unionByName(rows).unionByName(end).select(F.lit("r").alias("pair_id"), at(F.col("x.p")), "x.value")


@query(f"WITH {REPORTS} SELECT CAST(section AS INTEGER) AS section, k || '|' || name || '|' || seg AS fields, 2 AS fold FROM ca JOIN na USING (n)")
def scan_report_control(spark, sf_dir):
    return reports.scan_report_control(control_lines(spark, sf_dir))[0].select("section", joined("fields").alias("fields"), F.size("display").alias("fold"))


@query("SELECT CAST(pos AS INTEGER) AS pos, name FROM (VALUES (0, 'ACCOUNT'), (1, 'NAME'), (2, '行2·SEGMENT')) t(pos, name) WHERE (SELECT count(*) FROM customer) > 0")
def report_column_names(spark, sf_dir):
    """From the folded header of the first section."""
    return reports.report_column_names(reports.scan_report_control(control_lines(spark, sf_dir))[1]).select("pos", "name")


@query(f"""WITH {REPORTS}, k AS (SELECT *, unnest(['header', 'footer']) AS kind FROM na)
  SELECT 'P' || n || '·' || (section + 1) AS key, kind, CASE WHEN n % 5 = 0 THEN 'unmatched_a' WHEN kind = 'footer' AND n % 4 = 1 THEN 'diff' ELSE 'equal' END AS status FROM k
  UNION ALL SELECT 'Q' || n || '·' || (section + 1) || 'B', kind, 'unmatched_b' FROM k WHERE n % 5 = 0""")
def block_compare_signature(spark, sf_dir):
    a, b = (reports.scan_report_control(control_lines(spark, sf_dir, x))[1] for x in (False, True))
    return reports.block_compare_signature(a, b).select("key", F.col("section").alias("kind"), "status")


@query(f"""WITH {REPORTS}, t AS (SELECT section, 'header' AS kind, 1 AS pos, 'NATION: ' || n AS a, 'NATION: ' || (n + CASE WHEN n % 4 = 0 THEN 100 ELSE 0 END) AS b FROM na
  UNION ALL SELECT na.section, 'footer', 1, 'TOTAL-COUNT: ' || (na.m + CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END), 'TOTAL-COUNT: ' || (nb.m + CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END) FROM na JOIN nb USING (n))
  SELECT CASE kind WHEN 'header' THEN 'H' ELSE 'T' END || (section + 1) AS key, kind, CAST(pos + 1 AS BIGINT) AS line_no, a, b FROM t WHERE a <> b""")
def template_lines_apart(spark, sf_dir):
    """Differing lines of headers and footers, which no row holds."""
    sides = [reports.report_template_lines(report_lines(spark, sf_dir, x), TEMPLATE)[1:3] for x in (False, True)]
    return reports.compare_block_lines(*sides)[1].select("key", F.col("section").alias("kind"), "line_no", "a", "b")


@query(f"""WITH {REPORTS}, k AS (SELECT *, unnest(['header', 'footer']) AS kind FROM na), s AS (SELECT n, m, section, kind, CASE kind WHEN 'header' THEN 7 ELSE 1 END AS n_lines FROM k)
  SELECT 'P' || n || '·' || (section + 1) AS key, kind, CASE WHEN n % 5 = 0 THEN 'unmatched_a' WHEN kind = 'footer' AND n % 4 = 1 THEN 'diff' ELSE 'equal' END AS status, CAST(n_lines AS BIGINT) AS n_a,
    CASE WHEN n % 5 <> 0 THEN CAST(n_lines AS BIGINT) END AS n_b, CAST(CASE WHEN n % 5 <> 0 AND kind = 'footer' AND n % 4 = 1 THEN 1 ELSE 0 END AS BIGINT) AS n_diff FROM s
  UNION ALL SELECT 'Q' || n || '·' || (section + 1) || 'B', kind, 'unmatched_b', NULL, CAST(n_lines AS BIGINT), 0 FROM s WHERE n % 5 = 0""")
def control_blocks_by_print(spark, sf_dir):
    """Blocks of self-describing reports by their control lines, compared by fingerprints."""
    sides = [reports.report_control_lines(control_lines(spark, sf_dir, x))[1:3] for x in (False, True)]
    return reports.compare_block_lines(*sides, by_signature=True)[0].select("key", F.col("section").alias("kind"), "status", "n_a", "n_b", "n_diff")


@query("SELECT CAST(c_custkey AS VARCHAR) AS pair_id, CASE c_custkey % 5 WHEN 0 THEN 'zoned' WHEN 1 THEN 'control' WHEN 2 THEN 'control' WHEN 3 THEN 'template' END AS format, CASE WHEN c_custkey % 5 = 4 THEN 'no template' END AS error FROM customer")
def report_format(spark, sf_dir):
    """A pair for each customer, with templates, control lines or neither."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", k.cast("string").alias("pair_id"))
    lines = lambda on, values: c.where(on).select("pair_id", F.posexplode(values).alias("seq", "value"))
    text = lambda *x: F.array(*[F.lit(v) for v in x])
    templates = lines((k % 5).isin(0, 1, 3), F.when(k % 5 == 0, text("HEAD", "", " ", "", "", "", "FOOT")).otherwise(text("HEAD", "", "", "", "", "FOOT", "", "", "", "", "")))
    marked = text(" 12@OD@|RPT-ID:X|", "row")
    a, b = lines(k % 5 != 2, F.when(k % 5 < 2, marked).otherwise(text("row"))), lines(k % 5 == 2, marked)
    return reports.report_format(c, templates, a, b)


@query(f"""WITH {REPORTS}, d AS (SELECT k, ca.name AS an, cb.name AS bn, ca.seg AS sa, cb.seg AS sb FROM ca JOIN cb USING (k)),
  x AS (SELECT CAST(k AS VARCHAR) AS key, 2 AS no, an AS a, bn AS b FROM d WHERE an <> bn UNION ALL SELECT CAST(k AS VARCHAR), 3, sa, sb FROM d WHERE sa <> sb)
  SELECT * FROM x ORDER BY key, no LIMIT 5000""")
def report_batch_detail(spark, sf_dir):
    """The first 5,000 lines are the feature: a sheet for reading."""
    r, _, _ = reports.report_match_keyed(report(spark, sf_dir, False)[0], report(spark, sf_dir, True)[0], [0])
    return reports.report_batch_detail(r.groupBy("pair_id").count(), r)[1].select("key", "no", "a", "b")


# ---- charsets: a part's lines as a small file in one of several ----


@contextmanager
def charsets(spark):
    """The session as the charsets need it, while expressions are made."""
    old = {k: spark.conf.get(k, None) for k in scan.SETTINGS}
    for k, v in scan.SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@query("SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'cp037' WHEN 2 THEN 'utf-16le' ELSE 'gb18030' END AS encoding FROM part")
def detect_encoding(spark, sf_dir):
    with charsets(spark):
        p = table(spark, sf_dir, "part")
        k = F.col("p_partkey")
        text = F.concat_ws(" | ", k.cast("string"), "p_name", F.when(k % 4 == 3, "中文汉字栏位").otherwise(F.col("p_brand")), "p_type")
        h = F.when(k % 4 == 0, F.encode(text, "UTF-8")).when(k % 4 == 1, F.encode(text, "IBM037")).when(k % 4 == 2, F.encode(text, "UTF-16LE")).otherwise(F.encode(text, "GB18030"))
        out = charset.choose_encoding(p.select(k.alias("file_path"), h.alias("h")), " | ")
        return out.select(F.col("file_path").alias("k"), "encoding")


@query("SELECT p_partkey AS k, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN '中文' || p_brand ELSE p_brand END AS brand FROM part")
def transcode_fields(spark, sf_dir):
    """Brands in another charset inside a host file: read by the host's, put right by column."""
    with charsets(spark):
        p = table(spark, sf_dir, "part")
        k = F.col("p_partkey")
        right = F.when(k % 2 == 0, F.concat(F.lit("中文"), "p_brand")).otherwise(F.col("p_brand"))
        wrong = F.decode(F.encode(F.concat(right, F.lit("  ")), "GB18030"), "ISO-8859-1")
        data = p.select(k.alias("k"), F.array("p_name", wrong).alias("cols"))
        out = charset.transcode_fields(data, "latin-1", {1: "gb18030"})
        return out.select("k", F.get("cols", F.lit(0)).alias("name"), F.get("cols", F.lit(1)).alias("brand"))
