"""Registered queries on rules, filters, monitors, features, exports and pairing of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import export, features, filters, monitor, pairing, rules, summary
from ..functions import strings as S
from ..sources import lookups, scan
from .pairs import NAMES, PAIR, RESULTS, order_pair, scratch, table
from .queries import joined, order_results, query

# ---- rules: a line for each supplier ----


def rule_lines(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    text = F.concat(
        F.lit(" => "), F.concat(F.lit("N"), n.cast("string")), F.lit(":S*_"), (k % 7).cast("string"), F.lit(".txt:KEYSEQ="), (n + 1).cast("string"), F.lit("/2/1/2:DELIM= | :SRCA=old:PRISEQ="),
        (k % 7).cast("string"), F.when(k % 5 == 0, ":ADDMOD=3,2,3").otherwise(""),
    )
    lines = s.select(F.concat(F.lit("f"), (k % 3).cast("string")).alias("file"), (k % 3).alias("file_order"), k.alias("line_no"), F.when(k % 11 == 0, "# note").when(k % 13 == 0, "").otherwise(text).alias("value"))
    return lines


def parsed(spark, sf_dir):
    return rules.rules_from_lines(rule_lines(spark, sf_dir))


RULES = """r AS (SELECT 'f' || (s_suppkey % 3) AS file, s_suppkey % 3 AS file_order, s_suppkey AS line_no, 'N' || s_nationkey AS nickname, 'S*_' || (s_suppkey % 7) || '.txt' AS "glob",
  list_sort(list_distinct([s_nationkey, 1, 0])) AS keys, s_suppkey % 7 AS priority, CASE WHEN s_suppkey % 5 = 0 THEN '2,1' ELSE '' END AS incremental,
  CASE WHEN s_suppkey % 7 NOT BETWEEN 1 AND 5 THEN 'bad priority' END AS error FROM supplier WHERE s_suppkey % 11 <> 0 AND s_suppkey % 13 <> 0)"""


@query(f"""WITH {RULES} SELECT file, line_no, nickname, "glob", array_to_string(keys, ',') AS keys, ' | ' AS delim, 'old' AS source_a, 'B' AS source_b, CAST(priority AS INTEGER) AS priority, incremental, error FROM r""")
def rules_from_lines(spark, sf_dir):
    return parsed(spark, sf_dir).select("file", "line_no", "nickname", "glob", joined("keys", ",").alias("keys"), "delim", "source_a", "source_b", "priority", joined("incremental", ",").alias("incremental"), "error")


@query(f"""WITH {RULES} SELECT nickname, "glob", file, line_no FROM r WHERE error IS NULL QUALIFY row_number() OVER (PARTITION BY nickname, "glob" ORDER BY file_order, line_no) = 1""")
def effective_rules(spark, sf_dir):
    return rules.effective_rules(parsed(spark, sf_dir))[0].select("nickname", "glob", "file", "line_no")


@query(f"""WITH {RULES} SELECT nickname, "glob", count(*) AS n, string_agg(DISTINCT file, ',' ORDER BY file) AS files FROM r WHERE error IS NULL GROUP BY 1, 2 HAVING count(*) > 1""")
def repeated_rules(spark, sf_dir):
    return rules.effective_rules(parsed(spark, sf_dir))[1]


def groups(spark, sf_dir):
    n = table(spark, sf_dir, "supplier").select("s_nationkey").distinct()
    text = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")))), "、")
    rows = n.groupBy(F.concat(F.lit("g"), (F.col("s_nationkey") % 5).cast("string")).alias("group_name")).agg(F.concat(text, F.lit("; ZZ ,")).alias("members")).withColumn("row_no", F.lit(1))
    return rules.load_compare_groups(rows)


@query(f"""WITH {RULES} SELECT nickname, "glob", line_no FROM r WHERE CAST(substr(nickname, 2) AS INTEGER) % 5 = 2""")
def scope_rules(spark, sf_dir):
    return rules.scope_rules(parsed(spark, sf_dir), groups(spark, sf_dir), "g2").select("nickname", "glob", "line_no")


@query(f"WITH {RULES} SELECT DISTINCT 'g' || (s_nationkey % 5) AS group_name, 'ZZ' AS member FROM supplier UNION SELECT 'g' || (s_nationkey % 5), 'n' || s_nationkey FROM supplier WHERE 'N' || s_nationkey NOT IN (SELECT nickname FROM r)")
def group_members_missing(spark, sf_dir):
    return rules.group_members_missing(groups(spark, sf_dir), parsed(spark, sf_dir))


@query("""SELECT 'S' || s_suppkey AS nickname, CASE WHEN s_suppkey % 10 = 0 THEN '缺失' WHEN s_suppkey % 10 = 1 THEN '新增' WHEN s_suppkey % 10 = 2 THEN '已修改' ELSE '一致' END AS status FROM supplier""")
def rule_baseline_diff(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("nickname"))
    line = lambda on, extra: s.where(on).select("nickname", F.concat("nickname", F.lit(":x*"), extra).alias("line"))
    return rules.rule_baseline_diff(line(F.col("k") % 10 != 1, F.lit("")), line(F.col("k") % 10 != 0, F.when(F.col("k") % 10 == 2, "*").otherwise("")))


# ---- filters ----


@query(f"WITH {PAIR} SELECT seq, c[1] AS key FROM b WHERE c[3] IN ('F', 'P') AND c[6] IN ('1-URGENT', '9-X')")
def incremental_filter(spark, sf_dir):
    b = order_pair(spark, sf_dir)[1]
    return filters.incremental_filter(b, [2, 4, 5], ["F, P", " ", "1-URGENT,9-X"]).select("seq", F.get("cols", F.lit(0)).alias("key"))


@query(f"WITH {PAIR} SELECT (SELECT count(*) FROM a) AS before_a, (SELECT count(*) FROM a WHERE c[3] = 'F') AS after_a, (SELECT count(*) FROM b) AS before_b, (SELECT count(*) FROM b WHERE c[3] = 'F') AS after_b, '增量' AS label")
def incremental_counts(spark, sf_dir):
    a, b = order_pair(spark, sf_dir)
    cut = lambda d: filters.incremental_filter(d, [2], ["F"])
    return filters.incremental_counts(a, cut(a), b, cut(b)).drop("pair_id")


@query(f"WITH {PAIR} SELECT seq, regexp_replace(regexp_replace(c[6], '([0-9])-(.*)', '\\2\\1'), 'X', 'Y', 'g') AS priority, regexp_replace(c[4], '\\..*', '') AS price FROM b")
def regex_replace_columns(spark, sf_dir):
    b = filters.regex_replace_columns(order_pair(spark, sf_dir)[1], {5: [(r"([0-9])-(.*)", "$2$1"), ("X", "Y")], 3: [(r"\..*", "")]})
    return b.select("seq", F.get("cols", F.lit(5)).alias("priority"), F.get("cols", F.lit(3)).alias("price"))


SPLIT = [
    filters.Rule("returned", "all", (filters.Cond(3, "eq", "R"),)),
    filters.Rule("bulk", "all", (filters.Cond(2, "range", "40~"), filters.Cond(4, "prefix", "O"))),
    filters.Rule("odd", "any", (filters.Cond(2, "range", "~5.5"), filters.Cond(1, "suffix", "7"), filters.Cond(1, "regex", "^9+$"), filters.Cond(1, "contains", "88"))),
]
ROUTE = """l AS (SELECT CAST(l_orderkey AS VARCHAR) AS k, l_linenumber AS n, CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN l_quantity >= 40 AND l_linestatus = 'O' THEN 'bulk'
  WHEN l_quantity <= 5.5 OR k LIKE '%7' OR regexp_matches(k, '^9+$') OR k LIKE '%88%' THEN 'odd' ELSE '其他' END AS grp FROM lineitem)"""


def routed(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.lit("lines").alias("pair_id"), "l_linenumber", F.array(F.col("l_orderkey").cast("string"), F.col("l_quantity").cast("decimal(18,2)").cast("string"), "l_returnflag", "l_linestatus").alias("cols"))
    return filters.split_route(rows, SPLIT)


@query(f"WITH {ROUTE} SELECT k, CAST(n AS INTEGER) AS n, grp FROM l")
def split_route(spark, sf_dir):
    return routed(spark, sf_dir).select(F.get("cols", F.lit(0)).alias("k"), F.col("l_linenumber").alias("n"), "grp")


@query(f"WITH {ROUTE} SELECT grp, count(*) AS n FROM l GROUP BY 1")
def split_counts(spark, sf_dir):
    return filters.split_counts(routed(spark, sf_dir), SPLIT).drop("pair_id")


@query(f"WITH {RESULTS} SELECT key, status FROM res WHERE status IN ('unmatched_a', 'unmatched_b')")
def zone_filter(spark, sf_dir):
    return filters.zone_filter(order_results(spark, sf_dir), "unmatched").select("key", "status")


@query(f"WITH {RESULTS} SELECT key, status FROM res WHERE contains(key, '77')")
def section_filter(spark, sf_dir):
    return filters.section_filter(order_results(spark, sf_dir), "data", "77").select("key", "status")


def notes(spark, sf_dir):
    r = order_results(spark, sf_dir).where("status = 'diff'").select("pair_id", "key", F.lit("diff").alias("zone")).distinct()
    old = r.select("*", F.lit("first").alias("note"), F.lit(1).alias("at"))
    new = r.where(F.col("key").endswith("3")).select("*", F.lit("second").alias("note"), F.lit(2).alias("at"))
    return filters.annotate_results(old, new)


NOTES = f"{RESULTS}, notes AS (SELECT DISTINCT key, 'diff' AS zone, CASE WHEN ends_with(key, '3') THEN 'second' ELSE 'first' END AS note FROM res WHERE status = 'diff')"


@query(f"WITH {NOTES} SELECT key, status FROM res WHERE contains(key, '1') AND key NOT IN (SELECT key FROM notes)")
def search_results(spark, sf_dir):
    return filters.search_results(order_results(spark, sf_dir), "1", "none", notes(spark, sf_dir)).select("key", "status")


@query(f"WITH {NOTES} SELECT * FROM notes")
def annotate_results(spark, sf_dir):
    return notes(spark, sf_dir).select("key", "zone", "note")


@query(f"WITH {NOTES} SELECT key, zone, note FROM notes UNION ALL SELECT DISTINCT key, status, 'bulk' FROM res WHERE contains(key, '55') AND (key, status) NOT IN (SELECT (key, zone) FROM notes)")
def annotate_matching(spark, sf_dir):
    return filters.annotate_matching(notes(spark, sf_dir), order_results(spark, sf_dir), "55", "bulk", 3).select("key", "zone", "note")


@query(f"WITH {NOTES} SELECT zone, count(*) AS n FROM notes GROUP BY 1")
def note_counts(spark, sf_dir):
    return filters.note_counts(notes(spark, sf_dir)).drop("pair_id")


@query(f"WITH {RESULTS} SELECT key, status FROM res WHERE seq IS NOT NULL ORDER BY seq LIMIT 100 OFFSET 200")
def page_results(spark, sf_dir):
    """A page is the feature here."""
    return filters.page_results(order_results(spark, sf_dir), 200, 100, "seq").select("key", "status")


# ---- monitored columns ----


def verdicts(spark, sf_dir):
    a, b = order_pair(spark, sf_dir)
    f = spark.createDataFrame([("orders", 2, 1), ("orders", 5, 2), ("orders", 0, 4), ("orders", 3, 3), ("orders", 9, 2)], "pair_id string, col int, field_type int")
    return monitor.monitor_verdict(f, monitor.monitor_values(a, f), monitor.monitor_values(b, f))


def _values(side: str) -> str:
    parts = [f"SELECT {c} AS col, c[{c + 1}] AS value, seq FROM {side}" for c in (2, 5, 0, 3)] + [f"SELECT 9, '', seq FROM {side}"]
    return f"""{side}v AS (SELECT col, list(value ORDER BY first, value) AS values, count(*) AS n FROM (SELECT col, value, min(seq) AS first FROM ({' UNION ALL '.join(parts)}) GROUP BY 1, 2
      QUALIFY row_number() OVER (PARTITION BY col ORDER BY min(seq), value) <= 1001) GROUP BY 1)"""


@query(f"WITH {PAIR}, {_values('b')} SELECT CAST(col AS INTEGER) AS col, array_to_string(values[:1000], ',') AS values, n > 1000 AS truncated FROM bv")
def monitor_values(spark, sf_dir):
    f = spark.createDataFrame([("orders", c) for c in (2, 5, 0, 3, 9)], "pair_id string, col int")
    return monitor.monitor_values(order_pair(spark, sf_dir)[1], f).select("col", joined("values", ",").alias("values"), "truncated")


@query(f"""WITH {PAIR}, {_values('a')}, {_values('b')}, t(col, field_type) AS (VALUES (2, 1), (5, 2), (0, 4), (3, 3), (9, 2)),
  m AS (SELECT t.col, field_type, len(list_filter(bv.values[:1000], lambda x: NOT list_contains(av.values[:1000], x))) = 0 AS inside, len(list_filter(av.values[:1000], lambda x: NOT list_contains(bv.values[:1000], x))) = 0 AS back FROM t JOIN av USING (col) JOIN bv USING (col))
  SELECT col, field_type, CASE WHEN field_type = 3 THEN NULL WHEN field_type = 2 THEN inside AND back ELSE inside END AS matched,
    CASE WHEN field_type = 3 THEN '不监控' WHEN field_type = 2 THEN CASE WHEN inside AND back THEN '新旧线一致' ELSE '新旧线不一致' END WHEN inside THEN '新线输出正常' ELSE '新线不为旧线子集' END AS verdict FROM m""")
def monitor_verdict(spark, sf_dir):
    return verdicts(spark, sf_dir).select("col", "field_type", "matched", "verdict")


def _cell(x: str) -> str:
    shown = f"array_to_string(list_transform({x}v.values[:1000], lambda v: CASE WHEN v = '' THEN '（空）' WHEN regexp_full_match(v, '[0-9]{{16,}}') THEN '=\"' || v || '\"' ELSE v END), '、')"
    return f"CASE WHEN field_type = 3 THEN '（不监控：无法对比，仅报表展示）' ELSE {shown} || CASE WHEN {x}v.n > 1000 THEN '…（超出 1000 个已截断）' ELSE '' END END AS values_{x}"


@query(f"""WITH {PAIR}, {_values('a')}, {_values('b')}, t(col, field_type) AS (VALUES (2, 1), (5, 2), (0, 4), (3, 3), (9, 2)),
  m AS (SELECT t.col, field_type, {_cell('a')}, {_cell('b')}, len(list_filter(bv.values[:1000], lambda x: NOT list_contains(av.values[:1000], x))) = 0 AS inside, len(list_filter(av.values[:1000], lambda x: NOT list_contains(bv.values[:1000], x))) = 0 AS back FROM t JOIN av USING (col) JOIN bv USING (col))
  SELECT col, field_type, values_a, values_b, CASE WHEN field_type = 3 THEN '不监控' WHEN field_type = 2 THEN CASE WHEN inside AND back THEN '新旧线一致' ELSE '新旧线不一致' END WHEN inside THEN '新线输出正常' ELSE '新线不为旧线子集' END AS verdict FROM m""")
def export_monitor(spark, sf_dir):
    return export.export_monitor(verdicts(spark, sf_dir)).drop("pair_id")


# ---- features ----

CELLS = f"{RESULTS}, cells AS (SELECT i AS col, seq, key, ac[i + 1] AS a, bc[i + 1] AS b FROM (SELECT *, unnest(diff) AS i FROM res WHERE status = 'diff')), smp AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY seq, key) AS n FROM cells QUALIFY n <= 30)"


@query(f"""WITH {CELLS}, p AS (SELECT col, a, b, count(*) AS n FROM cells GROUP BY ALL), top AS (SELECT col, string_agg(a || '>' || b || '=' || n, ';' ORDER BY n DESC, a, b) AS top_patterns FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY col ORDER BY n DESC, a, b) <= 8) GROUP BY 1),
  tot AS (SELECT col, CAST(sum(n) AS BIGINT) AS count, CAST(coalesce(sum(n) FILTER (WHERE trim(a) = ''), 0) AS BIGINT) AS empty_a, CAST(coalesce(sum(n) FILTER (WHERE trim(b) = ''), 0) AS BIGINT) AS empty_b, count(*) AS kinds FROM p GROUP BY 1),
  s AS (SELECT col, count(*) FILTER (WHERE regexp_full_match(a, '[0-9]+(\\.[0-9]+)?') AND regexp_full_match(b, '[0-9]+(\\.[0-9]+)?')) AS numeric_pairs, count(*) FILTER (WHERE length(a) < length(b)) AS grows, count(*) FILTER (WHERE length(a) > length(b)) AS shrinks FROM smp GROUP BY 1)
  SELECT CAST(col AS INTEGER) AS col, count, empty_a, empty_b, kinds, top_patterns, numeric_pairs, grows, shrinks FROM tot JOIN top USING (col) JOIN s USING (col)""")
def diff_features(spark, sf_dir):
    out = features.diff_features(order_results(spark, sf_dir))
    return out.select("col", "count", "empty_a", "empty_b", "kinds", "top_patterns", "numeric_pairs", "grows", "shrinks")


@query(f"""WITH {CELLS}, d AS (SELECT col, CAST(b AS DECIMAL(18,2)) - CAST(a AS DECIMAL(18,2)) AS d, count(*) AS n, min(n) AS first FROM smp WHERE regexp_full_match(a, '[0-9]+(\\.[0-9]+)?') AND regexp_full_match(b, '[0-9]+(\\.[0-9]+)?') GROUP BY 1, 2)
  SELECT CAST(col AS INTEGER) AS col, CASE WHEN d >= 0 THEN '+' ELSE '' END || CAST(d AS VARCHAR) AS delta, n FROM d QUALIFY row_number() OVER (PARTITION BY col ORDER BY n DESC, first) = 1 AND n * 2 > sum(n) OVER (PARTITION BY col) AND sum(n) OVER (PARTITION BY col) >= 2""")
def numeric_delta_mode(spark, sf_dir):
    return features.numeric_delta_mode(order_results(spark, sf_dir)).drop("pair_id")


@query(f"""WITH {RESULTS}, f AS (SELECT CAST(col AS INTEGER) AS col, count(*) AS n FROM (SELECT unnest(diff) AS col FROM res) GROUP BY 1), na AS (SELECT count(*) AS na FROM a), nb AS (SELECT count(*) AS nb FROM b)
  SELECT col, n, n * 100.0::DOUBLE / nb AS percent, (nb - na)::DOUBLE / greatest(1, na) AS count_change FROM f, na, nb""")
def diff_column_overview(spark, sf_dir):
    a, b = order_pair(spark, sf_dir)
    n = lambda d, x: d.groupBy("pair_id").agg(F.count("*").alias(x))
    return features.diff_column_overview(summary.diff_column_freq(order_results(spark, sf_dir)), n(a, "data_rows_a").join(n(b, "data_rows_b"), "pair_id")).drop("pair_id")


@query()
def cell_diff_spans(spark, sf_dir):
    return features.cell_diff_spans(order_results(spark, sf_dir)).select("col", "a", "b", "n", F.to_json("spans").alias("spans"))


# ---- exports ----

LABEL = "array_to_string(list_transform(diff, lambda i: (i + 1) || '-' || [" + ", ".join(f"'{n}'" for n in NAMES) + "][i + 1] || '；'), '')"


@query(f"""WITH {RESULTS} SELECT key, CASE status WHEN 'equal' THEN '完全匹配' WHEN 'unmatched_a' THEN '仅old存在' ELSE '仅new存在' END AS status, '' AS diff, 0 AS line, array_to_string(coalesce(ac, bc), '|') AS row FROM res WHERE status <> 'diff'
  UNION ALL SELECT key, '有差异·old', {LABEL}, 0, array_to_string(ac, '|') FROM res WHERE status = 'diff' UNION ALL SELECT key, '有差异·new', {LABEL}, 1, array_to_string(bc, '|') FROM res WHERE status = 'diff'""")
def export_full_csv(spark, sf_dir):
    out = export.export_full_csv(order_results(spark, sf_dir), NAMES, "old", "new")
    return out.select("key", "status", "diff", "line", joined("values").alias("row"))


@query(f"""WITH {RESULTS} SELECT key, CASE status WHEN 'diff' THEN '有差异' WHEN 'unmatched_a' THEN '仅A存在' ELSE '仅B存在' END AS status,
  CASE status WHEN 'diff' THEN array_to_string(list_transform(diff, lambda i: CASE i WHEN 5 THEN '[1-废弃字段' WHEN 2 THEN '[4-数据治理' ELSE '[栏位不一致' END || ' @' || (i + 1) || '] A:''' || ac[i + 1] || ''' B:''' || bc[i + 1] || ''''), chr(10))
    WHEN 'unmatched_a' THEN '[仅A存在] A:''' || key || ''' B:''''' ELSE '[仅B存在] A:'''' B:''' || key || '''' END AS detail FROM res WHERE status <> 'equal'""")
def export_diff_records(spark, sf_dir):
    m = spark.createDataFrame([("orders", 5, 1), ("orders", 2, 4), ("orders", 3, 0)], "pair_id string, col int, field_type int")
    return export.export_diff_records(order_results(spark, sf_dir), m).select("key", "status", "detail")


@query(f"WITH {CELLS} SELECT key, CAST(col + 1 AS INTEGER) AS no, [{', '.join(f"'{n}'" for n in NAMES)}][col + 1] AS name, a, b FROM cells")
def export_diff_fields(spark, sf_dir):
    return export.export_diff_fields(order_results(spark, sf_dir), NAMES).drop("pair_id", "seq", "label")


@query(f"""WITH {RESULTS}, x AS (SELECT key, status, ac, bc, unnest(CASE WHEN status = 'diff' THEN diff ELSE [-1] END) AS i FROM res WHERE status <> 'equal')
  SELECT key, CASE status WHEN 'diff' THEN '栏位不一致' WHEN 'unmatched_a' THEN '仅A存在' ELSE '仅B存在' END AS kind, CAST(i + 1 AS INTEGER) AS column_no,
    CASE WHEN status = 'diff' THEN 'A:''' || ac[i + 1] || ''' B:''' || bc[i + 1] || '''' WHEN status = 'unmatched_a' THEN 'A:''' || array_to_string(ac, ' | ') || '''' ELSE 'B:''' || array_to_string(bc, ' | ') || '''' END AS content,
    '20260231' AS date, '#DATE' AS wildcard, 'txt' AS extension, 'ORD' AS nickname, 'team 1' AS team, 'CTS' AS type FROM x""")
def export_cases(spark, sf_dir):
    pairs = spark.createDataFrame([("orders", "b1", 1, "ORD", "orders_#DATE_.txt", "orders_20260231_20269999", "orders.txt", "team 1", "CTS")], "pair_id string, batch string, round int, nickname string, glob string, file_a string, file_b string, team string, type string")
    return export.export_cases(order_results(spark, sf_dir), pairs).drop("pair_id", "seq", "batch", "round", "column")


@query(f"WITH {PAIR} SELECT seq, CAST((row_number() OVER (ORDER BY seq) - 1) // 20000 AS INTEGER) AS part FROM b")
def export_parts(spark, sf_dir):
    return export.export_parts(order_pair(spark, sf_dir)[1], "seq").select("seq", "part")


# ---- files: a listing made of customers and parts ----


def listings(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("C"), F.col("c_custkey").cast("string"), F.lit("_"), F.col("c_nationkey").cast("string"), F.lit(".txt")).alias("name"))
    side = lambda on, x: c.where(on).select("name", F.concat(F.lit(f"/{x}/"), "name").alias("path"))
    r = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("nickname"), F.concat(F.lit("c?*_"), F.col("n_nationkey").cast("string"), F.lit(".TXT")).alias("glob"))
    return side(F.col("k") % 5 != 0, "a"), side(F.col("k") % 7 != 0, "b"), r


FILES = "f AS (SELECT c_custkey AS k, c_nationkey AS n, 'C' || c_custkey || '_' || c_nationkey || '.txt' AS name FROM customer)"


@query(f"WITH {FILES} SELECT name, '/a/' || name AS path_a, '/b/' || name AS path_b, 'N' || n AS nickname FROM f WHERE k % 5 <> 0 AND k % 7 <> 0 AND n < 20")
def pair_files(spark, sf_dir):
    return pairing.pair_files(*listings(spark, sf_dir)).drop("glob")


@query(f"""WITH {FILES} SELECT 'only_a' AS kind, name FROM f WHERE k % 5 <> 0 AND k % 7 = 0 UNION ALL SELECT 'only_b', name FROM f WHERE k % 5 = 0 AND k % 7 <> 0
  UNION ALL SELECT 'no_rule', name FROM f WHERE k % 5 <> 0 AND k % 7 <> 0 AND n >= 20
  UNION ALL SELECT 'idle_rule', 'N' || n_nationkey FROM nation WHERE n_nationkey < 20 AND n_nationkey NOT IN (SELECT n FROM f WHERE k % 5 <> 0 AND k % 7 <> 0)""")
def unpaired_files(spark, sf_dir):
    return pairing.unpaired_files(*listings(spark, sf_dir))


@query(f"WITH {FILES} SELECT name, CASE WHEN k % 2 = 0 THEN '/b/' || name ELSE '/a/' || name || '.GZ.000000009' END AS path, k % 2 = 0 AS plain, name AS logical_name FROM f")
def scan_versions(spark, sf_dir):
    a, b, _ = listings(spark, sf_dir)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("C"), F.col("c_custkey").cast("string"), F.lit("_"), F.col("c_nationkey").cast("string"), F.lit(".txt")).alias("n"))
    files = c.select(F.explode(F.filter(F.array(F.concat(F.lit("/a/"), "n", F.lit(".GZ")), F.concat(F.lit("/a/"), "n", F.lit(".GZ.000000001")), F.concat(F.lit("/a/"), "n", F.lit(".GZ.000000009")), F.when(F.col("k") % 2 == 0, F.concat(F.lit("/b/"), "n"))), lambda x: x.isNotNull())).alias("path"))
    return scan.scan_versions(files).withColumn("name", F.col("logical_name"))


def report_types(spark):
    rows = [("R1", "C1_*.txt", 3), ("R2", "c?_*.txt", 1), ("R3", "C12_#N.txt", 2), ("R4", "C2*", 5), ("R5", "C1*", 4)]
    return spark.createDataFrame(rows, "report_id string, pattern string, import_order int")


@query(f"""WITH {FILES}, t(report_id, re, tier, o) AS (VALUES ('R1', '^c1_.*\\.txt$', 2, 3), ('R2', '^c._.*\\.txt$', 2, 1), ('R3', '^c12_.*\\.txt$', 4, 2), ('R4', '^c2.*$', 2, 5), ('R5', '^c1.*$', 2, 4))
  SELECT name, arg_min(report_id, tier * 10 + o) AS report_id FROM f JOIN t ON regexp_matches(lower(name), re) GROUP BY name""")
def file_to_report(spark, sf_dir):
    return pairing.file_to_report(table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string"), F.lit("_"), F.col("c_nationkey").cast("string"), F.lit(".txt")).alias("name")), report_types(spark))


@query(f"WITH {FILES} SELECT DISTINCT 'N' || n AS nickname, CASE WHEN n % 2 = 0 THEN 'team ' || n ELSE 'N' || n END AS team FROM f")
def owner_group(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("report_id"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("team "), F.col("n_nationkey").cast("string"))).otherwise(" ").alias("ownership_group"), F.col("n_nationkey").alias("import_order"))
    return pairing.owner_group(table(spark, sf_dir, "customer").select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("nickname")), n)


# ---- lookup tables, made of nations, suppliers and customers ----


def text(c):
    return F.col(c).cast("string")


@query("SELECT 'N' || (s_nationkey % 5) AS nickname, CAST(s_suppkey % 9 AS INTEGER) AS col_seq, CAST(CASE s_suppkey % 7 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE 0 END AS INTEGER) AS field_type FROM supplier WHERE s_suppkey % 9 >= 1 QUALIFY row_number() OVER (PARTITION BY s_nationkey % 5, s_suppkey % 9 ORDER BY s_suppkey) = 1")
def load_monitor_fields(spark, sf_dir):
    k = F.col("s_suppkey")
    words = F.when(k % 7 == 1, "废弃字段").when(k % 7 == 2, " 2 ").when(k % 7 == 3, "无法对比").when(k % 7 == 4, "4").when(k % 7 == 5, "9").otherwise("x")
    # names differ by case only: they are the same
    rows = table(spark, sf_dir, "supplier").select(k.alias("row_no"), F.concat(F.lit("N"), (F.col("s_nationkey") % 5).cast("string")).alias("nickname"), (k % 9).cast("string").alias("col_seq"), F.lit("f").alias("field_name"), F.lit("m").alias("field_meaning"), words.alias("field_type"))
    return monitor.load_monitor_fields(rows).select("nickname", "col_seq", "field_type")


@query("SELECT 'g' || (s_nationkey % 5) AS group_name, arg_max('a' || s_suppkey || '/b/c', s_suppkey) AS members FROM supplier GROUP BY 1")
def load_compare_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_no"), F.concat(F.lit(" g"), (F.col("s_nationkey") % 5).cast("string")).alias("group_name"), F.concat(F.lit("a"), text("s_suppkey"), F.lit("、b，c;b|| ")).alias("members"))
    return rules.load_compare_groups(rows).select("group_name", joined("members", "/").alias("members"))


@query("SELECT 'R' || s_nationkey AS report_id, CAST(CASE WHEN s_suppkey % 4 = 0 THEN row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) ELSE s_suppkey END AS INTEGER) AS field_index, s_name AS field_name FROM supplier")
def load_report_fields(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.alias("row_no"), F.concat(F.lit("R"), text("s_nationkey")).alias("report_id"), F.when(k % 4 == 0, "n/a").otherwise(F.concat(F.lit(" "), text("s_suppkey"))).alias("field_index"), F.col("s_name").alias("field_name"), F.lit("X").alias("field_format"), F.lit("9").alias("field_length"))
    return lookups.load_report_fields(rows).select("report_id", "field_index", "field_name")


@query("SELECT 'T' || s_nationkey AS table_name, CAST(s_suppkey AS INTEGER) AS col_index, 'G' AS charset FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey >= 1")
def load_charset_map(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("T"), text("s_nationkey")).alias("table_name"), text("s_suppkey").alias("col_index"), F.when(k % 3 == 0, "e").otherwise(" g").alias("charset"), F.lit("f").alias("field_name"), F.lit("4").alias("field_length"))
    return lookups.load_charset_map(rows).select("table_name", "col_index", "charset")


@query("SELECT 'D' || s_nationkey AS dyn_name, CAST(10 + s_suppkey % 7 AS VARCHAR) AS item_code, arg_min(s_name, s_suppkey) AS item_name FROM supplier WHERE s_suppkey % 5 <> 0 GROUP BY 1, 2")
def load_dynamic_fields(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.alias("row_no"), F.concat(F.lit("D"), text("s_nationkey")).alias("dyn_name"), F.when(k % 5 == 0, "123").otherwise((10 + k % 7).cast("string")).alias("item_code"), F.col("s_name").alias("item_name"))
    return lookups.load_dynamic_fields(rows)


@query("SELECT CAST(c_custkey AS VARCHAR) AS pair_id, CASE WHEN c_custkey % 3 = 0 THEN 'own' ELSE 'f1/' || '/f3-' || c_nationkey END AS names FROM customer")
def name_columns(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("R"), text("n_nationkey")).alias("report_id"), F.explode(F.array(F.struct(F.lit(1).alias("field_index"), F.lit("f1").alias("field_name")), F.struct(F.lit(3).alias("field_index"), F.concat(F.lit("f3-"), text("n_nationkey")).alias("field_name")))).alias("x")).select("report_id", "x.*")
    pairs = table(spark, sf_dir, "customer").select(text("c_custkey").alias("pair_id"), F.concat(F.lit("R"), text("c_nationkey")).alias("report_id"), F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("own"))).alias("names"))
    return pairing.name_columns(pairs, n).select("pair_id", joined("names", "/").alias("names"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS pair_id, CASE c_custkey % 4 WHEN 0 THEN 'b' WHEN 1 THEN '3' WHEN 2 THEN 'zz' ELSE 'A ' END AS col_ref, CAST(CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 3 THEN 0 END AS INTEGER) AS col FROM customer")
def dynamic_columns_for(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(text("c_custkey").alias("pair_id"), F.when(k % 4 == 0, "b").when(k % 4 == 1, "3").when(k % 4 == 2, "zz").otherwise("A ").alias("col_ref"), F.lit("d").alias("dyn_name"))
    names = c.select("pair_id", F.array(F.lit("a"), F.lit("B"), F.lit("c")).alias("names"))
    return pairing.dynamic_columns_for(c, names).select("pair_id", "col_ref", "col")


@query("SELECT 'x_T' || c_nationkey || '_' || c_custkey || '.txt' AS name, 'T' || c_nationkey AS table_name FROM customer WHERE c_nationkey < 20")
def file_to_table(spark, sf_dir):
    files = table(spark, sf_dir, "customer").select(F.concat(F.lit("x_T"), text("c_nationkey"), F.lit("_"), text("c_custkey"), F.lit(".txt")).alias("name"))
    tables = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.concat(F.lit("T"), text("n_nationkey")).alias("table_name"))
    return pairing.file_to_table(files, tables, report_types(spark))


@query("SELECT 'r' || c_custkey || '.txt' AS name, '/a/r' || c_custkey AS path_a, '/b/r' || c_custkey AS path_b, CASE c_custkey % 3 WHEN 0 THEN '/t/' || c_custkey WHEN 1 THEN '/a/h' || c_custkey END AS template FROM customer WHERE c_custkey % 5 <> 0")
def pair_report_files(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    side = lambda x, on: c.where(on).select(F.concat(F.lit("r"), text("c_custkey"), F.lit(".txt")).alias("name"), F.concat(F.lit(f"/{x}/r"), text("c_custkey")).alias("path"))
    head = lambda on, p, rank: c.where(on).select(F.concat(F.lit("r"), text("c_custkey"), F.lit(".header")).alias("name"), F.concat(F.lit(p), text("c_custkey")).alias("path"), F.lit(rank).alias("rank"))
    templates = head(k % 3 != 2, "/a/h", 1).unionByName(head(k % 3 == 0, "/t/", 0))
    return pairing.pair_report_files(side("a", F.lit(True)).unionByName(templates.select("name", "path")), side("b", k % 5 != 0), templates)


@query("SELECT CAST(c_custkey AS VARCHAR) AS pair_id, CASE WHEN c_custkey % 4 = 0 THEN 'failed' ELSE 'done' END AS state, n.col AS col, CASE WHEN c_custkey % 4 = 0 THEN '—' ELSE '新线输出正常' END AS verdict FROM customer, (VALUES (1), (2)) n(col) WHERE c_nationkey = 3")
def monitor_coverage(spark, sf_dir):
    k = F.col("c_custkey")
    pairs = table(spark, sf_dir, "customer").select(text("c_custkey").alias("pair_id"), F.concat(F.lit("N"), text("c_nationkey")).alias("nickname"), F.when(k % 4 == 0, "failed").otherwise("done").alias("state"))
    fields = spark.createDataFrame([("n3", 2, 1), ("N3", 3, 4)], "nickname string, col_seq int, field_type int")
    verdict = pairs.where("state = 'done'").select("pair_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("col"), F.lit(True).alias("matched"), F.lit("新线输出正常").alias("verdict"))
    return monitor.monitor_coverage(pairs, fields, verdict).select("pair_id", "state", "col", "verdict")


@query("""SELECT 'R' || s_suppkey AS report_id, 'r' || s_nationkey || '_*.txt' AS pattern, CASE WHEN s_suppkey % 2 = 0 THEN 'CTS' ELSE 'RPT' END AS kind, 'g' || s_nationkey AS ownership_group FROM supplier WHERE s_suppkey % 10 <> 0""")
def load_report_types(spark, sf_dir):
    return report_dictionary(spark, sf_dir).select("report_id", "pattern", "kind", "ownership_group")


def report_dictionary(spark, sf_dir):
    k = F.col("s_suppkey")
    cells = table(spark, sf_dir, "supplier").select(F.concat(F.lit(" R"), text("s_suppkey")).alias("report_id"), F.when(k % 10 == 0, " ").otherwise(F.concat(F.lit("r"), text("s_nationkey"), F.lit("_*.txt "))).alias("report_file_name"), F.when(k % 2 == 0, "cts").otherwise("Rpt ").alias("parm_report_type"), F.concat(F.lit("g"), text("s_nationkey")).alias("ownership_group"), k.alias("row_no"))
    return lookups.load_report_types(cells)


@query("""WITH t AS (SELECT s_nationkey AS n, arg_min('R' || s_suppkey, s_suppkey) AS report_id FROM supplier WHERE s_suppkey % 10 <> 0 AND s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0 GROUP BY 1)
  SELECT 'R' || c_nationkey || '_' || c_custkey || '.TXT' AS name, report_id FROM customer JOIN t ON c_nationkey = n""")
def file_to_dynamic_report(spark, sf_dir):
    files = table(spark, sf_dir, "customer").select(F.concat(F.lit("R"), text("c_nationkey"), F.lit("_"), text("c_custkey"), F.lit(".TXT")).alias("name"))
    applicable = table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(F.concat(F.lit("r"), text("s_suppkey")).alias("text_name"))
    return pairing.file_to_dynamic_report(files, applicable, report_dictionary(spark, sf_dir))


@query("SELECT p_partkey AS k, regexp_matches(lower(p_name), '^part#0.*' || (p_partkey % 10) || '$') AS fits, regexp_matches(lower(p_name), '^.a.t.*$') AS other FROM part")
def glob_match(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    digit = (F.col("p_partkey") % 10).cast("string")
    return p.select(F.col("p_partkey").alias("k"), S.glob_match(F.col("p_name"), F.concat(F.lit("PART?0***"), digit)).alias("fits"), S.glob_match(F.col("p_name"), F.lit("?A?T#REST")).alias("other"))


@query("""SELECT 'N' || s_nationkey AS nickname, s_suppkey AS line_no, 'a|' || s_name AS names, '2:' || '^S(.*)' || '>' || '$1' || s_suppkey AS replace FROM supplier""")
def rules_with_tables(spark, sf_dir):
    """Rules whose column names and replacements stand in base64."""
    code = lambda c: F.base64(F.encode(c, "UTF-8"))
    names = F.to_json(F.array(F.lit("a"), F.col("s_name")))
    replace = F.to_json(F.create_map(F.lit("2"), F.array(F.array(F.lit("^S(.*)"), F.concat(F.lit("$1"), text("s_suppkey"))))))
    lines = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("line_no"), F.concat(F.lit("N"), text("s_nationkey"), F.lit(":s*:KEYSEQ=1:COLS="), code(names), F.lit(":REPLACE="), code(replace)).alias("value"))
    found = rules.rules_from_lines(lines)
    return found.select("nickname", "line_no", joined("names").alias("names"), F.array_join(F.transform(F.map_entries("replace"), lambda e: F.concat(e["key"], F.lit(":"), e["value"][0][0], F.lit(">"), e["value"][0][1])), ";").alias("replace"))


# ---- files that are written and read again ----


@query(f"WITH {RESULTS} SELECT status, key, array_to_string(diff, ',') AS diff FROM res WHERE status <> 'equal'")
def read_results(spark, sf_dir):
    """Result rows through Parquet; only the folders of the wanted statuses are read."""
    path = scratch(spark)
    scan.write_results(order_results(spark, sf_dir).withColumn("seq", F.col("seq.seq")), path)
    return scan.read_results(spark, path).where("status <> 'equal'").select("status", "key", joined("diff_cols", ",").alias("diff"))


@query(f"WITH {ROUTE} SELECT grp, k || ' ' || n AS value FROM l")
def split_files(spark, sf_dir):
    """Lines in one folder a group, read back from there."""
    path = scratch(spark)
    filters.split_files(routed(spark, sf_dir).withColumn("value", F.concat_ws(" ", F.get("cols", F.lit(0)), text("l_linenumber"))), path)
    return spark.read.text(path).select("grp", "value")


@query(f"""WITH {CELLS} SELECT key, CAST(col + 1 AS VARCHAR) AS no, [{', '.join(f"'{n}'" for n in NAMES)}][col + 1] AS name, a, b FROM cells UNION ALL SELECT 'say "x", y', '0', '', ' ', '' """)
def write_csv(spark, sf_dir):
    """Differing fields in the exports' dialect, with a hard row, read back by its rules."""
    path = scratch(spark)
    rows = export.export_diff_fields(order_results(spark, sf_dir), NAMES).select("key", text("no").alias("no"), "name", "a", "b")
    hard = spark.createDataFrame([('say "x", y', "0", "", " ", "")], rows.schema)
    export.write_csv(rows.unionByName(hard), path, ["键值", "no", "name", "a", "b"])
    back = spark.read.csv(path, header=True, quote='"', escape='"', lineSep="\r\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return back.toDF("key", "no", "name", "a", "b").fillna("")


@query(f"WITH {PAIR} SELECT CAST(c[2] AS BIGINT) % 16 AS file, row_number() OVER (PARTITION BY CAST(c[2] AS BIGINT) % 16 ORDER BY seq) - 1 AS seq, array_to_string(c, ' | ') AS value FROM b")
def scan_lines(spark, sf_dir):
    """B's records as the lines of 16 files, numbered in the order of each file."""
    path = scratch(spark)
    rows = order_pair(spark, sf_dir)[1].select((F.get("cols", F.lit(1)).cast("long") % 16).alias("file"), "seq", F.array_join("cols", " | ").alias("value"))
    rows.repartition("file").sortWithinPartitions("file", "seq").select("file", "value").write.partitionBy("file").text(path)
    lines = scan.scan_lines(spark, [f"{path}/file={i}" for i in range(16)])
    return lines.select(F.regexp_extract("file_path", "file=([0-9]+)/", 1).cast("long").alias("file"), "seq", "value")
