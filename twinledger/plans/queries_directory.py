"""Registered queries on whole directories with rules of their own, and on dynamic columns in exports and features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cells, compare, directory, export, features, rules, segments
from ..sources import charset, pages, parts, ranges, scan
from ..sources.settle import settle
from .pairs import RESULTS, lines_of, order_pair, scratch, table
from .queries import dynamic_pair, joined, order_results, query
from .queries_text import CHATS, charsets, chat_lines

# ---- dynamic columns: sub-field 1B, the date, and 1C, the priority ----


def dynamic_results(spark, sf_dir) -> DataFrame:
    about = spark.createDataFrame([("orders", 1, "107", "MSG")], "pair_id string, col int, label string, dyn_name string")
    items = spark.createDataFrame([("MSG", "1B", "date"), ("MSG", "ZZ", "none")], "dyn_name string, item_code string, item_name string")
    return compare.keyed_compare_dynamic(*dynamic_pair(spark, sf_dir), keys=[0], dynamic=[1], about=about, items=items)[0]


DYNAMIC = f"""{RESULTS},
dy AS (SELECT key, seq, ac, bc, status AS plain, ac IS NOT NULL AND bc IS NOT NULL AS two, ac[5] AS a1, ac[6] AS a2, CASE WHEN bc[3] <> '' THEN bc[5] END AS b1, bc[6] AS b2,
  '~~1B' || ac[5] || '~~1C' || ac[6] AS ta, '~~1C' || bc[6] || CASE WHEN bc[3] <> '' THEN '~~1B' || bc[5] ELSE '' END AS tb FROM res),
dr AS (SELECT *, two AND b1 IS NULL AS d1, two AND a2 <> b2 AS d2 FROM dy),
ds AS (SELECT *, CASE WHEN NOT two THEN plain WHEN d1 OR d2 THEN 'diff' ELSE 'equal' END AS st, CASE WHEN d1 THEN '107-1B（date）；' ELSE '' END || CASE WHEN d2 THEN '107-1C；' ELSE '' END AS lab FROM dr),
dc AS (SELECT key, seq, 1000001 AS col, '107-1B' AS label, '107-1B（date）' AS name, a1 AS a, '' AS b FROM ds WHERE d1 UNION ALL SELECT key, seq, 1000002, '107-1C', '107-1C', a2, b2 FROM ds WHERE d2)
"""


@query(f"""WITH {DYNAMIC} SELECT key, st AS status, '' AS diff, 0 AS line, key || '|' || coalesce(ta, tb) AS row, coalesce(a1, b1, '') || '|' || coalesce(a2, b2) AS virtual FROM (SELECT * REPLACE (CASE st WHEN 'equal' THEN '完全匹配' WHEN 'unmatched_a' THEN '仅A存在' ELSE '仅B存在' END AS st) FROM ds WHERE st <> 'diff')
  UNION ALL SELECT key, '有差异·A', lab, 0, key || '|' || ta, a1 || '|' || a2 FROM ds WHERE st = 'diff' UNION ALL SELECT key, '有差异·B', lab, 1, key || '|' || tb, coalesce(b1, '') || '|' || b2 FROM ds WHERE st = 'diff'""")
def export_full_dynamic(spark, sf_dir):
    out = export.export_full_csv(dynamic_results(spark, sf_dir))
    return out.select("key", "status", "diff", "line", joined("values").alias("row"), joined("virtual").alias("virtual"))


@query(f"""WITH {DYNAMIC} SELECT key, '有差异' AS status, concat_ws(chr(10), CASE WHEN d1 THEN '[栏位不一致 @107-1B] A:''' || a1 || ''' B:''''' END, CASE WHEN d2 THEN '[栏位不一致 @107-1C] A:''' || a2 || ''' B:''' || b2 || '''' END) AS detail FROM ds WHERE st = 'diff'
  UNION ALL SELECT key, CASE st WHEN 'unmatched_a' THEN '仅A存在' ELSE '仅B存在' END, CASE st WHEN 'unmatched_a' THEN '[仅A存在] A:''' || key || ''' B:''''' ELSE '[仅B存在] A:'''' B:''' || key || '''' END FROM ds WHERE NOT two""")
def export_records_dynamic(spark, sf_dir):
    m = spark.createDataFrame([("orders", 1, 1)], "pair_id string, col int, field_type int")
    return export.export_diff_records(dynamic_results(spark, sf_dir), m).select("key", "status", "detail")


@query(f"WITH {DYNAMIC} SELECT key, label, name, a, b FROM dc")
def export_fields_dynamic(spark, sf_dir):
    return export.export_diff_fields(dynamic_results(spark, sf_dir), ["K", "MSG"]).select("key", "label", "name", "a", "b")


@query(f"""WITH {DYNAMIC} SELECT key, '栏位不一致' AS kind, label AS "column", 'A:''' || a || ''' B:''' || b || '''' AS content FROM dc
  UNION ALL SELECT key, CASE st WHEN 'unmatched_a' THEN '仅A存在' ELSE '仅B存在' END, '0', CASE st WHEN 'unmatched_a' THEN 'A:''' || key || ' | ' || ta || '''' ELSE 'B:''' || key || ' | ' || tb || '''' END FROM ds WHERE NOT two""")
def export_cases_dynamic(spark, sf_dir):
    pairs = spark.createDataFrame([("orders", "b1", 1, "ORD", "o*", "o1", "o2", "t")], "pair_id string, batch string, round int, nickname string, glob string, file_a string, file_b string, team string")
    return export.export_cases(dynamic_results(spark, sf_dir), pairs).select("key", "kind", "column", "content")


@query(f"WITH {DYNAMIC} SELECT DISTINCT CAST(col AS INTEGER) AS idx, label, name FROM dc UNION SELECT 1000001, '107-1B', '107-1B（date）' UNION SELECT 1000002, '107-1C', '107-1C'")
def virtual_columns(spark, sf_dir):
    return cells.registry_of(dynamic_results(spark, sf_dir)).select("idx", "label", "name")


# ---- features with all their columns ----


def _features(source: str, cells_of: str) -> str:
    """SQL of ``diff_features`` over a table of cells with col, seq, key, label, a and b."""
    start = "substr({0}, 1, CASE WHEN list_contains(list_transform(range(1, least(length({0}), length({1})) + 1), lambda i: {0}[i] <> {1}[i]), true) THEN list_position(list_transform(range(1, least(length({0}), length({1})) + 1), lambda i: {0}[i] <> {1}[i]), true) - 1 ELSE least(length({0}), length({1})) END)"
    fold = lambda x: f"list_reduce(list({x} ORDER BY n), lambda p, q: CASE WHEN p = '' THEN q ELSE {start.format('p', 'q')} END)"
    number = r"regexp_full_match({0}, '\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*')"
    date = r"regexp_full_match({0}, '\s*([0-9]{{8}}([0-9]{{6}})?|[0-9]{{4}}[-/年][0-9]{{1,2}}[-/月][0-9]{{1,2}}日?.*)\s*')"
    both = lambda t: f"{t.format('a')} AND {t.format('b')}"
    return f"""WITH {source}, cells AS ({cells_of}), smp AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY seq, key) AS n FROM cells QUALIFY n <= 30),
  p AS (SELECT col, label, a, b, count(*) AS n FROM cells GROUP BY ALL), top AS (SELECT col, string_agg(a || '>' || b || '=' || n, ';' ORDER BY n DESC, a, b) AS top_patterns FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY col ORDER BY n DESC, a, b) <= 8) GROUP BY 1),
  tot AS (SELECT col, min(label) AS label, CAST(sum(n) AS BIGINT) AS count, CAST(coalesce(sum(n) FILTER (WHERE trim(a) = ''), 0) AS BIGINT) AS empty_a, CAST(coalesce(sum(n) FILTER (WHERE trim(b) = ''), 0) AS BIGINT) AS empty_b, count(*) AS kinds FROM p GROUP BY 1),
  pre AS (SELECT col, a, b, n, {start.format('a', 'b')} AS f, reverse(a) AS ra, reverse(b) AS rb FROM smp),
  suf AS (SELECT *, {start.format('ra', 'rb')} AS g FROM pre),
  s AS (SELECT col, count(*) FILTER (WHERE {both(number)}) AS numeric_pairs, count(*) FILTER (WHERE {both(date)}) AS date_pairs, count(*) FILTER (WHERE length(a) < length(b)) AS grows, count(*) FILTER (WHERE length(a) > length(b)) AS shrinks,
    {fold('f')} AS common_prefix, reverse({fold('g')}) AS common_suffix FROM suf GROUP BY 1)
  SELECT CAST(col AS INTEGER) AS col, label, count, empty_a, empty_b, kinds, top_patterns, numeric_pairs, date_pairs, grows, shrinks, common_prefix, common_suffix FROM tot JOIN top USING (col) JOIN s USING (col)"""


@query(_features(DYNAMIC, "SELECT * FROM dc"))
def diff_features_dynamic(spark, sf_dir):
    """All columns of the features, of virtual columns whose values are dates and priorities."""
    return features.diff_features(dynamic_results(spark, sf_dir)).drop("pair_id")


SHAPES = "unnest([{'c': 1, 'a': d, 'b': CASE WHEN k % 3 = 0 THEN '2024/1/' || (k % 28 + 1) ELSE '2024年1月' || (k % 28 + 1) || '日' END}, {'c': 2, 'a': k || 'e2', 'b': k || '0' || '.5'}, {'c': 3, 'a': '90000000000000000000' || (10000 + k % 90000), 'b': '90000000000000000000' || (10007 + k % 90000)}, {'c': 4, 'a': 'pre' || k || 'fix', 'b': 'prefix'}, {'c': 5, 'a': ' ', 'b': '2024-01-02 10:00'}]) AS x"
SHAPED = f"{RESULTS}, sh AS (SELECT CAST(key AS BIGINT) AS k, key, seq, bc[5] AS d FROM res WHERE seq IS NOT NULL AND CAST(key AS BIGINT) < 10000000), sc AS (SELECT key, seq, x.c AS col, CAST(x.c + 1 AS VARCHAR) AS label, x.a AS a, x.b AS b FROM (SELECT k, key, seq, d, {SHAPES} FROM sh))"


def shaped(spark, sf_dir) -> DataFrame:
    """Records of B against made-over ones: dates of other shapes, exponents, numbers of 25 digits, common beginnings and ends."""
    b = order_pair(spark, sf_dir)[1]
    k, d = F.get("cols", F.lit(0)).cast("long"), F.get("cols", F.lit(4))
    b = b.where(k < 10_000_000)
    t = lambda c: c.cast("string")
    long = lambda n: F.concat(F.lit("90000000000000000000"), t(F.lit(n) + k % 90000))
    day = t(k % 28 + 1)
    other = F.when(k % 3 == 0, F.concat(F.lit("2024/1/"), day)).otherwise(F.concat(F.lit("2024年1月"), day, F.lit("日")))
    left = F.array(t(k), d, F.concat(t(k), F.lit("e2")), long(10000), F.concat(F.lit("pre"), t(k), F.lit("fix")), F.lit(" "))
    right = F.array(t(k), other, F.concat(t(k), F.lit("0"), F.lit(".5")), long(10007), F.lit("prefix"), F.lit("2024-01-02 10:00"))
    seq = F.struct(F.lit(0).alias("part"), F.col("seq").alias("seq"))
    return b.select("pair_id", t(k).alias("key"), F.lit("diff").alias("status"), F.lit("data").alias("section"), left.alias("a_cols"), right.alias("b_cols"), F.sequence(F.lit(1), F.lit(5)).alias("diff_cols"), seq.alias("seq"))


@query(_features(SHAPED, "SELECT * FROM sc"))
def diff_features_shapes(spark, sf_dir):
    return features.diff_features(shaped(spark, sf_dir)).drop("pair_id")


@query("SELECT 3 AS col, '+7' AS delta, least(count(*), 30) AS n FROM orders")
def delta_of_long_numbers(spark, sf_dir):
    """Numbers of 25 digits; the other columns have no delta that over half of the samples share."""
    return features.numeric_delta_mode(shaped(spark, sf_dir)).drop("pair_id")


@query(f"WITH {RESULTS}, u AS (SELECT key, status, array_to_string(coalesce(ac, bc), '|') AS cols, row_number() OVER (ORDER BY seq IS NULL, seq, al) AS n FROM (SELECT res.*, l.al FROM res LEFT JOIN (SELECT c[1] AS key, max(seq) AS al FROM a GROUP BY 1) l USING (key)) WHERE status LIKE 'unmatched%') SELECT CAST(n AS INTEGER) AS n, status, key, cols FROM u WHERE n <= 10")
def one_sided_samples(spark, sf_dir):
    return features.one_sided_samples(compare.keyed_compare(*order_pair(spark, sf_dir), keys=[0])).select("n", "status", "key", joined("cols").alias("cols"))


@query(f"WITH {RESULTS}, f AS (SELECT i AS col, count(*) AS count FROM (SELECT unnest(diff) AS i FROM res WHERE status = 'diff') GROUP BY 1) SELECT CAST(col AS INTEGER) AS col, count, CAST(row_number() OVER (ORDER BY count DESC, col) AS INTEGER) AS rank FROM f QUALIFY rank <= 2")
def top_columns(spark, sf_dir):
    found = features.diff_features(compare.keyed_compare(*order_pair(spark, sf_dir), keys=[0]))
    return features.top_columns(found, 2).select("col", "count", "rank")


# ---- a directory of five pairs, each with a rule of its own ----

RULE_LINES = [
    "# file names, keys and what doesn't count", "ORD:ord*.txt:KEYSEQ=1:IGNORESEQ=3:OMITSEQ=6", "CUS:c*.dat:KEYSEQ=1:DELIM=,:TRAILER=##", "NAT:nation.*:DELIM=;", "SUP:supplier.txt:KEYSEQ=2/1:DELIM=^:OMITSEQ=4",
    "PRT:p?rt.txt:KEYSEQ=1:ADDMOD=2", "LATE:o*:KEYSEQ=2", "MSG:message.txt:KEYSEQ=1",
]


def directory_job(spark, sf_dir) -> directory.Compared:
    """Files of both sides made of five tables and the dynamic pair; one job compares them."""
    t = lambda name: table(spark, sf_dir, name)
    s = lambda c: F.col(c).cast("string")

    def lines(df: DataFrame, name: str, seq: str, delim: str, *cols) -> DataFrame:
        return df.select(F.lit(name).alias("pair_id"), F.col(seq).alias("seq"), F.concat_ws(delim, *cols).alias("value"))

    a, b = order_pair(spark, sf_dir)
    orders = [lines_of(x.withColumn("pair_id", F.lit("orders.txt")), y) for x, y in ((a, "AAA"), (b, "BBB"))]
    cus, k = t("customer"), F.col("c_custkey")
    end = lambda n: spark.createDataFrame([("customer.dat", 2**50, f"##RecNum={n}"), ("customer.dat", 2**50 + 1, "SysID=X")], "pair_id string, seq long, value string")
    cus_a = lines(cus, "customer.dat", "c_custkey", ",", s("c_custkey"), "c_name", s("c_nationkey")).unionByName(end(1))
    name = F.when(k % 10 == 3, F.concat("c_name", F.lit("x"))).otherwise(F.col("c_name"))
    cus_b = lines(cus.where(k % 10 != 7), "customer.dat", "c_custkey", ",", s("c_custkey"), name, s("c_nationkey")).unionByName(end(2))
    nat, k = t("nation"), F.col("n_nationkey")
    nat_a = lines(nat, "nation.csv", "n_nationkey", ";", s("n_nationkey"), "n_name")
    nat_b = lines(nat, "nation.csv", "n_nationkey", ";", s("n_nationkey"), F.when(k % 5 == 0, F.lower("n_name")).otherwise(F.col("n_name")))
    sup, k = t("supplier"), F.col("s_suppkey")
    sup_a = lines(sup, "supplier.txt", "s_suppkey", "^", s("s_suppkey"), s("s_nationkey"), "s_name", F.lit("old"))
    sup_b = lines(sup, "supplier.txt", "s_suppkey", "^", s("s_suppkey"), s("s_nationkey"), F.when(k % 9 == 2, "?").otherwise(F.col("s_name")), F.lit("new"))
    part, k = t("part"), F.col("p_partkey")
    part_a = lines(part, "part.txt", "p_partkey", " | ", s("p_partkey"), "p_brand", "p_type")
    part_b = lines(part, "part.txt", "p_partkey", " | ", s("p_partkey"), "p_brand", F.when(k % 6 == 5, "NONE").otherwise(F.col("p_type")))
    dyn = [x.select(F.lit("message.txt").alias("pair_id"), "seq", F.array_join("cols", " | ").alias("value")) for x in dynamic_pair(spark, sf_dir)]
    lone = spark.createDataFrame([("alone.txt", 0, "x")], "pair_id string, seq long, value string")
    every = lambda parts: settle(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4]).unionByName(parts[5]).unionByName(lone))
    side_a, side_b = every([orders[0], cus_a, nat_a, sup_a, part_a, dyn[0]]), every([orders[1], cus_b, nat_b, sup_b, part_b, dyn[1]])
    text = spark.createDataFrame([("f", 0, i, x) for i, x in enumerate(RULE_LINES)], "file string, file_order int, line_no int, value string")
    files = lambda d: d.select(F.col("pair_id").alias("name")).distinct().withColumn("path", F.col("name"))
    conds = spark.createDataFrame([("PRT", ["Brand#1, Brand#12"])], "nickname string, conds array<string>")
    pairs = directory.plan_pairs(files(side_a), files(side_b), rules.effective_rules(rules.rules_from_lines(text))[0], conds)
    about = spark.createDataFrame([("message.txt", 1, "107", "MSG")], "pair_id string, col int, label string, dyn_name string")
    items = spark.createDataFrame([("MSG", "1B", "date")], "dyn_name string, item_code string, item_name string")
    return directory.compare_directories(side_a, side_b, pairs, about, items)


DIRECTORY = f"""{DYNAMIC},
od AS (SELECT 'orders.txt' AS pair_id, key, CASE WHEN status LIKE 'unmatched%' THEN status WHEN len(list_filter(diff, lambda i: i NOT IN (2, 5))) = 0 THEN 'equal' ELSE 'diff' END AS status,
  array_to_string(list_transform(list_filter(diff, lambda i: i NOT IN (2, 5)), lambda i: CAST(i + 1 AS VARCHAR)), ',') AS diff FROM res),
cd AS (SELECT 'customer.dat' AS pair_id, CAST(c_custkey AS VARCHAR) AS key, CASE c_custkey % 10 WHEN 7 THEN 'unmatched_a' WHEN 3 THEN 'diff' ELSE 'equal' END AS status, CASE c_custkey % 10 WHEN 3 THEN '2' ELSE '' END AS diff FROM customer),
nd AS (SELECT 'nation.csv' AS pair_id, n_nationkey || ':' || n_name AS key, CASE WHEN n_nationkey % 5 = 0 THEN 'unmatched_a' ELSE 'equal' END AS status, '' AS diff FROM nation
  UNION ALL SELECT 'nation.csv', n_nationkey || ':' || lower(n_name), 'unmatched_b', '' FROM nation WHERE n_nationkey % 5 = 0),
sd AS (SELECT 'supplier.txt' AS pair_id, s_suppkey || ':' || s_nationkey AS key, CASE s_suppkey % 9 WHEN 2 THEN 'diff' ELSE 'equal' END AS status, CASE s_suppkey % 9 WHEN 2 THEN '3' ELSE '' END AS diff FROM supplier),
pd AS (SELECT 'part.txt' AS pair_id, CAST(p_partkey AS VARCHAR) AS key, CASE p_partkey % 6 WHEN 5 THEN 'diff' ELSE 'equal' END AS status, CASE p_partkey % 6 WHEN 5 THEN '3' ELSE '' END AS diff FROM part WHERE p_brand IN ('Brand#1', 'Brand#12')),
md AS (SELECT 'message.txt' AS pair_id, key, st AS status, concat_ws(',', CASE WHEN d1 THEN '107-1B' END, CASE WHEN d2 THEN '107-1C' END) AS diff FROM ds),
every AS (SELECT * FROM od UNION ALL SELECT * FROM cd UNION ALL SELECT * FROM nd UNION ALL SELECT * FROM sd UNION ALL SELECT * FROM pd UNION ALL SELECT * FROM md)"""


@query(f"WITH {DIRECTORY} SELECT * FROM every")
def directory_compare(spark, sf_dir):
    """Records of all pairs by one plan; keys, delimiters, trailers, conditions and dynamic columns differ by pair."""
    rows = directory_job(spark, sf_dir).results.where("section = 'data'")
    shown = cells.Cells(rows)
    return rows.select("pair_id", F.replace("key", F.lit("\x1f"), F.lit(":")).alias("key"), "status", F.array_join(F.transform("diff_cols", shown.number), ",").alias("diff"))


@query(f"""WITH {DIRECTORY}, sizes(pair_id, data_rows_a, data_rows_b, trailer_rows_a, trailer_rows_b, before_a, before_b) AS (
  SELECT 'orders.txt', (SELECT count(*) FROM a), (SELECT count(*) FROM b), 4, 4, (SELECT count(*) FROM a), (SELECT count(*) FROM b) UNION ALL
  SELECT 'customer.dat', (SELECT count(*) FROM customer), (SELECT count(*) FROM customer WHERE c_custkey % 10 <> 7), 2, 2, (SELECT count(*) FROM customer), (SELECT count(*) FROM customer WHERE c_custkey % 10 <> 7) UNION ALL
  SELECT 'nation.csv', 25, 25, 0, 0, 25, 25 UNION ALL SELECT 'supplier.txt', (SELECT count(*) FROM supplier), (SELECT count(*) FROM supplier), 0, 0, (SELECT count(*) FROM supplier), (SELECT count(*) FROM supplier) UNION ALL
  SELECT 'part.txt', (SELECT count(*) FROM pd), (SELECT count(*) FROM pd), 0, 0, (SELECT count(*) FROM part), (SELECT count(*) FROM part) UNION ALL
  SELECT 'message.txt', (SELECT count(*) FROM a), (SELECT count(*) FROM b), 0, 0, (SELECT count(*) FROM a), (SELECT count(*) FROM b))
  SELECT pair_id, count(*) FILTER (WHERE status = 'equal') AS equal, count(*) FILTER (WHERE status = 'diff') AS diff, count(*) FILTER (WHERE status = 'unmatched_a') AS only_a, count(*) FILTER (WHERE status = 'unmatched_b') AS only_b,
    CAST(data_rows_a AS BIGINT) AS data_rows_a, CAST(data_rows_b AS BIGINT) AS data_rows_b, CAST(trailer_rows_a AS BIGINT) AS trailer_rows_a, CAST(trailer_rows_b AS BIGINT) AS trailer_rows_b,
    CAST(before_a AS BIGINT) AS before_a, CAST(before_b AS BIGINT) AS before_b, CASE WHEN pair_id = 'part.txt' THEN CASE WHEN data_rows_a + data_rows_b = 0 THEN '增量-空文本' ELSE '增量' END END AS incremental
  FROM sizes JOIN every USING (pair_id) GROUP BY ALL""")
def directory_summary(spark, sf_dir):
    names = ["equal", "diff", "only_a", "only_b", "data_rows_a", "data_rows_b", "trailer_rows_a", "trailer_rows_b", "before_a", "before_b", "incremental"]
    return directory_job(spark, sf_dir).summary.select("pair_id", *names)


# ---- files: export parts, host charsets, mixed charsets ----


@query(f"""WITH {DYNAMIC}, d AS (SELECT key, '有差异' AS status, concat_ws(chr(10), CASE WHEN d1 THEN '[栏位不一致 @107-1B] A:''' || a1 || ''' B:''''' END, CASE WHEN d2 THEN '[栏位不一致 @107-1C] A:''' || a2 || ''' B:''' || b2 || '''' END) AS detail, seq FROM ds WHERE st = 'diff')
  SELECT 'orders.' || printf('%05d', CAST((row_number() OVER (ORDER BY seq) - 1) // 50 AS INTEGER)) || '.csv' AS file, key, status, detail FROM d""")
def export_files(spark, sf_dir):
    """Differing records with cells of several lines, written in parts of 50 records and read back; a pair without any has a header alone."""
    path = scratch(spark)
    rows = export.export_diff_records(dynamic_results(spark, sf_dir)).where("status = '有差异'")
    rows = export.export_parts(rows, "seq", size=50)
    pairs = spark.createDataFrame([("orders",), ("empty/pair",)], "pair_id string")
    parts.write_parts(rows.withColumn("line", export.csv_line(F.col("key"), F.col("status"), F.col("detail"))), path, ["键值", "状态", "差异明细"], [F.col("seq")], pairs)
    back = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', schema="key string, status string, detail string", enforceSchema=True)
    return back.select(F.col("_metadata.file_name").alias("file"), "key", "status", "detail")


@query(f"""WITH {RESULTS}, cut AS (SELECT CASE WHEN status = 'diff' THEN 2 ELSE 1 END AS lines, (row_number() OVER (ORDER BY seq IS NULL, seq, al) - 1) // 1000 AS part
    FROM res LEFT JOIN (SELECT c[1] AS key, max(seq) AS al FROM a GROUP BY 1) l USING (key)) SELECT CAST(part AS INTEGER) AS part, CAST(sum(lines) AS BIGINT) AS lines FROM cut GROUP BY 1""")
def export_full_parts(spark, sf_dir):
    """Lines in each part of 1,000 records: records that differ have two lines, which stay together."""
    full = export.export_full_csv(order_results(spark, sf_dir))
    cut = export.export_parts(full, "seq", "line", size=1000, begins=F.col("line") == 0)
    return cut.groupBy("part").agg(F.count("*").alias("lines"))


HOSTS = {"cp037": ("%", "CUSTOMER"), "cp1047": ("\x15", "[Kunde]"), "gb18030": ("\n", "客户")}


def _host_files(spark, sf_dir) -> str:
    """Files of customers in three charsets, their bytes written as they are."""
    path = scratch(spark)
    c = table(spark, sf_dir, "customer")
    for name, (end, word) in HOSTS.items():
        text = F.concat_ws(" | ", F.col("c_custkey").cast("string"), F.lit(word), "c_mktsegment")
        raw = c.select(F.encode(text, scan.CHARSETS[name]).cast("string").alias("value"))
        raw.repartition(2).write.option("lineSep", end).text(f"{path}/{name}")
    return path


@query("SELECT charset, c_custkey || ' | ' || word || ' | ' || c_mktsegment AS value FROM customer, (VALUES ('cp037', 'CUSTOMER'), ('cp1047', '[Kunde]'), ('gb18030', '客户')) t(charset, word)")
def scan_host_charsets(spark, sf_dir):
    with charsets(spark):
        path = _host_files(spark, sf_dir)
        out = None
        for name in HOSTS:
            some = scan.scan_lines(spark, f"{path}/{name}", name).select(F.lit(name).alias("charset"), "value")
            out = some if out is None else out.unionByName(some)
        return out


@query("SELECT folder, encoding FROM (VALUES ('cp037', 'cp037'), ('cp1047', 'cp037'), ('gb18030', 'gb18030'), ('packed', 'utf-8')) t(folder, encoding) WHERE (SELECT count(*) FROM customer) > 0")
def detect_file_encodings(spark, sf_dir):
    """From the heads of real files, one of them an archive; nothing else of them is read.  The two host charsets tie on these texts,
    and the first candidate wins full ties."""
    with charsets(spark):
        path = _host_files(spark, sf_dir)
        table(spark, sf_dir, "customer").select(F.concat_ws(" | ", F.col("c_custkey").cast("string"), F.lit("é"), "c_name").alias("value")).write.option("compression", "gzip").text(f"{path}/packed")
        found = charset.detect_encoding(spark, [f"{path}/{x}" for x in (*HOSTS, "packed")])
        return found.select(F.regexp_extract("file_path", "/([a-z0-9]+)/[^/]*$", 1).alias("folder"), "encoding").distinct()


@query("SELECT c_custkey % 3 AS file, c_custkey || ' | Ċ' || c_name || ' | 客户 | ' || CASE WHEN c_custkey % 2 = 0 THEN 'ĊĊ文' ELSE '' END AS value FROM customer")
def read_mixed_files(spark, sf_dir):
    """Real files with UTF-16 columns of declared length, whose characters hold line feed bytes, by ranges of 16 KiB."""
    with charsets(spark):
        path = scratch(spark)
        c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
        plain = lambda x: F.encode(x, "GB18030")
        wide = F.encode(F.rpad(F.concat(F.lit("Ċ"), "c_name"), 30, " "), "UTF-16BE")
        extra = F.when(k % 2 == 0, F.encode(F.lit("ĊĊ文"), "UTF-16BE")).otherwise(F.encode(F.lit("   "), "UTF-16BE"))
        sep = plain(F.lit(" | "))
        raw = F.concat(plain(k.cast("string")), sep, wide, sep, plain(F.lit("客户")), sep, extra)
        c.select((k % 3).alias("file"), raw.cast("string").alias("value")).repartition("file").write.partitionBy("file").text(path)
        back = ranges.read_mixed(spark, [f"{path}/file={i}" for i in range(3)], "gb18030", " | ", {1: 30, 3: 3}, size=1 << 14)
        return back.select(F.regexp_extract("file_path", "file=([0-9]+)/", 1).cast("long").alias("file"), "value")


# ---- segments that no row holds ----


def _chats_in_lines(spark, sf_dir):
    """Conversations by number; every fifth text is without keys."""
    sides = []
    for changed in (False, True):
        heads, lines, _ = segments.segment_lines(chat_lines(spark, sf_dir, changed), "^##", None, r"^##([0-9]+)")
        sides.append((heads.withColumn("key", F.when(F.col("key").cast("long") % 5 != 0, F.col("key"))), lines))
    return segments.compare_segment_lines(*sides)


LINES_APART = f"""{CHATS}, s AS (SELECT conv_id, sa.l AS a, sb.l AS b FROM sa LEFT JOIN sb USING (conv_id)),
k AS (SELECT *, conv_id % 5 <> 0 AS keyed, CASE WHEN conv_id % 5 <> 0 THEN CAST(conv_id AS VARCHAR) ELSE '##' || conv_id || ' @' || (conv_id * 100000 + 1) END AS key FROM s),
e AS (SELECT key, CASE WHEN b IS NULL THEN 'unmatched_a' WHEN a = b THEN 'equal' ELSE 'diff' END AS status, a, b FROM k WHERE keyed OR a = b
  UNION ALL SELECT key, 'unmatched_a', a, NULL FROM k WHERE NOT keyed AND (b IS NULL OR a <> b) UNION ALL SELECT key, 'unmatched_b', NULL, b FROM k WHERE NOT keyed AND a <> b)"""


@query(f"WITH {LINES_APART} SELECT key, status, CAST(len(a) AS BIGINT) AS n_a, CAST(len(b) AS BIGINT) AS n_b, CASE status WHEN 'diff' THEN CAST(len(list_filter(range(1, len(a) + 1), lambda i: a[i] <> b[i])) AS BIGINT) ELSE 0 END AS n_diff FROM e")
def segment_compare_by_print(spark, sf_dir):
    return _chats_in_lines(spark, sf_dir)[0].select("key", "status", "n_a", "n_b", "n_diff")


@query(f"WITH {LINES_APART}, d AS (SELECT *, unnest(range(1, greatest(coalesce(len(a), 0), coalesce(len(b), 0)) + 1)) AS line_no FROM e WHERE status <> 'equal') SELECT key, status, line_no, a[line_no] AS a, b[line_no] AS b FROM d WHERE a[line_no] IS DISTINCT FROM b[line_no]")
def segment_lines_apart(spark, sf_dir):
    return _chats_in_lines(spark, sf_dir)[1].select("key", "status", "line_no", "a", "b")


# ---- pages of written results, and patterns without number ----


@query(f"WITH {RESULTS} SELECT key, status, (SELECT count(*) FROM res WHERE status = 'diff') AS total FROM res WHERE status = 'diff' ORDER BY seq LIMIT 50 OFFSET 120")
def read_page(spark, sf_dir):
    """A page is the feature here: it is read from the files that it spans."""
    path = scratch(spark)
    pages.write_paged(order_results(spark, sf_dir).withColumn("seq", F.struct("seq.part", "seq.seq")), path)
    return pages.read_page(spark, path, "orders", 120, 50, "diff").select("key", "status", "total")


@query("SELECT o.o_orderkey AS k, c.c_custkey AS pattern FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey AND (c.c_custkey % 3 <> 1 OR o.o_orderkey >= 1000)")
def fitting_patterns(spark, sf_dir):
    """File names of all orders against a pattern for each customer: with stars, with single characters, with a place holder."""
    from ..operators import patterns

    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    id_ = F.lpad(F.col("c_custkey").cast("string"), 7, "0")
    names = o.select(F.col("o_orderkey").alias("k"), F.concat(F.lit("ORD_"), F.lpad(F.col("o_custkey").cast("string"), 7, "0"), F.lit("_"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.when(F.col("o_orderkey") < 1000, ".dat").otherwise(".txt")).alias("name"))
    kind = F.col("c_custkey") % 3
    text = F.when(kind == 0, F.concat(F.lit("*_"), id_, F.lit("_*"))).when(kind == 1, F.concat(F.lit("ord_"), id_, F.lit("_??????????.TXT"))).otherwise(F.concat(F.lit("ORD#X"), id_, F.lit("_#SEQ.*")))
    text = F.when(kind == 2, F.concat(F.lit("ord_"), id_, F.lit("_#SEQ"))).otherwise(text)
    return patterns.fitting(names, c.select(F.col("c_custkey").alias("pattern"), text.alias("glob")), "name", "glob").select("k", "pattern")
