"""Registered queries of the reconciliation operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings as S
from ..operators import compare, summary
from ..sources import scan
from ..sources.settle import settle
from .pairs import PAIR, RESULTS, lines_of, order_pair, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def joined(cols: str, sep: str = "|"):
    return F.array_join(F.transform(cols, lambda x: x.cast("string")), sep)


def order_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.keyed_compare(*order_pair(spark, sf_dir), keys=[0])


def scanned(spark: SparkSession, sf_dir: str):
    """Both files: their lines are made and written once."""
    a, b = order_pair(spark, sf_dir)
    return scan.scan_delimited(settle(lines_of(a, "AAA"))), scan.scan_delimited(settle(lines_of(b, "BBB")))


@query(f"""WITH {RESULTS} SELECT 'orders' AS pair_id,
  (SELECT count(*) FROM res WHERE status = 'equal') AS equal, (SELECT count(*) FROM res WHERE status = 'diff') AS diff,
  (SELECT count(*) FROM res WHERE status = 'unmatched_a') AS only_a, (SELECT count(*) FROM res WHERE status = 'unmatched_b') AS only_b,
  0::BIGINT AS malformed_a, 0::BIGINT AS malformed_b, (SELECT count(*) FROM a) AS data_rows_a, (SELECT count(*) FROM b) AS data_rows_b,
  4::BIGINT AS trailer_rows_a, 4::BIGINT AS trailer_rows_b, (SELECT count(*) + 4 FROM a) AS total_a, (SELECT count(*) + 4 FROM b) AS total_b""")
def compare_summary(spark, sf_dir):
    """Lines to summary: the whole way of one pair."""
    (da, _, sa), (db, _, sb) = scanned(spark, sf_dir)
    results = compare.keyed_compare(da, db, [0])
    return summary.compare_summary(results, sa, sb, summary.malformed(da, [0]), summary.malformed(db, [0]))


@query(f"WITH {RESULTS} SELECT key, status, array_to_string(ac, '|') AS a, array_to_string(bc, '|') AS b, array_to_string(diff, ',') AS diff FROM res")
def keyed_compare(spark, sf_dir):
    r = order_results(spark, sf_dir)
    return r.select("key", "status", joined("a_cols").alias("a"), joined("b_cols").alias("b"), joined("diff_cols", ",").alias("diff"))


@query(f"""WITH {RESULTS} SELECT key, CASE WHEN status IN ('equal', 'diff') THEN CASE WHEN len(list_filter(diff, lambda i: i NOT IN (2, 5))) = 0 THEN 'equal' ELSE 'diff' END ELSE status END AS status,
  array_to_string(list_filter(diff, lambda i: i NOT IN (2, 5)), ',') AS diff FROM res""")
def skip_columns(spark, sf_dir):
    r = compare.keyed_compare(*order_pair(spark, sf_dir), keys=[0], skip=[2, 5])
    return r.select("key", "status", joined("diff_cols", ",").alias("diff"))


@query(f"""WITH {PAIR}, x AS (SELECT array_to_string(c, '|') AS row FROM a GROUP BY 1), y AS (SELECT array_to_string(c, '|') AS row FROM b)
  SELECT row, CASE WHEN x.row IS NULL THEN 'unmatched_b' ELSE 'equal' END AS status FROM y LEFT JOIN x USING (row)
  UNION ALL SELECT row, 'unmatched_a' FROM x WHERE row NOT IN (SELECT row FROM y)""")
def whole_row_compare(spark, sf_dir):
    r = compare.whole_row_compare(*order_pair(spark, sf_dir))
    return r.select(F.replace("key", F.lit("\x1f"), F.lit("|")).alias("row"), "status")


TRAILER = "t(side, key, value) AS (SELECT 'a', 'RecNum', CAST(count(*) AS VARCHAR) FROM a UNION ALL SELECT 'b', 'RecNum', CAST(count(*) AS VARCHAR) FROM b UNION ALL VALUES ('a', 'SysID', '\"AAA\"'), ('b', 'SysID', '\"BBB\"'), ('a', 'Version', '1'), ('b', 'Version', '1'), ('a', 'Bare', ''), ('b', 'Bare', ''))"


@query(f"""WITH {PAIR}, {TRAILER} SELECT key, x.value AS a, y.value AS b, CASE WHEN x.value = y.value THEN 'equal' ELSE 'diff' END AS status
  FROM (SELECT * FROM t WHERE side = 'a') x JOIN (SELECT * FROM t WHERE side = 'b') y USING (key)""")
def trailer_compare(spark, sf_dir):
    (_, ta, _), (_, tb, _) = scanned(spark, sf_dir)
    return compare.trailer_compare(ta, tb).select("key", F.get("a_cols", F.lit(0)).alias("a"), F.get("b_cols", F.lit(0)).alias("b"), "status")


@query(f"""WITH {PAIR}, {TRAILER} SELECT key AS field, trim(x.value, '"') AS a, trim(y.value, '"') AS b, x.value = y.value AS equal
  FROM (SELECT * FROM t WHERE side = 'a') x JOIN (SELECT * FROM t WHERE side = 'b') y USING (key) WHERE key <> 'Bare'""")
def trailer_fields(spark, sf_dir):
    (_, ta, _), (_, tb, _) = scanned(spark, sf_dir)
    return compare.trailer_fields(ta, tb).drop("pair_id")


@query(f"WITH {PAIR} SELECT count(*) AS declared, count(*) AS data_rows, true AS ok FROM b")
def recnum_check(spark, sf_dir):
    _, (_, tb, sb) = scanned(spark, sf_dir)
    return compare.recnum_check(tb, sb).drop("pair_id")


@query(f"""WITH {PAIR} SELECT seq * 2 AS seq, array_to_string(c, '~') AS cols, len(c) AS width FROM a""")
def scan_delimited(spark, sf_dir):
    (da, _, _), _ = scanned(spark, sf_dir)
    return da.select("seq", joined("cols", "~").alias("cols"), F.size("cols").cast("long").alias("width"))


@query(f"WITH {PAIR} SELECT CAST(len(c) - seq % 3 AS INTEGER) AS width, count(*) AS n FROM a GROUP BY 1")
def column_count_dist(spark, sf_dir):
    """All records of A, some cut short."""
    a = order_pair(spark, sf_dir)[0]
    return scan.column_count_dist(a.withColumn("cols", F.slice("cols", F.lit(1), (F.size("cols") - F.col("seq") % 3).cast("int")))).drop("pair_id")


@query(f"WITH {RESULTS} SELECT CAST(col AS INTEGER) AS col, count(*) AS n FROM (SELECT unnest(diff) AS col FROM res) GROUP BY 1")
def diff_column_freq(spark, sf_dir):
    return summary.diff_column_freq(order_results(spark, sf_dir)).drop("pair_id")


@query(f"""WITH {RESULTS}, f AS (SELECT CAST(col AS INTEGER) AS col, count(*) AS n FROM (SELECT unnest(diff) AS col FROM res) GROUP BY 1)
  SELECT CAST(row_number() OVER (ORDER BY n DESC, col) AS INTEGER) AS rank, col, n, n * 100.0::DOUBLE / (SELECT count(*) FROM res WHERE status = 'diff') AS percent FROM f""")
def diff_concentration(spark, sf_dir):
    return summary.diff_concentration(order_results(spark, sf_dir)).drop("pair_id")


@query(f"WITH {PAIR}, k AS (SELECT count(*) - 1 AS n FROM b GROUP BY c[1]) SELECT CAST(sum(n) AS BIGINT) AS duplicates FROM k")
def duplicate_keys(spark, sf_dir):
    return summary.duplicate_keys(order_pair(spark, sf_dir)[1], [0]).drop("pair_id")


DUPS = "d AS (SELECT c[6] AS key, seq, row_number() OVER (PARTITION BY c[6] ORDER BY seq) AS i FROM a), top AS (SELECT CAST(row_number() OVER (ORDER BY min(seq)) AS INTEGER) AS rank, key, count(*) AS repeats FROM d WHERE i > 1 GROUP BY key)"


@query(f"WITH {PAIR}, {DUPS} SELECT * FROM top WHERE rank <= 10")
def duplicate_key_top(spark, sf_dir):
    """Priorities as keys: very many records have the same one."""
    return summary.duplicate_key_top(order_pair(spark, sf_dir)[0], [5]).drop("pair_id")


@query(f"""WITH {PAIR}, x AS (SELECT c[1] AS key, 0 AS side, min(seq) AS pl FROM (SELECT *, row_number() OVER (PARTITION BY c[1] ORDER BY seq) AS i FROM a) WHERE i > 1 GROUP BY 1),
  y AS (SELECT c[1] AS key, 1 AS side, min(seq) AS pl FROM (SELECT *, row_number() OVER (PARTITION BY c[1] ORDER BY seq) AS i FROM b) WHERE i > 1 GROUP BY 1),
  u AS (SELECT * FROM (SELECT * FROM x ORDER BY pl LIMIT 20) UNION ALL SELECT * FROM (SELECT * FROM y ORDER BY pl LIMIT 20)),
  f AS (SELECT key, min(side * 1000000000000 + pl) AS pl FROM u GROUP BY 1)
  SELECT CAST(row_number() OVER (ORDER BY pl) AS INTEGER) AS rank, key FROM f QUALIFY rank <= 20""")
def duplicate_key_samples(spark, sf_dir):
    a, b = order_pair(spark, sf_dir)
    return summary.duplicate_key_samples(a, b, [0]).drop("pair_id")


@query(f"""WITH {RESULTS} SELECT CASE WHEN status IN ('unmatched_a', 'unmatched_b') THEN 'unmatched' ELSE status END AS zone, count(*) AS n FROM res GROUP BY 1 UNION ALL SELECT 'trailer', 4""")
def zone_counts(spark, sf_dir):
    (da, ta, _), (db, tb, _) = scanned(spark, sf_dir)
    return summary.zone_counts(compare.keyed_compare(da, db, [0]).unionByName(compare.trailer_compare(ta, tb))).drop("pair_id")


# ---- dynamic sub-fields: date and priority of an order as one column ----


def dynamic_pair(spark, sf_dir):
    a, b = order_pair(spark, sf_dir)
    x = lambda i: F.get("cols", F.lit(i))
    forward = F.concat(F.lit("~~1B"), x(4), F.lit("~~1C"), x(5))
    backward = F.concat(F.lit("~~1C"), x(5), F.when(x(2) != "", F.concat(F.lit("~~1B"), x(4))).otherwise(""))
    return a.select("pair_id", "seq", F.array(x(0), forward).alias("cols")), b.select("pair_id", "seq", F.array(x(0), backward).alias("cols"))


@query(f"""WITH {RESULTS}, v AS (SELECT *, CASE WHEN status = 'unmatched_a' OR ac IS NULL THEN NULL ELSE bc[3] = '' END AS lacks FROM res)
  SELECT key, CASE WHEN status IN ('unmatched_a', 'unmatched_b') THEN status WHEN ac[6] <> bc[6] OR lacks THEN 'diff' ELSE 'equal' END AS status,
    CASE WHEN ac IS NULL OR bc IS NULL THEN '' ELSE concat_ws(',', CASE WHEN lacks THEN '1B' END, CASE WHEN ac[6] <> bc[6] THEN '1C' END) END AS diff FROM v""")
def keyed_compare_dynamic(spark, sf_dir):
    rows, _ = compare.keyed_compare_dynamic(*dynamic_pair(spark, sf_dir), keys=[0], dynamic=[1])
    label = F.transform(F.filter("dyn", lambda d: F.array_contains("diff_cols", d["idx"])), lambda d: d["k"])
    return rows.select("key", "status", F.array_join(F.array_sort(label), ",").alias("diff"))


@query(f"""WITH {PAIR} SELECT seq, 0 AS pos, '1B' AS code, c[5] AS content, 'date' AS name FROM a UNION ALL SELECT seq, 1, '1C', c[6], NULL FROM a""")
def expand_dynamic(spark, sf_dir):
    items = spark.createDataFrame([("1B", "date")], "item_code string, item_name string")
    return compare.expand_dynamic(dynamic_pair(spark, sf_dir)[0], 1, items).drop("pair_id")


# ---- grades: two halves of each customer's year of orders as counts of a pair ----

COUNTS = "s AS (SELECT CAST(o_custkey AS VARCHAR) AS pair_id, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS diff, count(*) FILTER (WHERE o_orderkey % 3 <> 0) AS equal, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS na, count(*) FILTER (WHERE o_orderkey % 2 <> 0) AS nb, na + 4 AS ta, nb + 2 AS tb FROM orders GROUP BY 1)"


def counts(spark, sf_dir):
    when = lambda c, n: F.count_if(c).alias(n)
    k = F.col("o_orderkey")
    out = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("pair_id")).agg(
        when(k % 3 == 0, "diff"), when(k % 3 != 0, "equal"), when(k % 2 == 0, "data_rows_a"), when(k % 2 != 0, "data_rows_b"), F.lit(0).cast("long").alias("only_a"), F.lit(0).cast("long").alias("only_b"))
    return out.withColumns({"total_a": F.col("data_rows_a") + 4, "total_b": F.col("data_rows_b") + 2})


GRADE = "CASE WHEN {0} >= 0.5 THEN '严重问题' WHEN {0} >= 0.2 THEN '务必关注' WHEN {0} >= 0.1 THEN '微量偏移' ELSE '正常' END"
VOLUME = "CASE WHEN 2000 * abs(ta - tb) // (ta + tb) >= 500 THEN '严重问题' WHEN 2000 * abs(ta - tb) // (ta + tb) >= 200 THEN '差异明显' WHEN 2000 * abs(ta - tb) // (ta + tb) >= 100 THEN '保持关注' ELSE '正常' END"


@query(f"""WITH {COUNTS}, r AS (SELECT *, diff::DOUBLE / (diff + equal) AS c, abs(tb - ta)::DOUBLE / greatest(1, ta) AS n FROM s)
  SELECT pair_id, equal, diff, round(c, 4) AS content_deviation, round(n, 4) AS count_deviation, {GRADE.format('c')} AS content_grade, {GRADE.format('n')} AS count_grade, {VOLUME} AS volume_grade FROM r""")
def deviation_report(spark, sf_dir):
    return summary.deviation_report(counts(spark, sf_dir))


@query(f"""WITH {COUNTS} SELECT 'b' || (CAST(pair_id AS BIGINT) % 10) AS batch_id, count(*) AS pairs, count(*) AS done, 0::BIGINT AS failed, 0::BIGINT AS no_rule, 0::BIGINT AS missing,
  count(*) FILTER (WHERE diff > 0) AS diff_files, CAST(sum(equal) AS BIGINT) AS equal, CAST(sum(diff) AS BIGINT) AS diff, 0::BIGINT AS only_a, 0::BIGINT AS only_b,
  CAST(sum(na) AS BIGINT) AS data_rows_a, CAST(sum(nb) AS BIGINT) AS data_rows_b, min(CAST(pair_id AS BIGINT)) AS started, max(CAST(pair_id AS BIGINT)) AS ended, 'done' AS state FROM s GROUP BY 1""")
def batch_overview(spark, sf_dir):
    s = counts(spark, sf_dir)
    k = F.col("pair_id").cast("long")
    pairs = s.select(F.concat(F.lit("b"), (k % 10).cast("string")).alias("batch_id"), "pair_id", F.lit("done").alias("state"), k.alias("started"), k.alias("ended"))
    return summary.batch_overview(pairs, s)


@query(f"""WITH {RESULTS}, na AS (SELECT count(*) + 4 AS ta FROM a), nb AS (SELECT count(*) + 4 AS tb FROM b) SELECT 'orders' AS pair_id,
  (SELECT count(*) FROM res WHERE status = 'equal') AS equal, (SELECT count(*) FROM res WHERE status = 'diff') AS diff, (SELECT count(*) FROM res WHERE status = 'unmatched_a') AS only_a,
  (SELECT count(*) FROM res WHERE status = 'unmatched_b') AS only_b, ta AS total_a, tb AS total_b, {VOLUME} AS volume_grade, '3,4,6' AS columns FROM na, nb""")
def batch_detail(spark, sf_dir):
    (da, _, sa), (db, _, sb) = scanned(spark, sf_dir)
    r = compare.keyed_compare(da, db, [0])
    s = summary.compare_summary(r, sa, sb, summary.malformed(da, [0]), summary.malformed(db, [0]))
    return summary.batch_detail(s, summary.diff_column_freq(r))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_summary(spark, sf_dir)
