"""A pair of files made from ``orders``: side A as it is, side B with known changes.

A repeats every order whose key is divisible by 107, with another priority.  B lacks keys divisible by 97,
has other prices (83), empty states (79) and other priorities (89), copies under new keys (101) and repeats (103).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.settle import settle

NEW_KEY = 10_000_000
NAMES = ["ORDERKEY", "CUSTKEY", "STATUS", "TOTALPRICE", "ORDERDATE", "PRIORITY"]


def scratch(spark: SparkSession) -> str:
    """A new folder for files beside the checkpoints, which all executors share."""
    settle(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4()}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Records of both sides: ``pair_id, seq, cols``."""
    # a file may be read in few splits, however large it is: dealt by key, the work behind is as many tasks as the rows need
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").cast("string").alias("c"), F.col("o_orderstatus").alias("s"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("p"), F.date_format("o_orderdate", "yyyyMMdd").alias("d"), F.col("o_orderpriority").alias("r"),
    ).repartition("k")
    every = lambda n: F.col("k") % n == 0
    record = lambda copy, key, s, p, r: F.struct(F.lit(copy).alias("copy"), F.array(key.cast("string"), F.col("c"), s, p.cast("string"), F.col("d"), r).alias("cols"))
    rows = lambda variants: o.select("k", F.explode(F.filter(F.array(*variants), lambda x: x.isNotNull())).alias("x")).select(F.lit("orders").alias("pair_id"), (F.col("k") * 4 + F.col("x.copy")).alias("seq"), F.col("x.cols").alias("cols"))
    k, s, p, r = (F.col(x) for x in "kspr")
    a = rows([record(0, k, s, p, r), F.when(every(107), record(1, k, s, p, F.lit("8-OLD")))])
    s = F.when(every(79), "").otherwise(s)
    p = F.when(every(83), p + F.lit("1.00").cast("decimal(18,2)")).otherwise(p).cast("decimal(18,2)")
    r = F.when(every(89), "9-X").otherwise(r)
    there = ~every(97)
    b = rows([F.when(there, record(0, k, s, p, r)), F.when(there & every(101), record(1, k + NEW_KEY, s, p, r)), F.when(there & every(103), record(2, k, s, p, r))])
    return a, b


#: Both sides in DuckDB's SQL: ``a`` and ``b`` with ``seq`` and the list ``c``.
PAIR = f"""
o AS (SELECT o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS cu, o_orderstatus AS s, CAST(o_totalprice AS DECIMAL(18,2)) AS p,
             strftime(o_orderdate, '%Y%m%d') AS d, o_orderpriority AS r FROM orders),
a AS (SELECT k * 4 AS seq, [CAST(k AS VARCHAR), cu, s, CAST(p AS VARCHAR), d, r] AS c FROM o
      UNION ALL SELECT k * 4 + 1, [CAST(k AS VARCHAR), cu, s, CAST(p AS VARCHAR), d, '8-OLD'] FROM o WHERE k % 107 = 0),
n AS (SELECT k, cu, CASE WHEN k % 79 = 0 THEN '' ELSE s END AS s, CASE WHEN k % 83 = 0 THEN CAST(p + 1.00 AS DECIMAL(18,2)) ELSE p END AS p, d,
             CASE WHEN k % 89 = 0 THEN '9-X' ELSE r END AS r FROM o WHERE k % 97 <> 0),
b AS (SELECT k * 4 AS seq, [CAST(k AS VARCHAR), cu, s, CAST(p AS VARCHAR), d, r] AS c FROM n
      UNION ALL SELECT k * 4 + 1, [CAST(k + {NEW_KEY} AS VARCHAR), cu, s, CAST(p AS VARCHAR), d, r] FROM n WHERE k % 101 = 0
      UNION ALL SELECT k * 4 + 2, [CAST(k AS VARCHAR), cu, s, CAST(p AS VARCHAR), d, r] FROM n WHERE k % 103 = 0)
"""

#: Result rows of the pair in SQL: ``res`` with key, status, ac, bc and diff, the list of differing columns.
RESULTS = f"""{PAIR},
last AS (SELECT c[1] AS key, max_by(c, seq) AS ac FROM a GROUP BY 1),
res AS (
  SELECT key, CASE WHEN ac IS NULL THEN 'unmatched_b' WHEN ac = bc THEN 'equal' ELSE 'diff' END AS status, ac, bc,
         CASE WHEN ac IS NULL THEN [] ELSE list_filter([0, 1, 2, 3, 4, 5], lambda i: ac[i + 1] <> bc[i + 1]) END AS diff, seq
  FROM (SELECT c[1] AS key, c AS bc, seq FROM b) LEFT JOIN last USING (key)
  UNION ALL
  SELECT key, 'unmatched_a', ac, NULL, [], NULL FROM last WHERE key NOT IN (SELECT c[1] FROM b))
"""


def lines_of(records: DataFrame, system: str, delim: str = " | ") -> DataFrame:
    """Lines of a delimited file: the records, a blank line for every 50th, and a trailer that declares their number."""
    body = records.select(
        "pair_id", F.col("seq") * 2, F.explode(F.when(F.col("seq") % 200 == 0, F.array(F.array_join("cols", delim), F.lit("  "))).otherwise(F.array(F.array_join("cols", delim)))).alias("value")
    ).toDF("pair_id", "seq", "value")
    body = body.withColumn("seq", F.col("seq") + (F.col("value") == "  ").cast("long"))
    end = records.groupBy("pair_id").agg(F.count("*").alias("n")).select(
        "pair_id", F.posexplode(F.array(F.concat(F.lit("|||||RecNum="), F.col("n").cast("string")), F.lit(f'|||||SysID="{system}"'), F.lit("Version=1"), F.lit("|||||Bare"))).alias("i", "value")
    )
    return body.unionByName(end.select("pair_id", (F.lit(2**50) + F.col("i")).alias("seq"), "value"))
