"""Result rows in files with an index of what each holds, so that a page is read from the files it spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_paged(results: DataFrame, path: str, order: str = "seq") -> None:
    """Result rows under ``path/rows``, in order within and across files, and their index under ``path/index``.

    The index has a row for each file, pair, section and status: number of rows, smallest and largest place.
    """
    spark = results.sparkSession
    sorted_ = results.repartitionByRange("pair_id", order).sortWithinPartitions("pair_id", order)
    sorted_.write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    index = rows.groupBy(F.col("_metadata.file_path").alias("file"), "pair_id", "section", "status").agg(F.count("*").alias("n"), F.min(order).alias("low"), F.max(order).alias("high"))
    index.coalesce(1).write.parquet(f"{path}/index")


def read_page(spark: SparkSession, path: str, pair_id: str, offset: int, limit: int, status: str | None = None, section: str | None = None, order: str = "seq") -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of a pair, perhaps of one status or section, in order; ``total`` is their number in all.

    The index says in which files the page lies: only these are read, and only their rows are sorted.
    """
    index = spark.read.parquet(f"{path}/index").where(F.col("pair_id") == pair_id)
    wanted = lambda d: d.where((F.col("status") == status) if status else F.lit(True)).where((F.col("section") == section) if section else F.lit(True))
    files = wanted(index).groupBy("file").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    ahead = Window.orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    total = files.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    here = files.where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)).orderBy("before").select("file", "before").collect()  # those that a page spans
    if not here:
        return spark.read.parquet(f"{path}/rows").limit(0).withColumn("total", F.lit(total).cast("long"))
    rows = wanted(spark.read.parquet(*[r["file"] for r in here]).where(F.col("pair_id") == pair_id))
    return rows.orderBy(order).offset(offset - here[0]["before"]).limit(limit).withColumn("total", F.lit(total).cast("long"))
