"""Small tables that users keep: report types and fields, charset maps, dynamic sub-fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.strings import strip


def read_dictionary(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A CSV file with a header, quoted line feeds and doubled quotes, cells as text, with ``row_no``."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding=encoding)
    return rows.select(*[strip(F.col(f"`{c}`")).alias(c.replace("﻿", "").strip().lower()) for c in rows.columns], F.monotonically_increasing_id().alias("row_no"))


def load_report_types(rows: DataFrame) -> DataFrame:
    """``report_id, pattern, kind, ownership_group, import_order`` from the cells of the types' file, rows without id or pattern left out."""
    out = rows.select(strip(F.col("report_id")).alias("report_id"), strip(F.col("report_file_name")).alias("pattern"), F.upper(strip(F.col("parm_report_type"))).alias("kind"), strip(F.col("ownership_group")).alias("ownership_group"), F.col("row_no").alias("import_order"))
    return out.where((F.col("report_id") != "") & (F.col("pattern") != ""))


def load_report_fields(rows: DataFrame) -> DataFrame:
    """``report_id, field_index, field_name, field_format, field_length``; an index that isn't a number is the row's place in its report."""
    place = F.row_number().over(Window.partitionBy("report_id").orderBy("row_no"))
    return rows.select("report_id", F.coalesce(F.trim("field_index").try_cast("int"), place).alias("field_index"), "field_name", "field_format", "field_length")


def load_charset_map(rows: DataFrame) -> DataFrame:
    """``table_name, col_index, charset, field_name, field_length``, and ``import_order`` where rows have a ``row_no``; rows of
    the host's own charset (``E``) are left out."""
    order = [F.col("row_no").alias("import_order")] if "row_no" in rows.columns else []
    out = rows.select(*order, strip(F.col("table_name")).alias("table_name"), F.trim("col_index").try_cast("int").alias("col_index"), F.upper(strip(F.col("charset"))).alias("charset"), "field_name", F.trim("field_length").try_cast("int").alias("field_length"))
    return out.where((F.col("table_name") != "") & (F.col("col_index") >= 1) & (F.col("charset") != "E"))


def load_dynamic_fields(items: DataFrame) -> DataFrame:
    """``dyn_name, item_code, item_name``: codes are two letters or digits, of equal ones the first row stays."""
    rows = items.select("row_no", strip(F.col("dyn_name")).alias("dyn_name"), strip(F.col("item_code")).alias("item_code"), strip(F.col("item_name")).alias("item_name"))
    good = rows.where(F.col("item_code").rlike(r"^[\p{L}\p{Nd}]{2}$") & (F.col("dyn_name") != ""))
    return good.groupBy("dyn_name", "item_code").agg(F.min_by("item_name", "row_no").alias("item_name"))
