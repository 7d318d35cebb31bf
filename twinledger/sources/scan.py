"""Text sources: lines in file order, delimited records, versions of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.strings import is_blank, split_columns, unquote
from .settle import settle

#: Names of charsets here and in Java.
CHARSETS = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "cp037": "IBM037", "cp500": "IBM500", "cp1047": "IBM1047", "gb18030": "GB18030", "latin-1": "ISO-8859-1", "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE"}
#: A session that reads these charsets, and replaces what it can't decode, has these settings.
SETTINGS = {"spark.sql.legacy.javaCharsets": "true", "spark.sql.legacy.codingErrorAction": "true"}


def number_lines(lines: DataFrame, by: list[str], block: str, place: str, name: str = "seq") -> DataFrame:
    """Running numbers from 0 over files that may be cut into many blocks.

    Numbers run inside each block, and each block starts where the blocks before it end; so a
    large file is never in one task.  ``block`` orders the blocks of a file, ``place`` the lines of a block.
    """
    lines = settle(lines)  # both uses must see the same places
    inside = Window.partitionBy(*by, block).orderBy(place)
    ahead = Window.partitionBy(*by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy(*by, block).agg(F.count("*").alias("__n"))
    starts = blocks.select(*by, block, F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__start"))
    numbered = lines.withColumn("__row", F.row_number().over(inside) - 1)
    return numbered.join(starts, [*by, block]).withColumn(name, (F.col("__row") + F.col("__start")).cast("long")).drop("__row", "__start")


#: The bytes that end lines in host charsets; in the first two both do.
HOST_ENDS = {"IBM037": (0x15, 0x25), "IBM500": (0x15, 0x25), "IBM1047": (0x15,)}


def _host_end(spark: SparkSession, path: str | list[str], charset: str) -> str:
    """The byte that ends most lines in the beginnings of host files."""
    from .ranges import heads, listing

    ends = HOST_ENDS[charset]
    if len(ends) == 1:
        return chr(ends[0])
    hexed = F.regexp_replace(F.hex("h"), "(..)", "$1 ")
    counts = heads(listing(spark, path), 65_536).agg(*[F.sum(F.regexp_count(hexed, F.lit(f"{b:02X} "))) for b in ends]).first()
    return chr(max(zip(ends, counts, strict=True), key=lambda x: x[1] or 0)[0])


def scan_lines(spark: SparkSession, path: str | list[str], encoding: str = "utf-8") -> DataFrame:
    """``file_path, seq, value``: the lines of text files, numbered from 0 in file order.

    Any of the usual line ends; a byte order mark goes; bytes that the charset doesn't know are replaced.  Host files are cut at
    the byte that ends most lines of their beginnings, and at other line ends where they are decoded.
    For charsets other than UTF-8 the session needs ``SETTINGS``.
    """
    charset = CHARSETS[encoding.lower()]
    reader, host = spark.read, charset in HOST_ENDS
    if host:
        reader = reader.option("lineSep", _host_end(spark, path, charset))
    lines = reader.text(path).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__place"), "value"
    )
    if charset != "UTF-8":
        lines = lines.withColumn("value", decode_text(F.col("value").cast("binary"), encoding))
    if host:
        pieces = F.split(F.regexp_replace("value", "\r?\n$", ""), "\r\n|\n", -1)
        lines = lines.select("file_path", "__block", "__place", F.posexplode(pieces).alias("__i", "value"))
        lines = lines.withColumn("__place", F.struct("__place", "__i")).drop("__i")
    lines = number_lines(lines, ["file_path"], "__block", "__place")
    value = F.when(F.col("seq") == 0, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value"))
    return lines.select("file_path", "seq", F.regexp_replace(value, r"\r$", "").alias("value"))


def decode_text(data: Column, encoding: str) -> Column:
    return F.decode(data, CHARSETS[encoding.lower()])


def scan_delimited(
    lines: DataFrame, delim: str | Column = " | ", trailer_prefix: str | Column = "|||||", keep: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, trailer and statistics of delimited files.

    ``lines`` has ``pair_id, seq, value``.  The first line that starts with the prefix opens the trailer, and every
    later line belongs to it.  Returns data ``pair_id, seq, cols``; trailer ``pair_id, seq, key, value, meta``; statistics
    ``pair_id, data_rows, trailer_rows, blank_lines`` for each pair.  Delimiter and prefix are texts, or columns of ``lines``, so
    that files of several kinds are read together; the data keep the columns in ``keep``.
    """
    prefix = F.lit(trailer_prefix) if isinstance(trailer_prefix, str) else trailer_prefix
    opens = F.startswith("value", prefix) & (F.length(prefix) > 0)
    starts = lines.groupBy("pair_id").agg(F.min(F.when(opens, F.col("seq"))).alias("__start"))
    # one row a pair goes to all tasks: dealt by pair, all lines of a pair would be one task's
    marked = lines.join(F.broadcast(starts), "pair_id").withColumn("__trailer", F.coalesce(F.col("seq") >= F.col("__start"), F.lit(False)))
    blank = F.col("value").isNull() | is_blank(F.col("value"))
    cut = split_columns(F.col("value"), delim)
    if isinstance(delim, Column):
        # behind explode a line is cut once: conditions by the pairs' rules would be pushed below, and cut it for each of their terms
        cut = F.explode(F.array(cut))
    data = marked.where(~F.col("__trailer") & ~blank).select("pair_id", "seq", cut.alias("cols"), *keep)
    body = F.when(opens, F.substring("value", F.length(prefix) + 1, F.lit(2**30))).otherwise(F.col("value"))
    at = F.instr(body, "=")
    key = F.when(at > 0, F.substring(body, F.lit(1), at - 1)).otherwise(body)
    value = F.when(at > 0, F.substring(body, at + 1, F.length(body))).otherwise("")
    trailer = marked.where(F.col("__trailer") & ~blank).select("pair_id", "seq", F.trim(key).alias("key"), value.alias("value"), unquote(value).alias("meta"))
    stats = marked.groupBy("pair_id").agg(
        F.count_if(~F.col("__trailer") & ~blank).alias("data_rows"), F.count_if(F.col("__trailer") & ~blank).alias("trailer_rows"), F.count_if(blank).alias("blank_lines")
    )
    return data, trailer, stats


def column_count_dist(data: DataFrame) -> DataFrame:
    """Records by their number of columns."""
    return data.groupBy("pair_id", F.size("cols").alias("width")).agg(F.count("*").alias("n"))


def scan_versions(files: DataFrame) -> DataFrame:
    """``logical_name, path, plain`` of the version to read of each file, from a listing with ``path``.

    ``x.gz`` and ``x.gz.`` with nine digits are archives of ``x``; the greatest name is the newest, and a plain file
    beats all archives.
    """
    name = F.regexp_extract("path", r"[^/]*$", 0)
    logical = F.regexp_replace(name, r"(?i)\.gz(\.[0-9]{9})?$", "")
    rows = files.select("path", name.alias("name"), logical.alias("logical_name"))
    best = F.max_by(F.col("path"), F.struct(F.col("name") == F.col("logical_name"), "name"))
    return rows.groupBy("logical_name").agg(best.alias("path"), F.max(F.col("name") == F.col("logical_name")).alias("plain"))


def write_results(results: DataFrame, path: str) -> None:
    """Result rows as Parquet, cut by what is filtered on."""
    results.write.partitionBy("pair_id", "section", "status").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
