"""Charsets: found by file, and re-encoded by column."""

from __future__ import annotations

import gzip
import sys
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import Mixed, _Bytes, heads, listing
from .scan import CHARSETS

#: Candidates in the order that decides full ties.
CANDIDATES = ("utf-8", "cp037", "cp500", "cp1047", "gb18030", "latin-1")
HEAD = 65_536


def detect_encoding(spark: SparkSession, path: str, delim: str = " | ") -> DataFrame:
    """``file_path, encoding`` of every file, from its first 64 KiB.

    A byte order mark decides.  Otherwise the candidates that decode without error and look printable by half compete by the number of
    delimiters, then by the printable share; a space byte rules the host charsets out, and UTF-16 joins where every fifth
    byte is zero.  The JVM decodes, so that all candidates are those the readers know.
    """
    return choose_encoding(heads(listing(spark, path), HEAD), delim)


def choose_encoding(files: DataFrame, delim: str = " | ") -> DataFrame:
    """As ``detect_encoding``, over ``file_path, h`` with the beginnings of files as binary."""
    hexed = F.hex("h")
    bom = (
        F.when(F.startswith(hexed, F.lit("EFBBBF")), "utf-8-sig").when(F.startswith(hexed, F.lit("FFFE")), "utf-16le").when(F.startswith(hexed, F.lit("FEFF")), "utf-16be")
    )
    nul = (F.length(F.regexp_replace(hexed, "(..)", "$1 ")) - F.length(F.replace(F.regexp_replace(hexed, "(..)", "$1 "), F.lit("00 "), F.lit("")))) / 3
    space = F.contains(F.regexp_replace(hexed, "(..)", "$1 "), F.lit("20 "))
    wide = nul * 5 >= F.length("h")

    def trial(name: str, order: int) -> Column:
        text = F.decode("h", CHARSETS[name])
        # a cut character at the end of the piece is no error, nor less printable
        whole = F.substring(text, F.lit(1), F.length(text) - F.when(F.length("h") >= HEAD, 4).otherwise(0))
        bad = F.contains(whole, F.lit("�"))
        solid = F.replace(whole, F.lit("\x00"), F.lit(""))
        shown = F.length(F.regexp_replace(solid, r"[\p{Cntrl}&&[^\t\r\n]]|\x{FFFD}", "")) / F.greatest(F.length(solid), F.lit(1))
        n = (F.length(text) - F.length(F.replace(text, F.lit(delim), F.lit("")))) / len(delim)
        out = ~bad & (shown >= 0.5)
        if name.startswith("cp"):
            out = out & ~space
        if name.startswith("utf-16"):
            out = out & wide
        return F.when(out, F.struct(n.alias("n"), shown.alias("p"), F.lit(-order).alias("o"), F.lit(name).alias("name")))

    best = F.array_max(F.filter(F.array(*[trial(n, i) for i, n in enumerate((*CANDIDATES, "utf-16le", "utf-16be"))]), lambda x: x.isNotNull()))
    return files.select("file_path", F.coalesce(bom, F.when(F.length("h") == 0, "utf-8"), best["name"], F.lit("utf-8")).alias("encoding"))


def transcode_fields(data: DataFrame, host: str, columns: dict[int, str]) -> DataFrame:
    """Records whose columns were decoded by the wrong charset: text goes back to the host's bytes and is decoded by the column's own.

    The new text counts only if the way back gives the same text and it has no replacement, zero or control characters (a tab may stay);
    padding at its end goes.
    """
    def one(x: Column, i: Column) -> Column:
        out = x
        for col, charset in columns.items():
            raw = F.encode(x, CHARSETS[host])
            new = F.decode(raw, CHARSETS[charset])
            good = (F.decode(raw, CHARSETS[host]) == x) & ~new.rlike(r"[\p{Cntrl}&&[^\t]]|\x{FFFD}")
            out = F.when((i == col) & good, F.regexp_replace(new, r"[\s\x00\x{3000}]+$", "")).otherwise(out)
        return out

    return data.withColumn("cols", F.transform("cols", one))


def normalize_mixed_charset(files: DataFrame, charset: str, delim: str, columns: dict[int, int]) -> DataFrame:
    """``file_path, seq, value``: as ``read_mixed``, for small contents that lie in a table already (``file_path, content``).  Files are
    read by ``read_mixed``, which never holds one."""
    mixed = Mixed(files.sparkSession, charset, delim, columns)

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["file_path"], part["content"], strict=True):
                out = list(mixed.lines(_Bytes(bytes(content), 0), 0, 1 << 62))
                yield pd.DataFrame({"file_path": path, "seq": range(len(out)), "value": out})

    return files.select("file_path", "content").mapInPandas(work, "file_path string, seq long, value string")


def unzip(files: DataFrame) -> DataFrame:
    """``file_path, content`` with archives unpacked, whatever their name's end; what isn't an archive stays."""
    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            def one(c: bytes) -> bytes:
                try:
                    return gzip.decompress(c) if c[:2] == b"\x1f\x8b" else c
                except (OSError, EOFError, zlib.error):
                    return c

            yield part.assign(content=[one(bytes(c)) for c in part["content"]])

    return files.select("file_path", "content").mapInPandas(work, "file_path string, content binary")


# tasks get this module's functions themselves, so workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
