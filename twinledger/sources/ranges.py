"""Files read by byte ranges, whatever bytes they hold: heads, and records in which a line feed may be part of a character.

A listing comes from Spark without any content; tasks open files themselves and read only their range, a piece at a time, so
no value is ever a whole file.  Archives can't be entered in the middle: they are one range and are unpacked as they are read.

Where some columns are UTF-16, a line feed byte in the middle of a file doesn't tell whether a record begins behind it.  Each range
therefore says, for every line feed in it, at which place behind the range its records would end; nearly all agree, as a
wrong start soon meets a right one.  Following these answers from each file's beginning, one row a range, gives the place
at which each range's first record begins, and the ranges are then read at the same time.
"""

from __future__ import annotations

import codecs
import sys
import zlib
from collections.abc import Iterator
from io import BytesIO
from itertools import islice

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scan import CHARSETS, number_lines
from .settle import settle

RANGE = 16 << 20
PIECE = 1 << 20
#: Charsets with one byte a character; their tables come from the JVM, so that all readers agree.
SINGLE = ("cp037", "cp500", "cp1047", "latin-1")


def _open(path: str):
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return system.open_input_file(at)


class _Bytes:
    """The bytes of a file from a place on, read in pieces; of an archive from its beginning on, unpacked."""

    def __init__(self, path: str | bytes, start: int, piece: int = PIECE):
        self.file, self.piece = BytesIO(path) if isinstance(path, bytes) else _open(path), piece
        self.packed = zlib.decompressobj(31) if self.file.read(2) == b"\x1f\x8b" else None
        self.file.seek(0 if self.packed else start)
        self.at, self.held, self.done, self.rest = 0 if self.packed else start, bytearray(), False, b""

    def more(self) -> bool:
        """Read a piece; false at the end."""
        if self.done:
            return False
        got = self.file.read(self.piece) if not self.packed else self._unpacked()
        self.done = not got
        self.held += got
        return bool(got)

    def _unpacked(self) -> bytes:
        """The next piece of an archive, which may have several members; what is no member ends it."""
        try:
            while True:
                self.rest = self.rest or self.file.read(self.piece)
                if not self.rest:
                    return b"" if self.packed.eof else self.packed.flush()
                if self.packed.eof:
                    self.rest += self.file.read(self.piece) if len(self.rest) < 2 else b""
                    if self.rest[:2] != b"\x1f\x8b":
                        return b""
                    self.packed = zlib.decompressobj(31)
                got = self.packed.decompress(self.rest, self.piece)
                self.rest = self.packed.unused_data if self.packed.eof else self.packed.unconsumed_tail
                if got:
                    return got
        except zlib.error:
            return b""

    def find(self, what: bytes, at: int) -> int:
        """The place of the next ``what``, or -1."""
        seen = at
        while True:
            found = self.held.find(what, max(0, seen - self.at))
            if found >= 0:
                return found + self.at
            seen = max(at, self.at + len(self.held) - len(what) + 1)
            if not self.more():
                return -1

    def get(self, at: int, end: int) -> bytes:
        return bytes(self.held[at - self.at : end - self.at])

    def end(self, at: int) -> bool:
        """Whether the file ends at a place."""
        while self.at + len(self.held) <= at:
            if not self.more():
                return True
        return False

    def size(self) -> int:
        return self.at + len(self.held)

    def forget(self, before: int) -> None:
        """Let go of what lies before a place."""
        if before - self.at > self.piece:
            del self.held[: before - self.at]
            self.at = before


def _record(data: _Bytes, at: int, mark: bytes, columns: dict[int, int]) -> tuple[list[tuple[int, int]], int]:
    """The cells of the record at a place, and where the next begins.  A cell of declared length holds its line feeds."""
    cells: list[tuple[int, int]] = []
    while True:
        size = columns.get(len(cells), -1)
        end = data.find(b"\n", at + (2 * size if size > 0 else 0))
        last = end < 0
        if last:
            end = max(at, data.size())
        stop = data.held.find(mark, at - data.at, end - data.at)
        if stop >= 0:
            cells.append((at, stop + data.at))
            at = stop + data.at + len(mark)
            continue
        cells.append((at, end))
        return cells, end if last else end + 1


def listing(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file_path, length`` of files; their content is not read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file_path"), "length")


def heads(files: DataFrame, size: int) -> DataFrame:
    """``file_path, h``: the first ``size`` bytes of each file, unpacked if it is an archive."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), 64):
                paths, out = part["file_path"].iloc[at : at + 64], []
                for path in paths:
                    data = _Bytes(path, 0, size)
                    while len(data.held) < size and data.more():
                        pass
                    out.append(bytes(data.held[:size]))
                yield pd.DataFrame({"file_path": paths.array, "h": out})

    return files.select("file_path").mapInPandas(work, "file_path string, h binary")


def ranges(files: DataFrame, size: int = RANGE) -> DataFrame:
    """``file_path, start, stop``: ranges of ``size`` bytes, dealt out to tasks; archives (by their names) are one range."""
    whole = F.col("file_path").rlike(r"(?i)\.gz(\.[0-9]{9})?$")
    starts = F.when(whole | (F.col("length") <= size), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long")))
    cut = files.select("file_path", "length", whole.alias("whole"), F.explode(starts).alias("start"))
    cut = settle(cut.select("file_path", "start", F.when(F.col("whole"), F.lit(2**62)).otherwise(F.least(F.col("start") + size, "length")).alias("stop")))
    return settle(cut.repartition(max(1, min(cut.count(), 10_000)), "file_path", "start"))


def _entries(cut: DataFrame, mark: bytes, columns: dict[int, int], piece: int) -> DataFrame:
    """``file_path, start, stop, entry``: where the first record that begins in a range begins; null if none does."""

    def answers(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, start, stop in part[["file_path", "start", "stop"]].itertuples(index=False):
                after: dict[int, int] = {}
                if start == 0 and stop < 1 << 62:
                    # a file begins with a record, so there is only one way
                    data, q = _Bytes(path, 0, piece), 0
                    while q < stop and not data.end(q):
                        _, q = _record(data, q, mark, columns)
                        data.forget(q)
                    after[0] = q
                elif stop < 1 << 62:  # else one range is the whole file
                    data, at = _Bytes(path, start - 1, piece), start - 1
                    while 0 <= (at := data.find(b"\n", at)) < stop - 1:
                        at += 1
                        _, after[at] = _record(data, at, mark, columns)
                        data.forget(at)
                    # a record that ends inside the range goes on as the one behind it does, from the last place backwards
                    for p in sorted(after, reverse=True):
                        after[p] = after.get(after[p], after[p])
                usual = pd.Series(after.values()).mode().iloc[0] if after else -1
                others = {p: q for p, q in after.items() if q != usual}
                yield pd.DataFrame({"file_path": [path], "start": [start], "stop": [stop], "usual": [usual], "at": [list(others)], "to": [list(others.values())]})

    told = cut.mapInPandas(answers, "file_path string, start long, stop long, usual long, at array<long>, to array<long>")

    def follow(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("start")
        entry, out = 0, []
        for start, stop, usual, at, to in part[["start", "stop", "usual", "at", "to"]].itertuples(index=False):
            here = entry if start <= entry < stop or not start else None
            out.append(here)
            if here is not None:
                entry = dict(zip(at, to, strict=True)).get(here, usual)
        return pd.DataFrame({"file_path": part["file_path"], "start": part["start"], "stop": part["stop"], "entry": pd.array(out, "Int64")})

    # one row for each range of a file
    return told.groupBy("file_path").applyInPandas(follow, "file_path string, start long, stop long, entry long")


def host_table(spark: SparkSession, charset: str) -> str:
    """The characters of all 256 bytes, as the JVM has them."""
    every = bytes(range(256)).hex()
    return spark.sql(f"SELECT concat_ws('', transform(sequence(0, 255), i -> decode(substring(x'{every}', i + 1, 1), '{CHARSETS[charset]}'))) AS t").first()["t"]


class Mixed:
    """Records of a charset's files in which some columns are UTF-16: ``columns`` gives each one's declared length, 0 if unknown."""

    def __init__(self, spark: SparkSession, charset: str, delim: str, columns: dict[int, int]):
        self.codec, self.delim, self.columns = CHARSETS[charset], delim, columns
        self.table = host_table(spark, charset) if charset in SINGLE else None
        self.mark = bytes(map(self.table.index, delim)) if self.table else delim.encode(self.codec)

    def decoded(self, raw: bytes, errors: str) -> str:
        return codecs.charmap_decode(raw, errors, self.table)[0] if self.table else raw.decode(self.codec, errors)

    def cell(self, raw: bytes, n: int, last: bool) -> str:
        """A cell of twice the declared bytes is trusted, any other is UTF-16 if its bytes don't fit the main charset and its text looks better so."""
        if n not in self.columns:
            return self.decoded(raw.removesuffix(b"\r") if last else raw, "replace")
        shown = lambda text: sum(c.isprintable() or c in "\t " for c in text) / max(1, len(text))
        wide = [raw.decode(c, "replace").rstrip("\x00 　") for c in ("utf-16-be", "utf-16-le")] if len(raw) % 2 == 0 and raw else []
        best = max(wide, key=shown, default="")
        if wide and self.columns[n] and len(raw) == 2 * self.columns[n]:
            return best
        try:
            text = self.decoded(raw, "strict")
            dirty = any(ord(c) < 32 and c != "\t" for c in text)
        except UnicodeDecodeError:
            text, dirty = self.decoded(raw, "replace"), True
        return best if wide and dirty and shown(best) > shown(text) else text

    def lines(self, data: _Bytes, at: int, stop: int) -> Iterator[str]:
        """The records that begin from ``at`` up to ``stop``."""
        while at < stop and not data.end(at):
            cells, after = _record(data, at, self.mark, self.columns)
            yield self.delim.join(self.cell(data.get(a, b), n, n + 1 == len(cells)) for n, (a, b) in enumerate(cells))
            at = after
            data.forget(at)


def read_mixed(spark: SparkSession, path: str | list[str], charset: str, delim: str, columns: dict[int, int], size: int = RANGE, piece: int = PIECE) -> DataFrame:
    """``file_path, seq, value``: records of files in which some columns are UTF-16 inside another charset; see ``Mixed``.

    The delimiter is met as bytes; a line feed ends a record unless it lies inside a cell's declared length.  Archives are
    unpacked as they are read.  What a task holds is a piece and the longest record, whatever the file's size; in the first pass
    also a number for each line feed of a range.
    """
    mixed = Mixed(spark, charset, delim, columns)

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, start, stop, entry in part[["file_path", "start", "stop", "entry"]].itertuples(index=False):
                if pd.isna(entry):
                    continue
                lines, place = mixed.lines(_Bytes(path, int(entry), piece), int(entry), stop), 0
                while some := list(islice(lines, 4096)):
                    yield pd.DataFrame({"file_path": path, "block": start, "place": range(place, place + len(some)), "value": some})
                    place += len(some)

    cut = settle(_entries(ranges(listing(spark, path), size), mixed.mark, columns, piece))
    cut = cut.repartition(max(1, min(cut.count(), 10_000)), "file_path", "start")
    lines = number_lines(cut.mapInPandas(work, "file_path string, block long, place long, value string"), ["file_path"], "block", "place")
    return lines.select("file_path", "seq", "value")


# tasks get this module's functions themselves, so workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
