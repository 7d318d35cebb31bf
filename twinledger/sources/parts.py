"""Export files: lines that are ready to be written, one file for each part of a pair's records.

Each task writes the parts it holds to a folder of its own attempt; only when all tasks are through are the files that they
report moved to where they belong, and if the job fails all of it is deleted.  So a failed or repeated task leaves nothing.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Fixed values of the dialect.
BOM, LINE_END = "﻿", "\r\n"
PENDING = "_pending"


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: where they lie, and where they belong."""

    files: list[tuple[str, str]]


class PartsWriter(DataSourceArrowWriter):
    """Writes rows ``pair_id, part, line``, sorted by the first two; a null line only makes its file be there."""

    def __init__(self, path: str, header: str):
        self.path, self.header, self.job = path, header, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _system(self.path)
        attempt = f"{root}/{PENDING}-{self.job}/{uuid.uuid4().hex}"
        files: list[tuple[str, str]] = []
        out, key = None, None
        try:
            for batch in iterator:
                for pair, part, line in zip(*(batch.column(n).to_pylist() for n in range(3)), strict=True):
                    if (pair, part) != key:
                        if out:
                            out.close()
                        key = (pair, part)
                        system.create_dir(attempt, recursive=True)
                        name = f"{re.sub(r'[^0-9A-Za-z._-]', '_', pair)}.{part:05d}.csv"
                        files.append((f"{attempt}/{len(files)}", f"{root}/{name}"))
                        out = system.open_output_stream(files[-1][0])
                        out.write(f"{BOM}{self.header}{LINE_END}".encode())
                    if line is not None:
                        out.write(f"{line}{LINE_END}".encode("utf-8", "surrogatepass"))
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _system(self.path)
        for message in messages:
            for held, wanted in message.files if message else []:
                system.move(held, wanted)
        self._clear(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_system(self.path))

    def _clear(self, system, root: str) -> None:
        from pyarrow import fs

        pending = f"{root}/{PENDING}-{self.job}"
        if system.get_file_info(pending).type != fs.FileType.NotFound:
            system.delete_dir(pending)


class PartsSource(DataSource):
    """``format("export_parts")`` with options ``path`` and ``header``."""

    @classmethod
    def name(cls) -> str:
        return "export_parts"

    def schema(self) -> str:
        return "pair_id string, part int, line string"

    def writer(self, schema, overwrite: bool) -> PartsWriter:
        return PartsWriter(self.options["path"], self.options["header"])


def write_parts(lines: DataFrame, path: str, header: list[str], order: list[Column], pairs: DataFrame | None = None) -> None:
    """Files ``<pair>.<part>.csv`` under ``path``, a header in each.

    ``lines`` has ``pair_id, part`` and ``line``, in the dialect already; ``order`` is theirs inside a part.  Pairs in ``pairs`` that
    have no line get a file with the header alone.  A part has a bounded number of records, so it is one task's.
    """
    spark = lines.sparkSession
    spark.dataSource.register(PartsSource)
    rows = lines.select("pair_id", F.col("part").cast("int").alias("part"), "line", F.struct(*order).alias("at"))
    if pairs is not None:
        none = lambda t: F.lit(None).cast(t)
        rows = rows.unionByName(pairs.select("pair_id", F.lit(0).alias("part"), none("string").alias("line"), none(rows.schema["at"].dataType).alias("at")))
    rows = rows.repartition("pair_id", "part").sortWithinPartitions("pair_id", "part", F.col("at").asc_nulls_first())
    quote = lambda h: '"' + h.replace('"', '""') + '"' if re.search('[",\r\n]', h) else h
    rows.select("pair_id", "part", "line").write.format("export_parts").option("path", path).option("header", ",".join(map(quote, header))).mode("append").save()


# tasks get this module's classes themselves, so workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
