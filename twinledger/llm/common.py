"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One word: a longest run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that Python works on at a time.
ROWS = 1024
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, hold batches to ROWS rows, and make sure checkpoints have a folder.

    The checkpoint folder is the one that ``spark.checkpoint.dir`` names.  Only a local
    session without that setting (tests on one machine) gets a temporary one; on a cluster
    the setting is required, as executors don't share local folders.
    """
    sc = spark.sparkContext
    root = str(Path(__file__).resolve().parents[2])
    have = sc.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in have.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)
    if int(spark.conf.get(_BATCH)) > ROWS:  # texts can be long, so what goes to Python at a time stays small
        spark.conf.set(_BATCH, str(ROWS))
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return spark


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared checkpoint folder."""
    prepare(df.sparkSession)
    return df.checkpoint()


def fresh(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns that an operator is about to add: its own columns win."""
    wanted = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in wanted])


def packed(df: DataFrame) -> DataFrame:
    """All columns of ``df`` in one column ``row``, so that none can clash with an operator's own names."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unused(df: DataFrame, name: str) -> str:
    """A working name that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name.lower() in taken:
        name += "_"
    return name


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns can't clash with internal ones."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def give_back() -> None:
    """Let a worker that other tasks will use again return its free memory to the system."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def add_columns(
    df: DataFrame,
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
) -> DataFrame:
    """Append columns that Python computes batch by batch; all other columns pass through.

    ``make`` runs once in each task and returns the function of a batch.
    """
    df = fresh(df, *[f.name for f in fields])
    schema = T.StructType([*df.schema.fields, *fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):  # what Python holds at a time stays small
                batch = whole.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([*batch.columns, *work(batch)], names=names)
        del work
        give_back()

    prepare(df.sparkSession)
    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The batch's texts; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def crc_bucket(column: Column, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``; null ids have none."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(modulus).cast("long"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, bound: int) -> list[tuple[str, int]]:
    """At most ``bound`` labelled training texts, chosen by hash of the id.

    Ids whose crc32 falls on ``held`` never get here.  Only the bounded list of ids
    is broadcast; the texts come back through one scan of the documents.  The bound
    on rows also holds if an id has several rows.
    """
    marks = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (crc_bucket(F.col("doc_id"), modulus) != held))
        .groupBy("doc_id")
        .agg(F.max(label).alias("__label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    rows = (
        pick(docs, "doc_id", "text")
        .join(F.broadcast(marks), "doc_id")
        .select("doc_id", "__label", F.coalesce("text", F.lit("")).alias("text"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
        .limit(bound)
        .toPandas()
    )
    return list(zip(rows["text"], rows["__label"].astype(int), strict=True))
