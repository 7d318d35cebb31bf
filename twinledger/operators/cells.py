"""The cells that a result row's column numbers stand for: columns of the record, or sub-fields of its dynamic columns.

Result rows of ``keyed_compare_dynamic`` carry their registry: each element of ``dyn`` has, besides both values, the number
of its virtual column (``idx``), its short label (``107-1B``) and its full name.  Everything that shows differences asks here
for a number's value, label and name, so that both kinds of columns show alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import column_name

#: Virtual columns of dynamic sub-fields are numbered above this.
VIRTUAL = 1_000_000


def name_array(names: list[str] | None) -> Column:
    return F.array(*[F.lit(n) for n in names or []]).cast("array<string>")


class Cells:
    """Values, labels and names by column number, for the rows of ``results``.

    ``names`` are those of the record's columns.  Rows without ``dyn`` have only these.
    """

    def __init__(self, results: DataFrame, names: list[str] | None = None):
        self.dynamic = "dyn" in results.columns
        self.names = name_array(names)

    def _found(self, i: Column, field: str) -> Column:
        return F.get(F.filter(F.col("dyn"), lambda d: d["idx"] == i), F.lit(0))[field]

    def _either(self, i: Column, real: Callable[[Column], Column], field: str, other: Column) -> Column:
        if not self.dynamic:
            return real(i)
        return F.when(i > VIRTUAL, F.coalesce(self._found(i, field), other)).otherwise(real(i))

    def value(self, side: str, i: Column) -> Column:
        """A side's value, empty where it has none."""
        return self._either(i, lambda n: F.coalesce(F.get(F.col(f"{side}_cols"), n), F.lit("")), side, F.lit(""))

    def number(self, i: Column) -> Column:
        """The number that is shown: from 1, or a virtual column's short label."""
        return self._either(i, lambda n: (n + 1).cast("string"), "label", i.cast("string"))

    def name(self, i: Column) -> Column:
        return self._either(i, lambda n: column_name(self.names, n), "name", F.lit("虚拟列"))

    def summary(self, numbers: Column) -> Column:
        """The columns as one text: ``number-name；`` each, virtual ones by their full name."""
        one = lambda i: self._either(i, lambda n: F.concat((n + 1).cast("string"), F.lit("-"), column_name(self.names, n)), "name", i.cast("string"))
        return F.array_join(F.transform(numbers, lambda i: F.concat(one(i), F.lit("；"))), "")


def registry_of(results: DataFrame) -> DataFrame:
    """``pair_id, idx, c, k, label, name`` of every virtual column that the rows carry, a few for each pair."""
    return results.select("pair_id", F.explode("dyn").alias("x")).select("pair_id", "x.idx", "x.c", "x.k", "x.label", "x.name").distinct()
