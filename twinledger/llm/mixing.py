"""Mixing sources to target weights by systematic sampling.

Only DataFrame functions run here.  Every document of a source is expected the same
number of times, ``rate = target / source size``.  Documents of a source stand in a
fixed order; ``rank * rate`` is the prefix sum of their expected copies.  One offset
``u`` in [0, 1) is added for each source, and a document is taken once for each integer
that its step crosses.  The order goes by size class first, so the words taken
follow the target as closely as the number of documents does.

The prefix sum is built in three levels (size class, slot, row), so no task ever
needs a whole source: a source may hold most of the rows.  A slot is a range of the ids' hashes, by which the rows of
a class are ordered, so the number of slots can follow that of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, fresh, packed, prepare

OUT = ("size", "source_size", "target", "copies", "taken")
_SLOT = 65536  # rows of the table for each slot


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Sizes to 8 are their own class; above, each doubling is cut into 8."""
    shift = F.length(F.bin(size)) - F.lit(4)
    step = F.pow(F.lit(2.0), shift.cast("double"))
    return F.when(size < 8, size).otherwise(shift.cast("long") * 8 + F.floor(size / step)).cast("int")


def _fraction(text: Column) -> Column:
    """A fixed number in [0, 1) from a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _prefix(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Exclusive prefix sums over a whole table, without a task that sees all rows.

    The rows are cut into ordered ranges and written once, so that the ranges stay the
    same; only one total for each range meets in a single window.
    """
    cut = checkpoint(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    own = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.groupBy("__part").agg(*[F.sum(c).alias(f"__all_{n}") for n, c in sums.items()])
    starts = parts.select("__part", *[F.coalesce(F.sum(f"__all_{n}").over(ahead), F.lit(0)).alias(f"__at_{n}") for n in sums])
    cut = cut.withColumns({f"__in_{n}": F.coalesce(F.sum(c).over(own), F.lit(0)) for n, c in sums.items()})
    out = cut.join(F.broadcast(starts), "__part")  # one row for each range
    return out.select(*df.columns, *[(F.col(f"__in_{n}") + F.col(f"__at_{n}")).alias(n) for n in sums])


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """Target of every source.

    ``sources`` has one row a source: ``source`` and ``source_size``.  Weights repeat over the
    sources by code point, null last.  ``share`` times the total is dealt by weight;
    no source gets over ``ceiling`` times its size, and what is above goes to the others by
    weight.  That ends at one level: sources whose ``ceiling * size / weight`` is below it
    stay at their ceiling, the others get ``level * weight``.
    """
    ranked = _prefix(sources, [F.col("source").isNull(), F.col("source")], {"__rank": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", weight.alias("__w"), (F.col("source_size") * F.lit(ceiling)).alias("__cap"))
    ranked = ranked.withColumn("__ratio", F.col("__cap") / F.col("__w"))
    full = _prefix(ranked, [F.col("__ratio"), F.col("source").isNull(), F.col("source")], {"__caps": F.col("__cap"), "__ws": F.col("__w")})
    total, all_w = full.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("__w"), F.lit(0.0))).first()
    level = (F.lit(share * total) - F.col("__caps")) / (F.lit(float(all_w)) - F.col("__ws"))
    full = full.withColumn("__level", level)
    open_ = full.where(F.col("__ratio") > F.col("__level")).agg(F.min_by("__level", F.struct("__ratio", F.col("source").isNull(), "source"))).first()[0]
    held = F.col("__cap") if open_ is None else F.least(F.col("__cap"), F.lit(open_) * F.col("__w"))
    return full.select("source", "source_size", held.alias("target"))


def _taken(docs: DataFrame, weights: tuple[int, ...], share: float, ceiling: float, seed: int, slots: int | None) -> DataFrame:
    """``row`` (all columns of ``docs``) with the columns of OUT."""
    prepare(docs.sparkSession)
    if slots is None:
        slots = max(64, -(-docs.count() // _SLOT))
    key = ["src", "cls", "slot"]
    place_of = _fraction(F.col("row.doc_id").cast("string"))
    rows = (
        packed(docs)
        .withColumn("size", word_count(F.col("row.text")))
        .withColumn("src", F.coalesce(F.concat(F.lit("="), F.col("row.source")), F.lit("")))
        # never null, as it can't be: else the join's check for nulls counts the words again before the scan's projection
        .withColumn("cls", F.coalesce(size_class(F.col("size")), F.lit(0)))
        .withColumn("slot", F.coalesce(F.floor(place_of * slots), F.lit(0)).cast("int"))
    )
    # one row for each source, class and slot
    groups = checkpoint(rows.groupBy(*key).agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    classes = groups.groupBy("src", "cls").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    by_source = classes.groupBy("src").agg(F.sum("words").alias("source_size"))
    named = by_source.select(F.when(F.col("src") != "", F.substring(F.col("src"), 2, 2**30)).alias("source"), "source_size")
    goal = targets(named, weights, share, ceiling).select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("src"), "source_size", "target")

    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    nth = lambda w: F.coalesce(F.sum("n").over(w), F.lit(0))
    at_class = classes.select("src", "cls", nth(before("src", "cls")).alias("at_class"))
    at_slot = groups.select(*key, nth(before("src", "cls", "slot")).alias("at_slot"))
    starts = at_slot.join(at_class, ["src", "cls"]).join(goal, "src")

    order = [F.coalesce(place_of, F.lit(0.0)), F.col("row.doc_id").asc_nulls_first(), F.col("size")]
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).join(starts, key)
    rank = F.col("at_class") + F.col("at_slot") + F.col("place")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = _fraction(F.concat(F.lit(f"offset {seed} "), F.col("src")))
    copies = F.floor(rank * rate + start) - F.floor((rank - 1) * rate + start)
    return rows.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size")).select("row", *OUT)


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    ceiling: float = 2.0,
    seed: int = 0,
    slots: int | None = None,
) -> DataFrame:
    """All rows of ``docs`` with ``size, source_size, target, copies, taken``.

    ``copies`` says how often the mix takes the document, ``taken`` is copies times size.
    Needs ``doc_id``, ``text``, ``source``.  Null text has size 0; a null source is a source
    of its own, last in order; null ids stand first.  Rows that repeat are sampled each on
    their own; which of several rows that are alike is taken makes no difference.  A source without
    words has target 0 and takes nothing.  Input columns named like an output are replaced.
    An empty table gives an empty result.  ``slots`` sets how many ways the rows of one source
    and size class are split, by default one for each 65,536 rows of ``docs``, 64 at least; it changes no result.
    """
    out = _taken(docs, weights, share, ceiling, seed, slots)
    return out.select(*[F.col(f"row.`{c}`") for c in fresh(docs, *OUT).columns], *OUT)


def mixed_rows(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, ceiling: float = 2.0, seed: int = 0, slots: int | None = None
) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with all columns of ``docs``."""
    taken = _taken(docs, weights, share, ceiling, seed, slots).where(F.col("copies") > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


#: The same result in DuckDB's SQL.
SQL = r"""
WITH base AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), keyed AS (
  SELECT *, coalesce('=' || source, '') AS src,
    CASE WHEN size < 8 THEN size
         ELSE (length(bin(size)) - 4) * 8 + CAST(floor(size / pow(2.0, length(bin(size)) - 4)) AS BIGINT) END AS cls,
    coalesce(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT), 0) AS place
  FROM base
), sources AS (
  SELECT src, source, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3) + 1]::DOUBLE AS w
  FROM keyed GROUP BY src, source
), capped AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS ratio FROM sources
), levels AS (
  SELECT *, (1.5::DOUBLE * (SELECT CAST(sum(source_size) AS DOUBLE) FROM capped)
       - coalesce(sum(cap) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
     / ((SELECT sum(w) FROM capped)
       - coalesce(sum(w) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lev
  FROM capped
), goal AS (
  SELECT src, source_size, CASE WHEN (SELECT count(*) FROM levels WHERE ratio > lev) = 0 THEN cap
    ELSE least(cap, w * (SELECT lev FROM levels WHERE ratio > lev ORDER BY ratio, source IS NULL, source LIMIT 1)) END AS target
  FROM levels
), ranked AS (
  SELECT doc_id, size, source_size, target, src,
    row_number() OVER (PARTITION BY src ORDER BY cls, place, doc_id NULLS FIRST, size) AS rank,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    CAST('0x' || substr(md5('offset 0 ' || src), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM keyed JOIN goal USING (src)
)
SELECT doc_id, size, source_size, target,
  CAST(floor(rank * rate + u) - floor((rank - 1) * rate + u) AS BIGINT) * size AS taken
FROM ranked
"""
