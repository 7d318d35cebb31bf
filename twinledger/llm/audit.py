"""How filters interact: every order of a set of filters, step by step.

Documents shrink to mask cells: for each part, the set of filters that they fail (a bit each), how many there are, and how
many of those are good or toxic.  A recursive query extends prefixes of filters by letters they lack, carries the bits
applied so far, joins each part's cells and emits the metrics of the step.  A prefix's metrics hold for all
orders that begin with it, so 325 prefixes for five filters give the 120 orders of five steps.
"""

from __future__ import annotations

import uuid
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, pick, prepare

LETTERS = "ABCDE"
METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def own_failures(text: Column) -> Column:
    """Bits of the filters that a text fails by itself: A, under 100 words; B, under 80 different words in 100; C, over 10
    capitals in 100 characters; D, a symbol of a set."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # the words are cut once: a lambda's argument is worked out a single time
    counts = F.get(F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d"))), F.lit(0))
    by_words = lambda c: F.when(c["n"] < 100, 1).otherwise(0) + F.when(F.lit(100) * c["d"] < F.lit(80) * c["n"], 2).otherwise(0)
    words_fail = F.get(F.transform(F.array(counts), by_words), F.lit(0))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return words_fail + F.when(F.lit(100) * capitals > F.lit(10) * F.length(text), 4).otherwise(0) + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)


def mask_cells(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """``part, mask, n, good, toxic``: a row for each part and set of failed filters.

    Bit 16, filter E: another document with a smaller id has the same text.  Texts are compared by SHA-256.  Documents shrink
    to one row for each id and text before texts meet, and to one for each text, part and label before they meet across
    the table, so a text that very many documents share doesn't gather in a task.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = pick(docs, "doc_id", "text", part).select(
        "doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), own_failures(text).cast("int").alias("own"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")
    )
    known = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    rows = rows.join(known, "doc_id", "left").withColumns({"good": F.coalesce("good", F.lit(False)), "bad": F.coalesce("bad", F.lit(False))})
    kinds = ["digest", "part", "own", "good", "bad"]
    # a text's rows with one id count as one document's; the smallest id's rows don't fail E
    by_id = rows.groupBy("doc_id", *kinds).agg(F.count("*").alias("c"))
    groups = by_id.groupBy(*kinds).agg(F.sum("c").alias("n"), F.min("doc_id").alias("least"), F.min_by("c", "doc_id").alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("c")).otherwise(0)).alias("none"))
    groups = checkpoint(groups)
    least = groups.groupBy("digest").agg(F.min("least").alias("of_all"))
    both = groups.join(least, "digest")
    passes = F.when(F.col("least") == F.col("of_all"), F.col("first")).otherwise(0) + F.col("none")
    split = F.explode(F.array(F.struct(F.col("own").alias("mask"), passes.alias("n")), F.struct((F.col("own") + 16).alias("mask"), (F.col("n") - passes).alias("n"))))
    cells = both.select("part", "good", "bad", split.alias("x")).select("part", "good", "bad", "x.*").where("n > 0")
    count = lambda on: F.sum(F.when(on, F.col("n")).otherwise(0)).alias
    return cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), count(F.col("good"))("good"), count(F.col("bad"))("toxic"))


#: The recursion.  ``cells`` holds one row a part with its cells as an array.
WALK = """
WITH RECURSIVE walk(part, prefix, applied, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
  SELECT part, '', 0, 0, 0L, 0L, 0L, 0L, 0L, 0L FROM {cells}
  UNION ALL
  SELECT part, concat(prefix, letter), applied | bit, step + 1,
         aggregate(x, 0L, (s, c) -> s + if(c.mask & (applied | bit) = 0, c.n, 0L)),
         aggregate(x, 0L, (s, c) -> s + if(c.mask & bit <> 0 AND c.mask & applied = 0, c.n, 0L)),
         aggregate(x, 0L, (s, c) -> s + if(c.mask & bit <> 0 AND c.mask & applied <> 0, c.n, 0L)),
         aggregate(x, 0L, (s, c) -> s + if(c.mask = bit, c.n, 0L)),
         aggregate(x, 0L, (s, c) -> s + if(c.mask & bit <> 0 AND c.mask & applied = 0, c.good, 0L)),
         aggregate(x, 0L, (s, c) -> s + if(c.mask & bit <> 0 AND c.mask & applied = 0, c.toxic, 0L))
  FROM (SELECT w.part, w.prefix, w.applied, w.step, c.x FROM walk w JOIN {cells} c ON w.part = c.part WHERE w.step < {n})
       LATERAL VIEW inline({letters}) l AS letter, bit
  WHERE applied & bit = 0
)
SELECT * FROM walk WHERE step > 0
"""


def interactions(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """``part, filter_order, step``, the METRICS of that step, and ``shapley``: what the step's filter removes, summed over all orders.

    ``cells`` has ``part, mask, n, good, toxic``; bit k of a mask is the k-th letter.  Parts have at most 2^n cells, so a part's
    cells travel as one array.
    """
    spark, n = cells.sparkSession, len(letters)
    packed = checkpoint(cells.groupBy("part").agg(F.collect_list(F.struct(F.col("mask").cast("int").alias("mask"), "n", "good", "toxic")).alias("x")))
    name = f"cells_{uuid.uuid4().hex}"
    packed.createOrReplaceTempView(name)
    pairs = ", ".join(f"struct('{c}', {1 << k})" for k, c in enumerate(letters))
    limits = {"spark.sql.cteRecursionLevelLimit": str(n + 2), "spark.sql.cteRecursionRowLimit": "-1"}
    before = {k: spark.conf.get(k, None) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        steps = checkpoint(spark.sql(WALK.format(cells=name, n=n, letters=f"array({pairs})")))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        spark.catalog.dropTempView(name)
    letter = F.substring("prefix", -1, 1)
    # a prefix stands for all orders that begin with it
    orders = F.element_at(F.array(*[F.lit(factorial(n - k)) for k in range(1, n + 1)]), F.col("step"))
    value = steps.groupBy("part", letter.alias("letter")).agg(F.sum(F.col("removed") * orders).alias("shapley"))
    whole = steps.where(F.col("step") == n).select("part", F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    whole = whole.withColumn("prefix", F.substring(F.col("filter_order"), F.lit(1), F.col("step")))
    out = whole.join(steps.drop("applied", "step"), ["part", "prefix"]).withColumn("letter", letter).join(value, ["part", "letter"])
    return out.select("part", "filter_order", "step", *METRICS, "shapley")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All 120 orders of the five filters for each language.

    Null text is empty: it fails A alone (and E, if an earlier empty one is there); null languages are the part ''.  A null id is
    smaller than none, and none is smaller than it, so its row never fails E.  Rows that repeat an id with the same text are
    all first or all not.  An id with several labels has all of them.  An empty table gives no rows; other columns are ignored.  Texts
    are looked at whole, whatever their length.
    """
    prepare(docs.sparkSession)
    return interactions(mask_cells(docs, labels))


#: The same result in DuckDB's SQL.
SQL = r"""
WITH RECURSIVE base AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS least FROM base GROUP BY text
), marks AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS bad FROM labels GROUP BY doc_id
), masks AS (
  SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
    (CASE WHEN len(w) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN base.doc_id > least THEN 16 ELSE 0 END) AS mask
  FROM base JOIN firsts USING (text) LEFT JOIN marks ON base.doc_id = marks.doc_id
), cells AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE bad) AS t FROM masks GROUP BY 1, 2
), letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
walk(prefix, applied, bit, step) AS (
  SELECT '', 0, 0, 0 UNION ALL
  SELECT prefix || letter, applied | l.bit, l.bit, step + 1 FROM walk JOIN letters l ON applied & l.bit = 0
), steps AS (
  SELECT part, prefix, step, right(prefix, 1) AS letter,
    CAST(coalesce(sum(n) FILTER (WHERE mask & applied = 0), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & (applied - bit) = 0), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & (applied - bit) <> 0), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(g) FILTER (WHERE mask & bit <> 0 AND mask & (applied - bit) = 0), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(t) FILTER (WHERE mask & bit <> 0 AND mask & (applied - bit) = 0), 0) AS BIGINT) AS toxic_lost
  FROM walk, cells WHERE step > 0 GROUP BY part, prefix, step
), orders AS (
  SELECT prefix AS filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM walk WHERE walk.step = 5
), every AS (
  SELECT part, filter_order, CAST(orders.step AS INTEGER) AS step, letter, kept, removed, redundant, unique_fails, good_lost, toxic_lost
  FROM orders JOIN steps ON steps.prefix = left(filter_order, orders.step)
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM every
"""
