"""URL filter: a blocked Bloom filter passes possible hits to an exact hash join.

A list entry is a canonical URL prefix: a host, which stands for itself and all its
subdomains, and the beginning of a path.  A URL is probed with each of its host suffixes
and path beginnings that have a length found in the list.  The Bloom filter, whose size
is fixed by a parameter, throws out almost all probes where the pages lie: a page without a
possible hit is judged without leaving its task.  The other pages' URLs meet the list in an exact
join, so false positives never show in the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, add_columns, fresh, packed, pick, prepare

BITS_PER_KEY = 6
_STEP = 0x9E3779B97F4A7C15


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased; then the
    path up to ``?`` or ``#``.  Both empty if the url is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def _places(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and a row of bit positions (0 to 511) inside the block."""
    h = h.astype(np.uint64)
    block = (h >> np.uint64(32)) % np.uint64(blocks)
    mixed = h * np.uint64(_STEP)
    bits = np.stack([(mixed >> np.uint64(9 * i)) & np.uint64(511) for i in range(BITS_PER_KEY)], axis=1)
    return block.astype(np.int64), bits.astype(np.int64)


def bloom(keys: DataFrame, blocks: int) -> np.ndarray:
    """The filter over column ``h``: ``blocks`` blocks of 512 bits as rows of 8 words.

    Partitions set bits on their own, then words are joined by bitwise or in Spark.  At most
    ``8 * blocks`` words come to the driver, however long the list is.
    """

    def words(batches):
        for batch in batches:
            block, bits = _places(batch.column(0).to_numpy(zero_copy_only=False), blocks)
            word = (block[:, None] * 8 + (bits >> 6)).ravel()
            mask = (np.uint64(1) << (bits & 63).astype(np.uint64)).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask)], names=["word", "mask"])

    rows = keys.select("h").mapInArrow(words, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    out = np.zeros(8 * blocks, dtype=np.uint64)
    out[rows["word"].to_numpy(dtype=np.int64)] = rows["mask"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, blocks: int | None = None, url: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``.

    ``rules`` has ``rule_host, rule_path, verdict`` (allow or block), ``listed`` has
    ``rule_host, rule_path`` of blocked entries.  A rule fits its host and all subdomains if the
    path starts with the rule's; the longest rule wins, of equally long ones that with
    the longer host, then a block.  Without a rule, a URL that fits a listed entry is
    blocked and any other allowed; ``rule`` is then null.  Null or unreadable URLs have
    an empty host and path and fit nothing.  Of a rule given twice with different verdicts, block wins.  Repeated pages and rules change nothing; input columns
    named like an output are replaced.  ``blocks`` fixes the filter's size at 64 bytes each; by default
    it follows the list: 16 bits an entry, from 256 KB to 32 MB.  An empty table gives no rows; a url is looked at whole.
    """
    prepare(pages.sparkSession)
    host, path = host_and_path(F.col(f"row.`{url}`"))
    names = fresh(pages, "host", "path", "rule", "verdict").columns
    rows = packed(pages).withColumns({"host": host, "path": path})
    entries = (
        pick(rules, "rule_host", "rule_path", "verdict").withColumn("ruled", F.lit(True))
        .unionByName(pick(listed, "rule_host", "rule_path").withColumns({"verdict": F.lit("block"), "ruled": F.lit(False)}))
        .where(F.col("rule_host").isNotNull() & F.col("rule_path").isNotNull())
        .groupBy("rule_host", "rule_path", "ruled").agg(F.max("verdict").alias("verdict"))
    )
    keyed = entries.withColumn("h", F.xxhash64("rule_host", "rule_path"))
    blocks = blocks or min(1 << 19, max(4096, -(-keyed.count() // 32)))
    filter_words = bloom(keyed, blocks)
    labels = F.size(F.split("rule_host", r"\.")).alias("labels")
    shapes = entries.select(labels, F.length("rule_path").alias("length")).agg(F.sort_array(F.collect_set("labels")), F.sort_array(F.collect_set("length"))).first()
    longs = lambda x: F.array(*[F.lit(n) for n in x]).cast("array<int>")
    parts = F.split("host", r"\.")
    hosts = F.transform(F.filter(longs(shapes[0]), lambda k: k <= F.size(parts)), lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."))
    paths = F.transform(F.filter(longs(shapes[1]), lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    probes = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.struct(h.alias("rule_host"), p.alias("rule_path")))))
    rows = rows.withColumn("probes", F.when(F.col("host") != "", probes))

    def make():
        def maybe(batch: pa.RecordBatch) -> list[pa.Array]:
            """Places of the probes that the filter lets pass."""
            hashes = batch.column(batch.schema.get_field_index("hashes"))
            cuts = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(hashes), 0).to_numpy())))
            block, bits = _places(hashes.flatten().to_numpy(), blocks)
            words = filter_words[block[:, None] * 8 + (bits >> 6)]
            hit = np.flatnonzero(((words >> (bits & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1))
            owner = np.searchsorted(cuts, hit, "right") - 1
            ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(hashes)))))
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hit - cuts[owner], pa.int32()))]

        return maybe

    # pages without a possible hit are judged where they lie; only the others' urls meet the list
    hashed = rows.withColumn("hashes", F.transform("probes", lambda p: F.xxhash64(p["rule_host"], p["rule_path"])))
    tested = add_columns(hashed, [T.StructField("hits", T.ArrayType(T.IntegerType()))], make)
    clear = tested.where(F.size("hits") == 0).select("row", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    hits = tested.where(F.size("hits") > 0).select("row", "host", "path", F.transform("hits", lambda i: F.get("probes", i)).alias("probes"))
    tried = hits.select("host", "path", "probes").dropDuplicates(["host", "path"]).select("host", "path", F.explode("probes").alias("probe")).select("host", "path", "probe.*")
    best = F.struct("ruled", (F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("m"), "verdict", "rule_host", "rule_path")
    found = tried.join(entries, ["rule_host", "rule_path"]).groupBy("host", "path").agg(F.max(best).alias("best"))
    rule = F.when(F.col("best.ruled"), F.concat("best.rule_host", "best.rule_path"))
    sure = hits.join(found, ["host", "path"], "left").select("row", "host", "path", rule.alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
    return clear.unionByName(sure).select(*[F.col(f"row.`{c}`") for c in names], "host", "path", "rule", "verdict")


#: The rules of the registered query (host, path, verdict) and its list of blocked sites.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
LISTED = [("cheap-pills.example.com", "/"), ("spam-farm.example.org", "/")]

#: The registered query in DuckDB's SQL.
SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), rules(rule_host, rule_path, verdict, ruled) AS (
  VALUES {", ".join(f"('{h}', '{p}', '{v}', true)" for h, p, v in RULES)}, {", ".join(f"('{h}', '{p}', 'block', false)" for h, p in LISTED)}
), keys AS (SELECT DISTINCT host, path FROM parts), fits AS (
  SELECT host, path, rule_host || rule_path AS rule, verdict, ruled,
    row_number() OVER (PARTITION BY host, path ORDER BY ruled DESC, length(rule_host || rule_path) DESC, length(rule_host) DESC) AS n
  FROM keys JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, CASE WHEN ruled THEN rule END AS rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE n = 1) USING (host, path)
"""
