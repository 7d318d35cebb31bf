"""Pairing of files with files, rules and dictionaries by their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import glob_pattern, is_blank
from ..sources.settle import settle
from .patterns import fitting


def stem(name: Column) -> Column:
    """A name without its extension; a dot in front begins none."""
    return F.regexp_replace(name, r"(?s)(?<=.)\.[^.]*$", "")


def pair_files(files_a: DataFrame, files_b: DataFrame, rules: DataFrame) -> DataFrame:
    """``name, path_a, path_b`` and the rule's columns for every name that both sides have and a rule's ``glob`` fits.

    Files have ``name, path``.  Names meet in an equi-join, and the rules' patterns by their index.
    """
    both = files_a.select("name", F.col("path").alias("path_a")).join(files_b.select("name", F.col("path").alias("path_b")), "name")
    return fitting(both, rules, "name", "glob")


def unpaired_files(files_a: DataFrame, files_b: DataFrame, rules: DataFrame) -> DataFrame:
    """``kind, name``: files of one side alone, paired files without a rule, and rules that paired nothing."""
    a, b = files_a.select("name").distinct(), files_b.select("name").distinct()
    both = a.join(b, "name")
    fits = settle(fitting(both, rules, "name", "glob"))
    kind = lambda d, k: d.select(F.lit(k).alias("kind"), "name")
    out = kind(a.join(b, "name", "left_anti"), "only_a").unionByName(kind(b.join(a, "name", "left_anti"), "only_b"))
    out = out.unionByName(kind(both.join(fits.select("name").distinct(), "name", "left_anti"), "no_rule"))
    idle = rules.join(fits.select("nickname", "glob").distinct(), ["nickname", "glob"], "left_anti")
    return out.unionByName(idle.select(F.lit("idle_rule").alias("kind"), F.col("nickname").alias("name")))


def pair_report_files(files_a: DataFrame, files_b: DataFrame, templates: DataFrame) -> DataFrame:
    """Report files of both sides by name, with the template of their stem: from the template folder (``rank`` 0), else
    from beside A (``rank`` 1).  Files called ``.header`` are templates, not reports."""
    report = lambda d, x: d.where(~F.col("name").endswith(".header")).select("name", F.col("path").alias(x))
    best = templates.select(stem(F.col("name")).alias("stem"), "path", "rank").groupBy("stem").agg(F.min_by("path", "rank").alias("template"))
    both = report(files_a, "path_a").join(report(files_b, "path_b"), "name").withColumn("stem", stem(F.col("name")))
    return both.join(best, "stem", "left").drop("stem")


def file_to_report(files: DataFrame, types: DataFrame, wide: bool = True) -> DataFrame:
    """``name, report_id`` of each file: by exact name, stem, pattern, the stem's pattern, ``#`` pattern, in this order;
    of equals the first in import order.

    ``types`` has ``report_id, pattern, import_order``; of a pattern's types with one order the smallest id counts.  Exact tiers are
    equi-joins; only what they leave meets patterns, each different one once.
    """
    return _by_report(_reports_found(files, types, wide))


def _by_report(found: DataFrame) -> DataFrame:
    return found.groupBy("name").agg(F.min_by("report_id", F.struct("tier", "import_order")).alias("report_id"))


def _reports_found(files: DataFrame, types: DataFrame, wide: bool = True) -> DataFrame:
    """``name, report_id, import_order`` of what each ``tier`` finds: 0 name, 1 stem, 2 pattern, 3 the stem's pattern, 4 ``#`` pattern."""
    low = files.select("name", F.lower("name").alias("__n"), F.lower(stem(F.col("name"))).alias("__s"))
    # of types with one pattern only the first can be a file's: very many may share one
    first = lambda d: d.groupBy("__p").agg(F.min(F.struct("import_order", "report_id")).alias("x")).select("__p", "x.import_order", "x.report_id")
    t = settle(first(types.select("report_id", "import_order", F.lower("pattern").alias("__p"))))
    stems = first(t.withColumn("__p", stem(F.col("__p"))))
    exact = low.join(t.hint("merge"), F.col("__n") == F.col("__p")).withColumn("tier", F.lit(0)).unionByName(low.join(stems.hint("merge"), F.col("__s") == F.col("__p")).withColumn("tier", F.lit(1)))
    found = exact
    if wide:
        rest = low.join(exact.select("name").distinct().hint("merge"), "name", "left_anti")
        loose = t.where(F.col("__p").rlike(r"[*?#]"))
        tiers = [(rest, loose, F.when(F.contains("__p", F.lit("#")), 4).otherwise(2)), (rest.withColumn("__n", F.col("__s")), first(loose.where(~F.contains("__p", F.lit("#"))).withColumn("__p", stem(F.col("__p")))), F.lit(3))]
        for names, marks, tier in tiers:
            found = found.unionByName(fitting(names, marks, "__n", "__p").withColumn("tier", tier))
    return found


def file_to_table(files: DataFrame, charset_map: DataFrame, types: DataFrame) -> DataFrame:
    """``name, table_name``: by name, stem, pattern (the name or its stem fits the table's), a word of the stem, else the file's report id;
    in each of these the table that was imported first, or the first by name if ``charset_map`` has no ``import_order``.

    Names but for report ids meet whatever their case.  A word is a run of ``A-Z``, ``a-z`` and digits.  A report is found by name, stem or
    pattern, not by a ``#`` pattern, and counts if a table has just its name.  What one step finds doesn't go to the next.
    """
    order = F.min("import_order") if "import_order" in charset_map.columns else F.lit(0)
    tables = settle(charset_map.groupBy("table_name").agg(order.alias("__o")).withColumn("__t", F.lower("table_name")))
    # of tables with one key only the first can be a file's
    first = lambda d: d.groupBy("__t").agg(F.min(F.struct("__o", "table_name")).alias("x")).select("__t", "x.*")
    keys, stems = first(tables), first(tables.withColumn("__t", stem(F.col("__t"))))
    low = settle(files.select("name", F.lower("name").alias("__n"), F.lower(stem(F.col("name"))).alias("__s")).distinct())
    meet = lambda d, on, t, k: d.join(t.hint("merge"), F.col(on) == F.col("__t")).select("name", "table_name", "__o", F.lit(k).alias("tier"))
    best = lambda d: d.groupBy("name").agg(F.min_by("table_name", F.struct("tier", "__o", "table_name")).alias("table_name"))
    left = lambda d: settle(low.join(d.select("name").hint("merge"), "name", "left_anti"))

    out = settle(best(meet(low, "__n", keys, 0).unionByName(meet(low, "__s", stems, 1))))
    rest = left(out)
    fits = meet(rest, "__s", keys, 2)
    patterns = keys.where(F.col("__t").rlike("[*?]"))
    if not patterns.isEmpty():
        either = rest.select("name", F.explode(F.array_distinct(F.array("__n", "__s"))).alias("__x"))
        loose = fitting(either, patterns, "__x", "__t").where(F.regexp_like("__x", glob_pattern(F.col("__t"), marks=False)))
        fits = fits.unionByName(loose.select("name", "table_name", "__o", F.lit(2).alias("tier")))
    words = rest.select("name", F.explode(F.array_distinct(F.split(stem(F.col("name")), r"[^A-Za-z0-9]+"))).alias("__w")).where("__w <> ''")
    out = settle(out.unionByName(best(fits.unionByName(meet(words.withColumn("__w", F.lower("__w")), "__w", keys, 3)))))
    ids = _by_report(_reports_found(left(out).select("name"), types).where("tier < 4"))
    return out.unionByName(ids.join(tables, F.col("report_id") == F.col("table_name")).select("name", "table_name"))


def file_to_dynamic_report(files: DataFrame, applicability: DataFrame, types: DataFrame) -> DataFrame:
    """``name, report_id``: as ``file_to_report``, among reports of kind ``CTS`` that have dynamic sub-fields.

    ``applicability`` has ``text_name``, ``types`` also ``kind``.
    """
    wanted = applicability.select(F.lower("text_name").alias("__t")).distinct()
    some = types.where("kind = 'CTS'").join(wanted, F.lower("report_id") == F.col("__t"), "left_semi")
    return file_to_report(files, some)


def name_columns(pairs: DataFrame, fields: DataFrame) -> DataFrame:
    """``pair_id, names``: the rule's own names, else those of the report's fields.

    ``pairs`` has ``pair_id, report_id, names`` (null or empty without own names).
    """
    listed = fields.groupBy("report_id").agg(F.map_from_entries(F.collect_list(F.struct("field_index", "field_name"))).alias("__m"))
    width = F.array_max(F.map_keys("__m"))
    from_fields = F.transform(F.sequence(F.lit(1), width), lambda i: F.coalesce(F.try_element_at("__m", i), F.lit("")))
    out = pairs.join(listed, "report_id", "left")
    return out.select("pair_id", F.when(F.size("names") > 0, F.col("names")).otherwise(from_fields).alias("names"))


def owner_group(names: DataFrame, types: DataFrame) -> DataFrame:
    """``nickname, team``: the group that owns the report, else the name itself."""
    owned = types.where(~is_blank(F.coalesce("ownership_group", F.lit("")))).groupBy(F.lower("report_id").alias("__id")).agg(F.min_by("ownership_group", "import_order").alias("__g"))
    return names.select("nickname").distinct().join(owned, F.lower("nickname") == F.col("__id"), "left").select("nickname", F.coalesce("__g", "nickname").alias("team"))


def dynamic_columns_for(applicability: DataFrame, names: DataFrame) -> DataFrame:
    """``pair_id, dyn_name, col`` of columns with dynamic sub-fields, found by name, else by number from 1; ``col`` is null, with
    ``warning``, if neither fits.  ``applicability`` has ``pair_id, col_ref, dyn_name``, ``names`` ``pair_id, names``."""
    both = applicability.join(names, "pair_id", "left")
    by_name = F.nullif(F.array_position(F.transform("names", F.lower), F.lower(F.trim("col_ref"))), F.lit(0)) - 1
    by_number = F.trim("col_ref").try_cast("int") - 1
    col = F.coalesce(by_name.cast("int"), F.when(by_number >= 0, by_number))
    out = both.select("pair_id", "dyn_name", "col_ref", col.alias("col"))
    return out.withColumn("warning", F.when(F.col("col").isNull(), F.concat(F.lit("no column "), "col_ref")))
