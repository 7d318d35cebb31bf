"""Fixed-layout reports: cut into header blocks, rows and footer blocks, and compared.

Lines are ``pair_id, seq, value`` with ``seq`` from 0.  Scans return rows ``pair_id, section, line_no, raw, fields, sort_key, display``
(``line_no`` from 1, ``display`` the physical lines of a folded record), blocks ``pair_id, section, kind, signature, lines``, and
warnings ``pair_id, section, warning``.  Where a block may be too long for a row, ``report_template_lines`` and ``report_control_lines``
leave its lines in rows of their own.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import last_before, nth_occurrence, ordered_print, running_sum
from ..functions.strings import UNIT, diff_columns, is_blank, pipe_label_like, quoted, strip
from ..sources.settle import settle
from .segments import lines_apart

# The marks of self-describing reports.
CONTROL = r"^\s*[0-9]+@OD@\|"
BRANCH = r"^\s{0,4}(?:BRCH|BRANCH|Branch)\s*:"
LABEL = r"^\s*[A-Za-z][^|:]{0,30}:\s"
PAGE_MARK = r"^\s*[0-9]{1,3}\s*(\(.*?\))?\s*$"
COLUMN_NAME = r"^\s*[A-Za-z][^\s0-9|]*(\s[^|]*)?$"
RULE_LINE = r"^\s*[-=+_][-=+_ ]{4,}[-=+_]\s*$"
MAIN_LINE = r"^\s*[^\s0-9]*[0-9]"
MASKED = r"^\s*\*+(\s|$)"
COUNT_LABEL = r"(?is)(?:TOTAL[-_]?COUNT|COUNT)\s*[:=]?.{0,79}?([0-9][0-9,]*)"
QUANTITY_LABEL = r"(?i)(?:PG[ _-]?QTY|QUANTITY|QTY)\s*[:=]?[^\n]*?([0-9][0-9,]*)"


def split_report_fields(raw: Column) -> Column:
    """Fields of a line: at pipes, each stripped and one blank end dropped; without pipes at two spaces or more."""
    parts = F.split(raw, r"\|", -1)
    cut = F.when(strip(raw).endswith("|") & is_blank(F.try_element_at(parts, F.lit(-1))), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.when(F.contains(raw, F.lit("|")), F.transform(cut, strip)).otherwise(F.split(strip(raw), r"\s{2,}"))


def is_main_line(line: Column) -> Column:
    """Whether a line begins a record: its first word has a digit, or it is masked by stars and has no word."""
    return F.when(line.rlike(MASKED), ~line.rlike("[A-Za-z]{3}")).otherwise(line.rlike(MAIN_LINE))


def report_format(pairs: DataFrame, templates: DataFrame, lines_a: DataFrame, lines_b: DataFrame) -> DataFrame:
    """``pair_id, format, error``: how the reports of each pair are to be cut.

    ``zoned`` if the pair's template has five blank lines or more in a row with skeleton behind them, else ``control`` if a line of
    either side is a control line, else ``template`` if there is one; without, the format is null and ``error`` says so.
    ``pairs`` has ``pair_id``, the others ``pair_id, seq, value``.  Only templates, which are a page or two, are put together.
    """
    skeleton = templates.groupBy("pair_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: F.when(is_blank(x["value"]), "").otherwise("x")), "\n").alias("t"))
    marks = lines_a.select("pair_id", "value").unionByName(lines_b.select("pair_id", "value")).groupBy("pair_id").agg(F.max(F.col("value").rlike(CONTROL)).alias("marked"))
    both = pairs.select("pair_id").distinct().join(skeleton, "pair_id", "left").join(marks, "pair_id", "left")
    # five blank lines are five line feeds at the beginning, six behind a line
    kind = F.when(F.col("t").rlike("(^\n{5}|\n{6})\n*x"), "zoned").when(F.col("marked"), "control").when(F.col("t").isNotNull(), "template")
    return both.select("pair_id", kind.alias("format"), F.when(kind.isNull(), "no template").alias("error"))


def filled_like_regex(template: str) -> str:
    """A pattern for lines that have the template's words in order among theirs; words of three characters or more may go on."""
    words = template.split()
    if not words:
        return r"^\s*$"
    return r"^\s*(?:\S+\s+)*?" + r"\s+(?:\S+\s+)*?".join(quoted(w) + (r"\S*" if len(w) >= 3 else "") for w in words) + r"(?:\s.*)?$"


def _fits(line: Column, template: str, labels: bool = False) -> Column:
    if not template.strip():
        return is_blank(line)
    ok = (line == template) | line.rlike(filled_like_regex(template))
    return ok | (pipe_label_like(line, F.lit(template)) if labels and "|" in template else F.lit(False))


def section_label(signature: Column) -> Column:
    """Short name of a section: its PRODUCT, else ORG-ID, else RPT-ID, else the beginning of the line."""
    tag = lambda t: F.nullif(F.regexp_extract(signature, rf"\|{t}:([^|]*)", 1), F.lit(""))
    return F.coalesce(*[F.when(~is_blank(tag(t)), tag(t)) for t in ("PRODUCT", "ORG-ID", "RPT-ID")], F.substring(strip(signature), 1, 24))


def _rows(lines: DataFrame) -> DataFrame:
    fields = split_report_fields(F.col("value"))
    out = lines.where(~is_blank(F.col("value"))).select("pair_id", F.col("section").cast("int").alias("section"), (F.col("seq") + 1).alias("line_no"), F.col("value").alias("raw"), fields.alias("fields"))
    return out.withColumns({"sort_key": F.array_join("fields", UNIT), "display": F.lit(None).cast("array<string>")})


def blank_run(template: list[str], least: int = 5) -> tuple[int, int] | None:
    """The first run of blank lines that has ``least`` or more and more template behind it."""
    start = None
    for i, line in enumerate(template):
        if line.strip():
            if start is not None and i - start >= least:
                return start, i
            start = None
        elif start is None:
            start = i
    return None


def blocks_apart(found: DataFrame) -> DataFrame:
    """The blocks that stay of ``pair_id, p, h``, each of the ``h`` lines that end at ``p``: in order, one that overlaps the last that stays goes.

    Where a block is clear of the one before it, the choice begins anew, so only runs of overlapping blocks need it.  In a run each
    block points at the first behind it that is clear of it, and the blocks that are reached from the run's first one stay.  They are
    found by doubling the pointers: as many rounds as the logarithm of the longest run, and nothing of a report in one row.
    """
    before = last_before(found.withColumn("q", F.col("p")), ["pair_id"], "p", F.col("q"), "prev").drop("q")
    marked = running_sum(before, ["pair_id"], "p", F.when(F.coalesce(F.col("p") - F.col("h") >= F.col("prev"), F.lit(True)), 1).otherwise(0), "run")
    marked = settle(marked)
    first = F.coalesce(F.col("p") - F.col("h") >= F.col("prev"), F.lit(True))
    close = marked.where(~first).select("pair_id", "run").distinct()
    reached = marked.where(first).select("pair_id", "p", "h")
    if close.isEmpty():
        return reached
    some = settle(marked.join(close, ["pair_id", "run"], "left_semi").select("pair_id", "run", "p", "h"))
    # the first block at or behind p + h: places run backwards, and a block stands before the question at its place
    blocks = some.select("pair_id", "run", "p", (-(F.col("p") * 2 + 1)).alias("at"), F.struct("run", "p").alias("block"))
    asked = some.select("pair_id", "run", "p", (-((F.col("p") + F.col("h")) * 2)).alias("at"), F.lit(None).cast(blocks.schema["block"].dataType).alias("block"))
    seen = last_before(blocks.unionByName(asked), ["pair_id"], "at", F.col("block"), "next").where("block is null and next.run = run")
    jump = settle(seen.select("pair_id", "p", F.col("next.p").alias("to")))
    on = settle(some.join(marked.where(first).select("pair_id", "p"), ["pair_id", "p"], "left_semi").select("pair_id", "p"))
    while not jump.isEmpty():
        on = settle(on.unionByName(on.join(jump, ["pair_id", "p"]).select("pair_id", F.col("to").alias("p"))).distinct())
        further = jump.select("pair_id", F.col("p").alias("to"), F.col("to").alias("then"))
        jump = settle(jump.join(further, ["pair_id", "to"]).select("pair_id", "p", F.col("then").alias("to")))
    return reached.unionByName(some.join(on, ["pair_id", "p"], "left_semi").select("pair_id", "p", "h")).distinct()


_BLOCK = ["pair_id", "section", "kind"]


def _held(lines: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """Blocks with their lines in one row; those of ``every`` (``pair_id, section, kind, signature``) come without lines too."""
    own = lines.groupBy(*_BLOCK).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("lines"))
    if every is None:
        return own.select(*_BLOCK, F.lit(None).cast("string").alias("signature"), "lines")
    return every.join(own, _BLOCK, "left").select(*_BLOCK, "signature", F.coalesce("lines", F.array().cast("array<string>")).alias("lines"))


def _printed(lines: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """Blocks with the number of their lines and a fingerprint of these, ``n_lines, print``."""
    own = lines.groupBy(*_BLOCK).agg(F.count("*").alias("n_lines"), ordered_print(F.col("pos"), F.col("value")).alias("print"))
    if every is None:
        return own.select(*_BLOCK, F.lit(None).cast("string").alias("signature"), "n_lines", "print")
    return every.join(own, _BLOCK, "left").select(*_BLOCK, "signature", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "print")


def scan_report_template(lines: DataFrame, template: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reports cut by a template, each block with its lines in one row; see ``report_template_lines`` for how they are cut."""
    rows, block_lines, warnings = _cut_by_template(lines, template)
    return rows, _held(block_lines), warnings


def report_template_lines(lines: DataFrame, template: list[str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Reports cut by a template: rows, blocks ``pair_id, section, kind, signature, n_lines, print``, their lines ``pair_id, section,
    kind, pos, value`` (``pos`` from 0) and warnings.  No row holds a block.

    A template with five or more blank lines inside has the header before and the footer behind them.  Otherwise the header ends with
    the last line that is the same in both at the same place and has a blank or the end behind it in the template.  Lines equal to the header's last
    one end header blocks; without any, blocks are looked for by the whole skeleton.  At a section's end the footer's lines are
    taken off if they fit, with as many blank lines before as the template has.
    """
    rows, block_lines, warnings = _cut_by_template(lines, template)
    block_lines = settle(block_lines)
    return rows, _printed(block_lines), block_lines, warnings


def _cut_by_template(lines: DataFrame, template: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, lines of blocks and warnings."""
    size = len(template)
    texts = F.array(*map(F.lit, template)).cast("array<string>") if template else F.array().cast("array<string>")
    run = blank_run(template)
    pairs = lines.select("pair_id").distinct()
    if run:
        heads = pairs.withColumn("h", F.lit(run[0]))
        zone = template[run[1] :]
        while zone and not zone[-1].strip():
            zone = zone[:-1]
        zones = {run[0]: zone}
    else:
        ends = [i for i, t in enumerate(template) if t.strip() and (i + 1 >= size or not template[i + 1].strip())]
        same = lines.where((F.col("seq") < size) & F.col("seq").isin(*ends or [-1]) & (F.col("value") == F.get(texts, F.col("seq").cast("int"))))
        heads = pairs.join(same.groupBy("pair_id").agg((F.max("seq") + 1).cast("int").alias("h")), "pair_id", "left").fillna(0, ["h"])
        zones = {i + 1: template[i + 1 + (i + 1 < size and not template[i + 1].strip()) :] for i in ends}
    # footers by header length: blank lines before, then the core
    feet = {}
    for h, z in zones.items():
        lead = next((i for i, t in enumerate(z) if t.strip()), len(z))
        core = z[lead:]
        while core and not core[-1].strip():
            core = core[:-1]
        feet[h] = (lead, core)

    def by_head(make, other: Column) -> Column:
        out = other
        for h in feet:
            out = F.when(F.col("h") == h, make(h)).otherwise(out)
        return out

    lines = settle(lines.join(heads, "pair_id"))
    anchor = (F.col("h") > 0) & (F.col("seq") >= F.col("h") - 1) & (F.col("value") == F.get(texts, F.col("h") - 1))
    exact = lines.where(anchor).select("pair_id", F.col("seq").alias("p"))
    # whole skeletons where no line is the anchor: each line of a block fits the template's line at its place
    hint = F.transform(F.sequence(F.lit(0), F.greatest(F.col("h") - 1, F.lit(0))), lambda j: F.col("seq") - j)
    fits = F.array(*[_fits(F.col("value"), t, True) for t in template]) if template else F.array().cast("array<boolean>")
    loose = lines.where("h > 0").join(exact.select("pair_id").distinct(), "pair_id", "left_anti")
    placed = loose.withColumn("start", F.explode(hint)).where(F.get(fits, (F.col("seq") - F.col("start")).cast("int")))
    whole = placed.groupBy("pair_id", "start", "h").agg(F.count("*").alias("n")).where("n = h and start >= 0").select("pair_id", (F.col("start") + F.col("h") - 1).alias("p"))
    found = settle(exact.unionByName(whole).distinct().join(heads, "pair_id"))
    kept = blocks_apart(found)
    starts = kept.select("pair_id", (F.col("p") - F.col("h") + 1).alias("seq"), F.lit(1).alias("opens"))
    lines = running_sum(lines.join(starts, ["pair_id", "seq"], "left"), ["pair_id"], "seq", F.coalesce("opens", F.lit(0)), "section")
    lines = settle(lines.withColumn("section", F.col("section") - 1))
    first = lines.where("section >= 0").groupBy("pair_id", "section").agg(F.min("seq").alias("block_start"), F.max(F.when(~is_blank(F.col("value")), F.col("seq"))).alias("end"))
    lines = lines.join(first, ["pair_id", "section"], "left").withColumn("region", F.col("block_start") + F.col("h"))
    header = lines.where("seq < region")
    body = settle(lines.where((F.col("seq") >= F.col("region")) & (F.col("seq") <= F.col("end"))))
    # the footer's core against the last lines of each section
    k = by_head(lambda h: F.lit(len(feet[h][1])), F.lit(0))
    lead = by_head(lambda h: F.lit(feet[h][0]), F.lit(0))
    at = F.col("seq") - (F.col("end") - k) - 1
    ok = by_head(lambda h: F.get(F.array(*[_fits(F.col("value"), t) for t in feet[h][1]]), at.cast("int")) if feet[h][1] else F.lit(False), F.lit(False))
    core = body.where(at.between(0, k - 1)).groupBy("pair_id", "section", "end", F.col("region").alias("r")).agg(F.count_if(ok).alias("n"), F.max(k).alias("k"), F.max(lead).alias("lead"))
    core = core.where("n = k and k > 0").select("pair_id", "section", (F.col("end") - F.col("k") + 1).alias("core_start"), "lead")
    body = settle(body.join(core, ["pair_id", "section"], "left"))
    above = body.where((F.col("seq") < F.col("core_start")) & (F.col("seq") >= F.col("core_start") - F.col("lead")))
    blanks = above.groupBy("pair_id", "section").agg(F.max(F.when(~is_blank(F.col("value")), F.col("seq"))).alias("text"), F.min("seq").alias("low"))
    blanks = blanks.select("pair_id", "section", F.coalesce(F.col("text") + 1, F.col("low")).alias("foot"))
    body = body.join(blanks, ["pair_id", "section"], "left").withColumn("foot", F.coalesce("foot", "core_start"))
    in_foot = F.coalesce(F.col("seq") >= F.col("foot"), F.lit(False))
    placed = lambda d, kind, begin: d.select("pair_id", F.col("section").cast("int").alias("section"), F.lit(kind).alias("kind"), (F.col("seq") - F.col(begin)).alias("pos"), "value")
    block_lines = placed(header, "header", "block_start").unionByName(placed(body.where(in_foot), "footer", "foot"))
    cols = ["pair_id", "section", "seq", "value"]
    stray = lines.where("section < 0").withColumn("section", F.lit(0).cast("long"))
    rows = _rows(body.where(~in_foot).select(cols).unionByName(stray.select(cols)))
    warn = lambda d, text: d.select("pair_id", F.lit(0).alias("section"), F.lit(text).alias("warning"))
    warnings = warn(heads.where("h = 0"), "no header line of the template is in the report: all lines are rows")
    warnings = warnings.unionByName(warn(heads.where("h > 0").join(found.select("pair_id").distinct(), "pair_id", "left_anti"), "no section found: all lines are rows"))
    left_out = found.join(kept.select("pair_id", "p"), ["pair_id", "p"], "left_anti").select("pair_id").distinct()
    warnings = warnings.unionByName(warn(left_out, "overlapping header blocks left out"))
    return rows, block_lines, warnings


def scan_report_control(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Self-describing reports, each block with its lines in one row; see ``report_control_lines`` for how they are cut."""
    rows, block_lines, every, warnings = _cut_by_control(lines)
    return rows, _held(block_lines, every), warnings


def report_control_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Self-describing reports: rows, blocks, their lines and warnings, as ``report_template_lines``.  Control lines open sections.

    In a section the branch line is among the first 15; behind it come up to five blank or label lines, then up to eight lines of column
    names: as many lines has a record.  The first column line again begins a page, and what looks like a page's head before it is left out.
    Records go on as long as their first line is one of data; what is left is footer, however much that is.  A section without a
    footer has one of no lines.
    """
    rows, block_lines, every, warnings = _cut_by_control(lines)
    block_lines = settle(block_lines)
    return rows, _printed(block_lines, every), block_lines, warnings


def _cut_by_control(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows, lines of blocks, all blocks with their signatures, and warnings."""
    rows = running_sum(lines, ["pair_id"], "seq", F.col("value").rlike(CONTROL).cast("int"), "section").where("section > 0").withColumn("section", F.col("section") - 1)
    rows = settle(rows)
    by = ["pair_id", "section"]
    heads = rows.groupBy(by).agg(F.min("seq").alias("from"), F.count("*").alias("len"), F.min_by("value", "seq").alias("signature"), (F.max(F.when(~is_blank(F.col("value")), F.col("seq"))) + 1).alias("text_end"))
    heads = settle(heads)
    rows = rows.join(heads, by).withColumn("pos", (F.col("seq") - F.col("from")).cast("int"))
    mark = F.struct("pos", "value", F.col("value").rlike(BRANCH).alias("br"), (is_blank(F.col("value")) | F.col("value").rlike(LABEL)).alias("skip"), F.col("value").rlike(COLUMN_NAME).alias("name"), F.col("value").rlike(RULE_LINE).alias("rule"))
    top = rows.where("pos < 32").groupBy(by).agg(F.array_sort(F.collect_list(mark)).alias("x"))
    run = lambda start, most, flag: F.aggregate(F.slice("x", start + 1, most), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct((a["n"] + (a["on"] & x[flag]).cast("int")).alias("n"), (a["on"] & x[flag]).alias("on")))["n"]
    top = top.withColumn("anchor", F.array_position(F.transform(F.slice("x", 1, 15), lambda x: x["br"]), True).cast("int") - 1)
    top = top.withColumn("first", F.when(F.col("anchor") >= 0, F.col("anchor") + 1 + run(F.col("anchor") + 1, 5, "skip")))
    top = top.withColumn("first", F.when(F.coalesce(F.get("x", "first")["name"], F.lit(False)), F.col("first")))
    top = top.withColumn("fold", run(F.col("first"), 8, "name"))
    top = top.withColumn("body", F.col("first") + F.col("fold") + F.coalesce(F.get("x", F.col("first") + F.col("fold"))["rule"], F.lit(False)).cast("int"))
    top = top.select(*by, "first", "fold", "body", F.get("x", "first")["value"].alias("head"), F.transform(F.filter("x", lambda x: (x["pos"] > 0) & (x["pos"] < F.col("first"))), lambda x: x["value"]).alias("preamble"))
    rows = settle(rows.join(top, by))

    plain = rows.where("first is null")
    folded = rows.where("first is not null").withColumn("content", F.greatest("body", (F.col("text_end") - F.col("from")).cast("int")))
    opens = (F.col("pos") == F.col("first")) | ((F.col("pos") >= F.col("body")) & (F.col("value") == F.col("head")))
    folded = running_sum(folded, by, "seq", opens.cast("int"), "page")
    page = [*by, "page"]
    folded = settle(folded)
    pages = folded.where("page > 0").groupBy(page).agg(F.min("pos").alias("c"), F.max("pos").alias("stop"), F.max("fold").alias("__f"), F.max(F.when(F.col("value").rlike(RULE_LINE), F.col("pos"))).alias("__r"))
    after = folded.join(pages.select(*page, "c", "__f"), page).where(F.col("pos") == F.col("c") + F.col("__f")).select(*page, F.col("value").rlike(RULE_LINE).cast("int").alias("ruled"))
    last = pages.groupBy(by).agg(F.max("page").alias("pages"))
    pages = pages.join(after, page, "left").join(last, by).select(*page, "pages", (F.col("c") + F.col("__f") + F.coalesce("ruled", F.lit(0))).alias("start"), (F.col("stop") + 1).alias("stop"))
    pages = settle(pages)
    folded = settle(folded.join(pages, page, "left"))
    # what stands like a page's head before the next page, ten lines at most
    like = is_blank(F.col("value")) | F.col("value").rlike(PAGE_MARK) | F.col("value").rlike(BRANCH) | F.array_contains("preamble", F.col("value"))
    tail = folded.where((F.col("page") < F.col("pages")) & (F.col("pos") >= F.col("stop") - 10) & (F.col("pos") > F.col("start")))
    tail = tail.groupBy(page).agg(F.max("stop").alias("s"), F.max(F.when(~like, F.col("pos"))).alias("text"), F.min("pos").alias("low")).select(*page, F.coalesce(F.col("text") + 1, F.col("low")).alias("pre"))
    folded = folded.join(tail, page, "left").withColumn("pre", F.when(F.col("page") < F.col("pages"), F.coalesce("pre", "stop")).otherwise(F.least("content", "stop")))
    # records of a page: whole ones up to the first that isn't data or doesn't fit
    inner = folded.where((F.col("page") > 0) & (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("pre"))).withColumn("rec", F.floor((F.col("pos") - F.col("start")) / F.col("fold")))
    lead = (F.col("pos") - F.col("start")) % F.col("fold") == 0
    past = F.col("start") + (F.col("rec") + 1) * F.col("fold") > F.col("pre")
    inner = settle(inner)
    stops = inner.where(lead & (~is_main_line(F.col("value")) | past)).groupBy(page).agg(F.min("rec").alias("halt"), F.min_by(is_main_line(F.col("value")), "rec").alias("broken"))
    inner = settle(inner.join(stops, page, "left").withColumn("in_rec", F.coalesce(F.col("rec") < F.col("halt"), F.lit(True))))
    records = inner.where("in_rec").groupBy(*page, "rec").agg(F.min("seq").alias("seq"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]).alias("display"))
    fields = F.filter(F.flatten(F.transform("display", split_report_fields)), lambda v: v != "")
    out = records.select("pair_id", F.col("section").cast("int").alias("section"), (F.col("seq") + 1).alias("line_no"), F.array_join("display", "\n").alias("raw"), fields.alias("fields"), "display")
    out = out.select("pair_id", "section", "line_no", "raw", "fields", F.array_join("fields", UNIT).alias("sort_key"), "display")
    out = out.unionByName(_rows(plain.where("pos > 0")))

    foot = inner.where(~F.col("in_rec") & ((F.col("page") == F.col("pages")) | ~is_blank(F.col("value"))))
    foot = nth_occurrence(foot.select(*by, "seq", "value"), by, "seq", "pos")
    placed = lambda d, kind: d.select("pair_id", F.col("section").cast("int").alias("section"), F.lit(kind).alias("kind"), F.col("pos").cast("long").alias("pos"), "value")
    block_lines = placed(folded.where("pos < body"), "header").unionByName(placed(plain.where("pos = 0"), "header")).unionByName(placed(foot, "footer"))
    every = heads.select("pair_id", F.col("section").cast("int").alias("section"), F.explode(F.array(F.lit("header"), F.lit("footer"))).alias("kind"), "signature")
    warn = lambda d, text: d.select("pair_id", F.col("section").cast("int").alias("section"), F.lit(text).alias("warning")).distinct()
    warnings = warn(plain, "no column names found: all lines are rows").unionByName(warn(pages.where("pages > 1"), "several pages: repeated heads left out")).unionByName(warn(stops.where("broken"), "incomplete folded record: the rest is footer"))
    return out, block_lines, every, warnings


def report_column_names(blocks: DataFrame) -> DataFrame:
    """``pair_id, pos, name`` from the first section's header block: names are two spaces or more apart, those of further lines are
    marked by their line."""
    first = blocks.where("kind = 'header' and section = 0")
    lines = first.select("pair_id", F.posexplode("lines").alias("i", "value"))
    at = lines.where(F.col("value").rlike(BRANCH)).groupBy("pair_id").agg(F.min("i").alias("anchor"))
    named = lines.join(at, "pair_id").where((F.col("i") > F.col("anchor")) & F.col("value").rlike(COLUMN_NAME) & ~F.col("value").rlike(LABEL))
    base = named.groupBy("pair_id").agg(F.min("i").alias("low"))
    named = named.join(base, "pair_id").withColumn("k", F.col("i") - F.col("low") + 1)
    words = named.select("pair_id", "k", F.posexplode(F.split(strip(F.col("value")), r"\s{2,}")).alias("j", "name"))
    from pyspark.sql import Window

    name = F.when(F.col("k") >= 2, F.concat(F.lit("行"), F.col("k").cast("string"), F.lit("·"), F.col("name"))).otherwise(F.col("name"))
    return words.select("pair_id", (F.row_number().over(Window.partitionBy("pair_id").orderBy("k", "j")) - 1).alias("pos"), name.alias("name"))


# ---- comparison ----


def _blocks(rows: DataFrame, key: Column) -> DataFrame:
    two = F.col("a").isNotNull() & F.col("b").isNotNull()
    diff = F.when(two, diff_columns(F.col("a"), F.col("b"), missing=None)).otherwise(F.array().cast("array<int>"))
    status = F.when(F.col("a").isNull(), "unmatched_b").when(F.col("b").isNull(), "unmatched_a").when(F.size("diff_cols") > 0, "diff").otherwise("equal")
    return rows.withColumn("diff_cols", diff).select("pair_id", key.alias("key"), status.alias("status"), F.col("kind").alias("section"), F.col("a").alias("a_cols"), F.col("b").alias("b_cols"), "diff_cols")


def block_compare_positional(a: DataFrame, b: DataFrame) -> DataFrame:
    """Result rows of header and footer blocks, the n-th of A with the n-th of B."""
    side = lambda d, x: nth_occurrence(d.select("pair_id", "kind", "section", F.col("lines").alias(x)), ["pair_id", "kind"], "section").drop("section")
    key = F.concat(F.when(F.col("kind") == "header", "H").otherwise("T"), (F.col("nth") + 1).cast("string"))
    return _blocks(side(a, "a").join(side(b, "b"), ["pair_id", "kind", "nth"], "full"), key)


def block_compare_signature(a: DataFrame, b: DataFrame) -> DataFrame:
    """Result rows of blocks by their control lines: each of A with B's first of the same line; those of B left over are labelled ``B``."""
    left = a.select("pair_id", "kind", "signature", F.col("section").alias("sa"), F.col("lines").alias("a"))
    right = b.select("pair_id", "kind", "signature", F.col("section").alias("sb"), F.col("lines").alias("b"))
    first = right.groupBy("pair_id", "kind", "signature").agg(F.min_by(F.struct("b", "sb"), "sb").alias("x")).select("pair_id", "kind", "signature", "x.*")
    met = left.join(first, ["pair_id", "kind", "signature"], "left")
    used = met.where("sb is not null").select("pair_id", "kind", "sb").distinct()
    rest = right.join(used, ["pair_id", "kind", "sb"], "left_anti")
    label = lambda s, end: F.concat(section_label(F.col("signature")), F.lit("·"), (F.col(s) + 1).cast("string"), F.lit(end))
    return _blocks(met, label("sa", "")).unionByName(_blocks(rest.withColumn("a", F.lit(None).cast("array<string>")), label("sb", "B")))


def compare_block_lines(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame], by_signature: bool = False) -> tuple[DataFrame, DataFrame]:
    """Blocks of both sides, each side as blocks and lines of ``report_template_lines`` or ``report_control_lines``, without holding any.

    Blocks meet as in ``block_compare_positional``, or ``by_signature`` as in ``block_compare_signature``, and are compared by their
    fingerprints; only those that differ meet line by line.  Returns ``pair_id, key, section, status, n_a, n_b, n_diff`` and, for
    each differing line and each line of a block of one side, ``pair_id, key, section, status, line_no, a, b``; ``section`` is header or
    footer, ``line_no`` counts from 1, and what a side lacks is null.
    """
    side = lambda blocks, x: blocks.select("pair_id", "kind", "signature", F.col("section").alias(f"section_{x}"), F.col("n_lines").alias(f"n_{x}"), F.col("print").alias(f"print_{x}"))
    left, right = side(a[0], "a"), side(b[0], "b")
    if by_signature:
        mine = F.struct("section_b", "n_b", "print_b")
        first = right.groupBy("pair_id", "kind", "signature").agg(F.min_by(mine, "section_b").alias("x")).select("pair_id", "kind", "signature", "x.*")
        met = settle(left.join(first, ["pair_id", "kind", "signature"], "left"))
        used = met.where("section_b is not null").select("pair_id", "kind", "section_b").distinct()
        both = met.unionByName(right.join(used, ["pair_id", "kind", "section_b"], "left_anti"), allowMissingColumns=True)
        key = F.concat(section_label(F.col("signature")), F.lit("·"), (F.coalesce("section_a", "section_b") + 1).cast("string"), F.when(F.col("section_a").isNull(), "B").otherwise(""))
    else:
        nth = lambda d, x: nth_occurrence(d.drop("signature"), ["pair_id", "kind"], f"section_{x}")
        both = nth(left, "a").join(nth(right, "b"), ["pair_id", "kind", "nth"], "full")
        key = F.concat(F.when(F.col("kind") == "header", "H").otherwise("T"), (F.col("nth") + 1).cast("string"))
    alike = (F.col("n_a") == F.col("n_b")) & F.col("print_a").eqNullSafe(F.col("print_b"))
    status = F.when(F.col("section_a").isNull(), "unmatched_b").when(F.col("section_b").isNull(), "unmatched_a").when(alike, "equal").otherwise("diff")
    kind = [F.when(F.col(f"section_{x}").isNotNull(), F.col("kind")).alias(f"kind_{x}") for x in "ab"]
    met = both.select("pair_id", key.alias("key"), F.col("kind").alias("section"), status.alias("status"), "n_a", "n_b", "section_a", "section_b", *kind)
    return lines_apart(met, a[1], b[1], ["section", "kind"], ["section"])


def _row_key(raw: Column, display: Column) -> Column:
    return F.when(display.isNotNull(), F.substring(strip(F.get(display, F.lit(0))), 1, 80)).otherwise(strip(raw))


def _match(a: DataFrame, b: DataFrame, key: Column, skip: list[int], label: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    side = lambda d, x: d.withColumn("key", key).select("pair_id", "key", "line_no", "sort_key", F.struct("raw", "fields", "display").alias(x))
    ka, kb = side(a, "a"), side(b, "b")
    numbered = lambda d: nth_occurrence(d.where("key is not null"), ["pair_id", "key"], "line_no")
    na, nb = numbered(ka).withColumnRenamed("line_no", "la"), numbered(kb).withColumnRenamed("line_no", "lb")
    both = na.join(nb.select("pair_id", "key", "nth", "lb", "b", F.col("sort_key").alias("sb")), ["pair_id", "key", "nth"], "full")
    both = settle(both)
    met = both.where("a is not null and b is not null")
    shown = lambda x: F.coalesce(F.col(f"{x}.display"), F.col(f"{x}.fields"))
    lines = lambda x: F.coalesce(F.col(f"{x}.display"), F.array(f"{x}.raw"))
    differs = F.size(diff_columns(F.col("a.fields"), F.col("b.fields"), skip, None)) > 0
    fold = F.col("a.display").isNotNull() | F.col("b.display").isNotNull()
    diff = F.when(differs, F.when(fold, diff_columns(lines("a"), lines("b"), missing=None)).otherwise(diff_columns(F.col("a.fields"), F.col("b.fields"), skip, None))).otherwise(F.array().cast("array<int>"))
    own = _row_key(F.col("a.raw"), F.col("a.display"))
    results = met.select(
        "pair_id", (F.when(F.col("key") != "", F.replace("key", F.lit(UNIT), F.lit(":"))).otherwise(own) if label else own).alias("key"), F.when(differs, "diff").otherwise("equal").alias("status"), F.lit("data").alias("section"),
        shown("a").alias("a_cols"), shown("b").alias("b_cols"), diff.alias("diff_cols"), F.col("a.raw").alias("a_raw"), F.col("b.raw").alias("b_raw"),
    )

    def left(d: DataFrame, k: DataFrame, x: str, no: str) -> DataFrame:
        first = k.where("key is not null").groupBy("pair_id", "key").agg(F.min("line_no").alias("__first"))
        over = d.select("pair_id", "key", F.col(no).alias("line_no"), F.col("sort_key" if x == "a" else "sb").alias("sort_key"), x).join(first, ["pair_id", "key"])
        lone = k.where("key is null").withColumn("__first", F.lit(-1).cast("long")).select("pair_id", "key", "line_no", "sort_key", x, "__first")
        every = over.unionByName(lone)
        # in key mode rows without a key come first, then by their key's first line; else by their text
        order = F.struct("__first", F.lit("").alias("t"), "line_no") if label else F.struct(F.lit(0).cast("long").alias("__first"), F.col("sort_key").alias("t"), "line_no")
        return every.select("pair_id", F.col("line_no").alias("id"), order.alias("ord"), F.col(f"{x}.fields").alias("fields"), F.col(f"{x}.raw").alias("raw"), F.col(f"{x}.display").alias("display"))

    return results, left(both.where("b is null"), ka, "a", "la"), left(both.where("a is null"), kb, "b", "lb")


def report_match_keyed(a: DataFrame, b: DataFrame, keys: list[int], skip: list[int] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Result rows of report rows with the same key, the n-th with the n-th, and what is left of both sides for ``partial_match``:
    rows too short for the key and those over."""
    key = F.when(F.size("fields") > max(keys), F.concat_ws(UNIT, *[F.get("fields", F.lit(k)) for k in keys]))
    return _match(a, b, key, list(skip), True)


def report_match_whole_row(a: DataFrame, b: DataFrame, skip: list[int] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Result rows of report rows that are the same but for ``skip``, one to one, and what is left of both sides."""
    if not skip:
        return _match(a, b, F.col("sort_key"), [], False)
    rest = F.filter("fields", lambda x, i: ~i.isin(*skip))
    return _match(a, b, F.when(F.size(rest) > 0, F.array_join(rest, UNIT)).otherwise(F.col("sort_key")), list(skip), True)


def count_checks(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """``pair_id, section, declared, counted, ok`` of sections whose footer declares a number of records.

    A count label has its number within 80 characters, on the next line perhaps; else a quantity label on its own line.
    """
    text = F.array_join("lines", "\n")
    count = F.regexp_extract(text, COUNT_LABEL, 1)
    quantity = F.regexp_extract(text, QUANTITY_LABEL, 1)
    said = blocks.where("kind = 'footer'").select("pair_id", "section", F.replace(F.coalesce(F.nullif(count, F.lit("")), F.nullif(quantity, F.lit(""))), F.lit(","), F.lit("")).alias("declared")).where("declared is not null")
    n = rows.groupBy("pair_id", "section").agg(F.count("*").alias("n"))
    out = said.join(n, ["pair_id", "section"], "left").select("pair_id", "section", "declared", F.coalesce("n", F.lit(0)).cast("long").alias("counted"))
    return out.withColumn("ok", F.coalesce(F.col("declared").try_cast("long") == F.col("counted"), F.lit(False)))


def report_summary(block_results: DataFrame, row_results: DataFrame, rows_a: DataFrame, rows_b: DataFrame, blocks_a: DataFrame, blocks_b: DataFrame) -> DataFrame:
    """One row for each pair: sections and rows of both sides, differing lines and blocks of headers and footers, rows by status."""
    lines = F.when(F.col("status") == "diff", F.size("diff_cols")).when(F.col("status") == "equal", 0).otherwise(F.greatest(F.coalesce(F.size("a_cols"), F.lit(0)), F.coalesce(F.size("b_cols"), F.lit(0))))
    kind = lambda k, v: F.sum(F.when(F.col("section") == k, v).otherwise(0))
    other = (F.col("status") != "equal").cast("int")
    b = block_results.groupBy("pair_id").agg(*[kind(k, v).cast("long").alias(f"{k}_{n}") for k in ("header", "footer") for n, v in (("line_diff", lines), ("block_diff", other))])
    r = row_results.groupBy("pair_id").agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in (("equal", "equal"), ("diff", "partial"), ("unmatched_a", "only_a"), ("unmatched_b", "only_b"))])
    out = b.join(r, "pair_id", "full")
    for x, rows, blocks in (("a", rows_a, blocks_a), ("b", rows_b, blocks_b)):
        fold = F.max(F.coalesce(F.size("display"), F.lit(1))).alias(f"fold_{x}")
        out = out.join(rows.groupBy("pair_id").agg(F.count("*").alias(f"rows_{x}"), F.greatest(fold, F.lit(1)).alias(f"fold_{x}")), "pair_id", "full")
        out = out.join(blocks.where("kind = 'header'").groupBy("pair_id").agg(F.count("*").alias(f"sections_{x}")), "pair_id", "full")
    return out.fillna(0)


def report_batch_detail(summary: DataFrame, results: DataFrame, most: int = 5000) -> tuple[DataFrame, DataFrame]:
    """The overview of a batch of reports, one row a report, and the first ``most`` lines of what isn't equal.

    The limit is part of the report: it is a sheet for reading.
    """
    return summary.orderBy("pair_id"), export_report_diff(results).orderBy("pair_id", "key", "no").limit(most)


def export_report_diff(results: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``pair_id, status, key, no, name, a, b``: differing fields; lines of blocks are called by their number; a row of one side is one
    line, its fields two spaces apart."""
    rows = results.where("status <> 'equal'")
    i = F.explode(F.when(F.col("status") == "diff", F.col("diff_cols")).otherwise(F.array(F.lit(-1))))
    rows = rows.withColumn("i", i)
    value = lambda x: F.when(F.col("i") >= 0, F.coalesce(F.get(x, F.col("i")), F.lit(""))).otherwise(F.coalesce(F.array_join(x, "  "), F.lit("")))
    named = F.coalesce(F.get(F.array(*[F.lit(n) for n in names or []]).cast("array<string>"), F.col("i")), F.concat(F.lit("栏位"), (F.col("i") + 1).cast("string")))
    name = F.when(F.col("i") < 0, "").when(F.col("section").isin("header", "footer"), F.concat(F.lit("第"), (F.col("i") + 1).cast("string"), F.lit("行"))).otherwise(named)
    return rows.select("pair_id", "status", "key", (F.col("i") + 1).alias("no"), name.alias("name"), value("a_cols").alias("a"), value("b_cols").alias("b"))
