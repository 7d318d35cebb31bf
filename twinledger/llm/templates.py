"""Main text of web pages, with site templates removed.

Spark counts on how many different pages of a host each element subtree occurs, told apart by a
hash.  Subtrees that recur across many pages of their host are its template and are deleted; what is
left of the page outside menus, headers, footers, sidebars, notices, adverts, forms, comments,
scripts and styles is its text.  Inside a page's article only containers can be template: a
paragraph, a heading or an item there is text however often it recurs, and so is what stands in
inline elements, unless their names or marks say otherwise, or unless it recurs on most of many pages of the host.  Of a header inside an article
only the headings stay.

A mark that only has one of the words among others (``reader-comments``) is weaker: such an element is left out if it
holds less than half of the text that the page has otherwise, so no article is lost to the name of a box around it.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, checkpoint, fresh, packed, prepare
from .urls import host_and_path

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*>?)",
    re.S,
)
_ATTR = re.compile(r"([A-Za-z_:][^\s=/>]*)\s*+(?:=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")

# Element names by their part in a page.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dd dt td th tr tbody thead tfoot caption figcaption summary".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes svg math template object canvas audio video".split())
DROP = frozenset("head nav footer aside form button select option datalist dialog menu search fieldset label".split())
#: A class, id or role that is one of these words, or is put together from them and JOINS only, marks an element that isn't main text.
DROP_WORDS = frozenset(
    "ad ads adbox adsbygoogle adslot adunit advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie "
    "cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion related reply respond "
    "share sharing sharebar sidebar signup social sponsor sponsored subscribe toolbar widget widgets complementary contentinfo alert".split()
)
JOINS = frozenset(
    "article area bar block bottom box button buttons card column container content form global header holder icon icons inner item items left link links list main "
    "media message page panel post posts primary right section secondary site slot top unit wrap wrapper".split()
)
#: One of these words among others of a class, id or role is a weak mark, unless a word before it says that the page has or lacks it.
WEAK_WORDS = frozenset(
    "advert adverts advertisement ad ads breadcrumb breadcrumbs comment comments consent cookie cookies disqus menu navbar navigation newsletter pagination popup promo related "
    "share sharing sidebar sponsored subscribe toolbar".split()
)
SAYS = frozenset("has have is no not with without hide hidden show enable enabled disable disabled".split())
COMMENTS = frozenset("comment comments commentlist disqus reply respond".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts into which the pages of a host are dealt.
SALTS = 16
CLOSED_BY_BLOCK = frozenset(["p"])
#: Elements whose end a sibling of the same kind implies, and what keeps them apart.
SIBLINGS = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("table", "tr")), "th": ("td th", ("table", "tr")), "option": ("option", ("select", "datalist"))}


def marked(mark: str) -> set[str]:
    """The words by which a class, id or role marks an element as no main text."""
    out: set[str] = set()
    for token in mark.split():
        parts = [p.lower() for p in _PART.findall(token)]
        parts = [p for p in parts if len(p) > 1] or parts
        words = DROP_WORDS.intersection([*parts, token.lower()])
        if words and (token.lower() in DROP_WORDS or all(p in DROP_WORDS or p in JOINS for p in parts)):
            out |= words
    return out


def weakly_marked(mark: str) -> bool:
    """Whether a class, id or role has one of the words among others."""
    for token in mark.split():
        parts = [p.lower() for p in _PART.findall(token)]
        if any(p in WEAK_WORDS and not SAYS.intersection(parts[:k]) for k, p in enumerate(parts)):
            return True
    return False


class Frame:
    """An open element: what of it is left out (``dropped`` for good, ``soft`` by its marks only), and where it stands."""

    __slots__ = ("name", "dropped", "soft", "comments", "outer", "byline", "article", "main", "inline", "depth", "content", "first", "mark", "weak")

    def __init__(self, name: str, above: Frame | None, first: int, mark: str):
        self.name, self.first, self.mark, self.inline, self.depth = name, first, mark, False, 0
        self.weak = False
        self.content: list[str] = []
        for k in ("dropped", "soft", "comments", "outer", "byline", "article", "main"):
            setattr(self, k, bool(above and getattr(above, k)))


class Page:
    """Blocks of a page and the hashed subtrees around them.

    ``blocks`` has (text, left out, in article, in main, outer): outer is what stands in an article or main element inside an
    element that its marks leave out.  ``subtrees`` has (hash, first block, end) of containers inside an article and of any block
    element outside; ``texts`` those of an article's text blocks, ``weak`` the first block and end of weakly marked elements.
    """

    def __init__(self, html: str):
        self.blocks: list[tuple[str, bool, bool, bool, bool]] = []
        self.subtrees: list[tuple[int, int, int]] = []
        self.texts: list[tuple[int, int, int]] = []
        self.weak: list[tuple[int, int]] = []
        self._text: list[str] = []
        self._stack = [Frame("", None, 0, "")]
        at, n = 0, len(html)
        open_raw: set[str] = set()  # names of which no end follows
        while at < n:
            m = _TAG.search(html, at)
            if not m:
                self._add(html[at:])
                break
            if m.start() > at:
                self._add(html[at : m.start()])
            at = m.end()
            name = m["name"]
            if name is None:
                continue
            name = name.lower()
            if m["close"]:
                self._close(name)
            elif name in RAW:
                # what is inside isn't markup of this page; an unclosed one runs to the end of the page
                single = m["attrs"].endswith("/>")
                end = None if single or name in open_raw else re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
                if end:
                    at = end.end()
                elif not single:
                    open_raw.add(name)
                if not end and not single and name in ("script", "style", "textarea", "title", "xmp"):
                    at = n
                self._add(" ")
            else:
                self._open(name, m["attrs"])
        self._flush()
        while len(self._stack) > 1:
            self._pop()

    def _add(self, raw: str) -> None:
        if not self._stack[-1].inline:  # what an inline element leaves out doesn't cut the block around it
            self._text.append(raw)

    def _flush(self) -> None:
        if self._text:
            # text inside an inline element that is left out isn't kept, so what is kept belongs to the element around it
            top = next(f for f in reversed(self._stack) if not f.inline)
            raw = "".join(self._text)
            self._text.clear()
            text = " ".join((unescape(raw) if "&" in raw else raw).split())
            if text:
                self.blocks.append((text, top.dropped or top.soft or top.byline, top.article, top.main, top.outer))
                top.content.append(text)

    def _open(self, name: str, attrs: str) -> None:
        own = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)} if len(attrs) > 1 else {}
        hidden = bool(own) and ("hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", ""))
        mark = " ".join(filter(None, (own.get(k) for k in ("class", "id", "role"))))
        words = marked(mark) if mark and name not in ("html", "body", "main") else set()
        if name not in BLOCK:
            top = self._stack[-1]
            if top.inline:
                top.depth += name == top.name and not attrs.endswith("/>")
            elif name in ("br", "wbr", "img"):
                self._text.append(" ")
            elif name not in VOID and not attrs.endswith("/>") and (name in DROP or hidden or words):
                frame = Frame(name, top, len(self.blocks), mark)
                frame.inline, frame.dropped, frame.depth = True, True, 1
                self._stack.append(frame)
            return
        self._flush()
        if name == "hr":
            return
        i = len(self._stack) - 1
        while self._stack[i].inline:
            i -= 1
        if self._stack[i].name in CLOSED_BY_BLOCK:
            self._pop_to(i)
        if name in SIBLINGS:
            ends, walls = SIBLINGS[name]
            for i in range(len(self._stack) - 1, 0, -1):
                if self._stack[i].name in walls:
                    break
                if self._stack[i].name in ends.split():
                    self._pop_to(i)
                    break
        top = self._stack[-1]
        f = Frame(name, top, len(self.blocks), mark)
        if name in ("article", "main") and f.soft and not f.comments and not f.dropped:
            f.soft, f.outer = False, True  # it may be what the page is about, if nothing else is
        f.dropped |= name in DROP or hidden or (name == "header" and not f.article)
        f.soft |= bool(words)
        f.weak = bool(mark) and not words and name not in ("html", "body", "main", "article") and weakly_marked(mark)
        f.comments |= bool(words & COMMENTS)
        f.byline = name not in HEADINGS and (f.byline or (name == "header" and f.article))
        gone = f.dropped or f.soft
        f.article |= name == "article" and not gone
        f.main |= (name == "main" or own.get("role") == "main") and not gone
        self._stack.append(f)

    def _close(self, name: str) -> None:
        if name not in BLOCK:
            for i in range(len(self._stack) - 1, max(0, len(self._stack) - 4), -1):
                f = self._stack[i]
                if f.inline and f.name == name:
                    f.depth -= 1
                    if f.depth <= 0:
                        if i < len(self._stack) - 1:
                            self._flush()
                        self._pop_to(i)
                    break
            return
        self._flush()
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i].name == name:
                self._pop_to(i)
                break

    def _pop_to(self, i: int) -> None:
        while len(self._stack) > i:
            self._pop()

    def _pop(self) -> None:
        f = self._stack.pop()
        if f.inline:
            return
        top = self._stack[-1]
        known = "\x1f".join((f.name, f.mark, *f.content))
        digest = xxhash.xxh64_intdigest(known.encode("utf-8", "surrogatepass"))
        top.content.append(f"{digest:x}")
        if f.weak and f.first < len(self.blocks):
            self.weak.append((f.first, len(self.blocks)))
        if f.content and f.name not in ("html", "body", "head", "main", "article"):
            # a hash's last bit says which of the two it is
            inside = f.article and f.name in TEXT_BLOCKS
            (self.texts if inside else self.subtrees).append(((digest | 1 if inside else digest & ~1) - (1 << 63), f.first, len(self.blocks)))

    def hashes(self) -> list[int]:
        return list(dict.fromkeys(h for h, _, _ in [*self.subtrees, *self.texts]))

    def main_text(self, template: set[int]) -> str:
        gone = set()
        for h, first, end in [*self.subtrees, *self.texts]:
            if h in template:
                gone.update(range(first, end))
        chosen = self._chosen(gone)
        # weakly marked elements go, the smallest first, while each holds less than half of what would stay without it
        for first, end in sorted(self.weak, key=lambda x: x[1] - x[0]):
            inside = sum(len(self.blocks[i][0]) for i in range(first, end) if i in chosen)
            if inside and 2 * inside < sum(len(self.blocks[i][0]) for i in chosen):
                chosen.difference_update(range(first, end))
        return "\n".join(self.blocks[i][0] for i in sorted(chosen))

    def _chosen(self, gone: set[int]) -> set[int]:
        """The blocks of the page's article, else of its main element, else of the whole page."""
        left = [(i, b) for i, b in enumerate(self.blocks) if i not in gone and not b[1]]
        for place, outer in ((2, False), (3, False), (2, True), (3, True)):
            if any(b[place] and b[4] == outer and not b[1] for b in self.blocks):
                return {i for i, b in left if b[place] and b[4] == outer}
        return {i for i, b in left if not b[4]}


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def site_templates(pages: DataFrame, share: float = 0.2, least: int = 5, many: int = 100, strict: tuple[float, int] = (0.5, 20)) -> DataFrame:
    """``host, template``: hashes of the subtrees that recur on many different pages of their host.

    Many is ``least`` pages or more that are ``share`` of the host's, or ``many`` pages however large the
    host, which may have several layouts.  An article's text blocks need more: ``strict`` has the share of the host's pages and the
    number of pages.  Pages with the same html count as one page.
    """

    def make():
        return lambda batch: [pa.array([Page(h or "").hashes() for h in _column(batch, "html")], pa.list_(pa.int64()))]

    own = pages.select(host_and_path(F.col("url"))[0].alias("host"), F.col("html")).withColumn("page", F.xxhash64("html"))
    seen = add_columns(own, [T.StructField("trees", T.ArrayType(T.LongType()))], make).select("host", "page", "trees")
    trees = seen.select("host", "page", F.explode("trees").alias("tree")).distinct().groupBy("host", "tree").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    hosts = own.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    usual = (F.col("n") >= many) | (F.col("n") >= share * F.col("pages"))
    text = (F.col("n") >= strict[1]) & (F.col("n") >= strict[0] * F.col("pages"))
    return trees.join(hosts, "host").where(F.when(F.col("tree") % 2 == 0, usual).otherwise(text)).groupBy("host").agg(F.collect_list("tree").alias("template"))


def extract(pages: DataFrame, share: float = 0.2, least: int = 5, small: int = 8 << 20, many: int = 100) -> DataFrame:
    """``pages`` with ``text`` (empty if there is none) and ``n_chars``, its code points.

    The table of templates is broadcast if it is no larger than ``small`` bytes, else joined in salted parts of hosts.
    Null html counts as empty, and pages without a readable host share the empty host.  Rows are extracted each on
    their own, so repeated rows don't matter; input columns named like an output are replaced.  An empty table gives no rows; a page
    is parsed whole, whatever its length.
    """
    prepare(pages.sparkSession)
    names = fresh(pages, "text", "n_chars").columns
    rows = packed(pages).withColumn("host", host_and_path(F.col("row.url"))[0])
    known = checkpoint(site_templates(pages, share, least, many))
    hosts, hashes = known.agg(F.count("*"), F.coalesce(F.sum(F.size("template")), F.lit(0))).first()
    if 200 * hosts + 8 * hashes <= small:
        rows = rows.join(F.broadcast(known), "host", "left")  # its size is known by now
    else:
        # a host's pages are dealt over some tasks, each with the host's templates; adaptive execution splits what is still large
        salt = F.pmod(F.xxhash64("row.html", "row.url"), F.lit(SALTS)).cast("int")
        known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", salt).join(known, ["host", "salt"], "left").drop("salt")

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            html = pc.struct_field(batch.column(batch.schema.get_field_index("row")), "html").to_pylist()
            return [pa.array([Page(h or "").main_text(set(t or ())) for h, t in zip(html, _column(batch, "template"), strict=True)], pa.string())]

        return work

    out = add_columns(rows, [T.StructField("text", T.StringType())], make)
    return out.select(*[F.col(f"row.`{c}`") for c in names], "text", F.length("text").cast("long").alias("n_chars"))
