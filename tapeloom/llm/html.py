"""Main text of web pages, with the templates of a site removed.

Pages are parsed into element trees, and subtrees are hashed in two ways: exactly (tag, class, text and the hashes below)
and as markup alone (tags and classes, runs of equal children as one). Spark counts for each host on how many distinct
pages a hash occurs; what recurs on many pages of its host is a template and is deleted. An article (or main) element and
what is around it is never a template. Around an article both hashes count, as menus, adverts and footers keep their
markup where their words change from page to page; on a page without an article, and inside articles, only
exact ones do, and inside articles only containers, so that passages which some articles quote stay.

Tags and whole class names assist: what they mark as no main text (scripts, forms, reader comments, menus ...)
is deleted as well, which decides on hosts of a few pages, where nothing recurs. What is left is given out block by block.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tapeloom.llm.batches import slices
from tapeloom.sources import read_table, written

#: An exact subtree is a template of its host from this number of distinct pages, whatever the number of pages.
LEAST_PAGES = 4
#: The same for a container inside an article, and for markup around an article.
INSIDE_PAGES = FRAME_PAGES = 8
#: Kinds of keys, in the lowest two bits.
EXACT, INSIDE, FRAME = 0, 1, 2
#: Templates (8 bytes each, in one array) up to this number are broadcast; with more, each page is joined to its own.
BROADCAST_HASHES = 1_000_000

# Fixed values of HTML: elements without an end tag, with raw content, and that break a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "title", "textarea", "noscript", "template", "iframe", "noembed", "noframes", "xmp")
BLOCK = frozenset(
    "address article aside blockquote body center caption dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Containers: inside an article only these are templates; paragraphs, headings, quotations, items and cells are its text.
CONTAINERS = frozenset("aside details dialog dir div fieldset figure footer form menu nav section".split())
#: An open element that the start of an equal or listed element closes.
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"},
    "p": BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"},
}
#: Elements whose text a browser does not show.
UNSEEN = frozenset("head script style noscript template iframe object audio video canvas svg".split())
#: Elements that are never main text.
DROPPED = frozenset("head nav footer aside form script style noscript template iframe button select option menu dialog svg object audio video canvas textarea".split())
# Whole class names, also those of a site's own frame (site-header); entry-header and the like are text.
_DROPPED_CLASS = re.compile(
    r"(?:^|\s)(?:(?:site|page|global|cookie)[_-])?(?:ads?|advert\w*|sponsor\w*|promo\w*|banners?|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|footers?|headers?|masthead|comments?|respond|disqus"
    r"|cookies?|consent|notices?|alerts?|popups?|modals?|newsletter|subscribe|share|sharing|social|related|recommended|pagination|pager|widgets?|skip)(?=$|\s)", re.I
)
_ROLE = re.compile(r"navigation|banner|contentinfo|complementary|search|dialog|alert|menu", re.I)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NUMBER = re.compile(r"\d+")
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


class _Node:
    __slots__ = ("dropped", "hard", "holds", "main", "own", "parts", "shape", "tag")

    def __init__(self, tag: str, dropped: bool, main: bool, mark: str, hard: bool = False, own: bool = False):
        self.tag, self.dropped, self.main, self.parts = tag, dropped, main, [mark]
        #: The markup: the element without numbers in its names, then what follows in it, runs of the same as one.
        self.shape = [_NUMBER.sub("0", mark)]
        #: Dropped by a tag; dropped by more than the class of an element around the article; around an article.
        self.hard, self.own, self.holds = hard, own, False

    def add(self, part: str, shape: str | None) -> None:
        self.parts.append(part)
        if shape and self.shape[-1] != shape:
            self.shape.append(shape)


class Page:
    """The blocks of a page and the keys of its subtrees.

    ``blocks`` holds each text with the number of its element; ``around`` has the element around each. Every tag is handled in a time that does not
    depend on how many elements are open.
    """

    def __init__(self, source: str):
        self.nodes: list[_Node] = [_Node("#", False, False, "")]
        self.hashes: list[tuple[int, int]] = [(0, 0)]
        self.around: list[int] = [-1]  # the element around each, by its number
        self.blocks: list[tuple[str, int]] = []  # a text and its element
        self.open: list[int] = [0]
        #: Places in ``open`` by name, and those of elements that nothing outside them is closed from.
        self.places: dict[str, list[int]] = {self.nodes[0].tag: [0]}
        self.stops: list[int] = []
        self.text: list[str] = []
        at = 0
        for m in self._tokens(source):
            if m.start() > at:
                self._add(source[at : m.start()])
            at = m.end()
            if m["tag"]:
                self._tag(m["tag"].lower(), bool(m["close"]), m["rest"])
        self._add(source[at:])
        while len(self.open) > 1:
            self._end()
        self._flush()
        self.has_article = any(n.main for n in self.nodes)

    def _tokens(self, source: str) -> Iterator[re.Match]:
        at = 0
        while m := _TOKEN.search(source, at):
            yield m
            at = m.end()
            tag = (m["tag"] or "").lower()
            if tag in RAW and not m["close"] and not m["rest"].rstrip().endswith("/"):
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
                at = end.start() if end else len(source)

    def _add(self, raw: str) -> None:
        if self.nodes[self.open[-1]].tag not in RAW:
            self.text.append(raw)

    def _flush(self) -> None:
        if self.text:
            text = " ".join(references.unescape("".join(self.text)).split())
            self.text = []
            if text:
                self.nodes[self.open[-1]].add(text, "#")
                self.blocks.append((text, self.open[-1]))

    def _end(self) -> None:
        """Close the innermost element and hash it into the one around it."""
        i = self.open[-1]
        node = self.nodes[i]
        if node.tag in BLOCK or node.tag in DROPPED:
            self._flush()
        self.open.pop()
        self.places[node.tag].pop()
        if self.stops and self.stops[-1] == len(self.open):
            self.stops.pop()
        if len(node.parts) > 1:
            exact, shape = self.hashes[i] = _digest(node.parts), _digest(node.shape)
            self.nodes[self.open[-1]].add(str(exact), str(shape) if node.tag in BLOCK or node.tag in DROPPED else "#")

    def _tag(self, tag: str, closing: bool, rest: str) -> None:
        if tag in ("br", "hr") or closing and tag == "p" and not self._is_open("p"):
            self.text.append(" ")
            if tag != "br":
                self._flush()
            return
        if closing:
            if self._is_open(tag):
                while self.nodes[self.open[-1]].tag != tag:
                    self._end()
                self._end()
            return
        if tag in VOID:
            return
        if tag in BLOCK or tag in CLOSED_BY:
            k = max((self.places[name][-1] for name in _CLOSES.get(tag, ()) if self.places.get(name)), default=0)
            if k and (not self.stops or self.stops[-1] <= k):
                while len(self.open) > k:
                    self._end()
        if tag in BLOCK or tag in DROPPED:
            self._flush()
        names = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(rest)} if "=" in rest else {}
        around = self.nodes[self.open[-1]]
        main = around.main or tag in ("article", "main")
        mark = f"{names.get('class', '')} {names.get('id', '')}"
        by_tag = tag in DROPPED or (tag == "header" and not around.main)
        by_class = tag not in ("html", "body", "article", "main") and bool(names) and bool(_DROPPED_CLASS.search(mark) or _ROLE.search(names.get("role", "")))
        hard = around.hard or by_tag
        own = hard if main and not around.main else around.own or by_tag or by_class
        if main and not around.main:
            for i in reversed(self.open):
                if self.nodes[i].holds:
                    break  # and so do all around it
                self.nodes[i].holds = True
        if tag in BLOCK and tag not in ("p", "div"):
            self.stops.append(len(self.open))
        self.places.setdefault(tag, []).append(len(self.open))
        self.around.append(self.open[-1])
        self.open.append(len(self.nodes))
        self.nodes.append(_Node(tag, around.dropped or by_tag or by_class, main, f"<{tag} {mark}>", hard, own))
        self.hashes.append((0, 0))
        if rest.endswith("/") and tag not in BLOCK:
            self._end()

    def _is_open(self, tag: str) -> bool:
        return bool(self.places.get(tag))

    def keys(self, i: int) -> list[int]:
        """Keys of element ``i`` as a template: none, one inside an article or on a page without one, else two."""
        node, (exact, shape) = self.nodes[i], self.hashes[i]
        if not exact or node.holds or node.tag in ("html", "body"):
            return []
        if node.main:
            return [exact & ~3 | INSIDE] if node.tag in CONTAINERS else []
        return [exact & ~3 | EXACT, shape & ~3 | FRAME] if self.has_article else [exact & ~3 | EXACT]

    def loose_keys(self, block: tuple[str, int]) -> list[int]:
        """Keys of a text that stands in an element around an article, beside it: such an element has none itself."""
        text, inside = block
        node = self.nodes[inside]
        if not node.holds:
            return []
        mark = node.parts[0]
        return [_digest([mark, text]) & ~3 | EXACT, _digest([_NUMBER.sub("0", mark), "loose"]) & ~3 | FRAME]

    def subtrees(self) -> set[int]:
        """Keys of all subtrees of the page that can be templates."""
        found = {k for i in range(1, len(self.nodes)) for k in self.keys(i)}
        return found.union(*[self.loose_keys(b) for b in self.blocks])

    def split(self, templates: set[int] | frozenset[int], rules: bool = True) -> tuple[list[str], int, int]:
        """The blocks that are left, and how many templates delete and how many only the tags and classes.

        Without ``rules`` only templates and what a browser never shows as text are deleted. The class of an element
        around articles drops them only where no other article is left.
        """
        whole = any(n.main and not n.dropped for n in self.nodes)
        inner = not whole and any(n.main and not n.own for n in self.nodes)
        gone, unseen = [], []  # the element or one around it
        for i, around in enumerate(self.around):
            gone.append(around >= 0 and gone[around] or bool(templates) and any(k in templates for k in self.keys(i)))
            unseen.append(around >= 0 and unseen[around] or self.nodes[i].tag in UNSEEN)
        left, by_template, by_rule = [], 0, 0
        for block in self.blocks:
            text, inside = block
            node = self.nodes[inside]
            if unseen[inside]:
                continue
            if gone[inside] or templates and any(k in templates for k in self.loose_keys(block)):
                by_template += 1
            elif rules and (node.own if inner and node.main else node.dropped):
                by_rule += 1
            else:
                left.append(text)
        return left, by_template, by_rule

    def main_text(self, templates: set[int] | frozenset[int], rules: bool = True) -> str:
        """What :meth:`split` leaves, joined by line ends."""
        return "\n".join(self.split(templates, rules)[0])


#: The elements that each tag closes.
_CLOSES = {tag: [name for name, tags in CLOSED_BY.items() if tag in tags] for tag in set().union(*CLOSED_BY.values())}


def _digest(parts: list[str]) -> int:
    return xxhash.xxh64_intdigest("\x00".join(parts)) - (1 << 63)


def of_host(host: str | None, keys: set[int]) -> list[int]:
    """The keys as keys of that host; the lowest two bits, the kind, stay. Without a host there are none."""
    if host is None:
        return []
    mark = xxhash.xxh64_intdigest(host) & ~3
    return [((k + (1 << 63)) ^ mark) - (1 << 63) for k in keys]


def host_of(url: str | None) -> str | None:
    """Host of an absolute URL in lower case, else None."""
    m = _HOST.match(url) if url else None
    return m[1].lower() if m else None


def page_subtrees(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host``, ``page`` (a hash of the source) and ``found``, the keys of its subtrees, once for each distinct page of a host."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                found = [of_host(host, Page(h or "").subtrees()) for host, h in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.list_(pa.int64()))], names=["host", "page", "found"])

    rows = pages.select(_host(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").cast("string").alias("h")).where("host is not null")
    seen = rows.select("host", F.xxhash64("h").alias("page"), "h").mapInArrow(parsed, "host string, page long, found array<long>")
    return seen.dropDuplicates(["host", "page"])


def site_templates(subtrees: DataFrame) -> DataFrame:
    """``hash`` of the subtrees that recur on many pages of their host, from one row for each distinct page."""
    counts = subtrees.select(F.explode("found").alias("hash")).groupBy("hash").agg(F.count("*").alias("n"))
    kind = F.col("hash").bitwiseAND(3)
    least = F.when(kind == EXACT, LEAST_PAGES).when(kind == INSIDE, INSIDE_PAGES).otherwise(FRAME_PAGES)
    return counts.where(F.col("n") >= least).select("hash")


def _host(url: Column) -> Column:
    """:func:`host_of` as a column."""
    host = F.lower(F.regexp_extract(url.cast("string"), _HOST.pattern, 1))
    return F.when(host != "", host)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: bool = True) -> DataFrame:
    """``id_col``, ``url_col``, ``text``, ``n_chars``, and the numbers of blocks that templates and that only rules deleted, of every page.

    Null and empty pages give an empty text; a null or relative URL has no host, so no templates are removed.
    Repeated rows are kept, further columns are left out, an empty table gives an empty result.
    """
    subtrees = written(page_subtrees(pages, url_col, html_col), "subtrees")
    templates = written(site_templates(subtrees), "templates")
    rows = pages.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{url_col}`").cast("string").alias("__url"), F.col(f"`{html_col}`").cast("string").alias("__html"))
    rows = rows.withColumn("host", _host(F.col("__url")))
    if templates.count() <= BROADCAST_HASHES:
        shared = pages.sparkSession.sparkContext.broadcast(np.sort(templates.toArrow().column("hash").to_numpy()))
        joined = rows.select("__id", "__url", "__html", "host", F.lit(None).cast("array<long>").alias("own"))
    else:
        shared = None
        own = subtrees.select("host", "page", F.explode("found").alias("hash")).join(templates, "hash").groupBy("host", "page").agg(F.collect_list("hash").alias("own"))
        joined = rows.withColumn("page", F.xxhash64("__html")).join(own, ["host", "page"], "left").select("__id", "__url", "__html", "host", "own")

    def templates_of(page: Page, host: str | None, own: list | None) -> set[int]:
        """The keys of the page that are templates of its host."""
        keys = page.subtrees() if host is not None else set()
        if not keys:
            return set()
        if shared is None:
            held = set(own or ())
            return {k for k, h in zip(keys, of_host(host, keys), strict=True) if h in held}
        table, asked = shared.value, np.array(of_host(host, keys), np.int64)
        if not len(table):
            return set()
        hit = table[np.minimum(np.searchsorted(table, asked), len(table) - 1)] == asked
        return {k for k, h in zip(keys, hit.tolist(), strict=True) if h}

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                out: list[list] = [[], [], [], []]
                for source, host, own in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                    page = Page(source or "")
                    blocks, by_template, by_rule = page.split(templates_of(page, host, own), rules)
                    text = "\n".join(blocks)
                    for column, value in zip(out, (text, len(text), by_template, by_rule), strict=True):
                        column.append(value)
                made = [pa.array(out[0], pa.string()), *[pa.array(c, pa.int64()) for c in out[1:]]]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names=[id_col, url_col, "text", "n_chars", "n_template_blocks", "n_rule_blocks"])

    schema = f"`{id_col}` {rows.schema[0].dataType.simpleString()}, `{url_col}` string, text string, n_chars long, n_template_blocks long, n_rule_blocks long"
    return joined.mapInArrow(fn, schema)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``; see :func:`extract_main_text` for nulls, repeats and empty tables."""
    return extract_main_text(read_table(spark, sf_dir, "pages"))
