"""Main text of web pages by site style trees.

The pages of one host are merged into a tree. A presentation node is an element's path of tags, classes and ids; its styles are
the sequences of child elements that its pages show; content nodes are the texts that stand there. A content is the less
important the more pages share it, a node the less, the less its styles and all below it differ from page to page. Branches of low
importance are removed from each page. Furniture that its own tag, role or class names goes too, whatever the tree says.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, reduce
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import cut_lineage, read_table, text_slices

# Tags by role.
SILENT = frozenset("script style noscript template iframe object embed svg math canvas audio video head title select option textarea button datalist map".split())
FURNITURE = frozenset("nav footer aside form menu dialog header".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promotion|sidebar|side|aside|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|footer|foot|masthead|topbar|toolbar|cookie|cookies|consent|gdpr|notice|notices|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommended|recommendations|comment|comments|commentlist|disqus|respond|reply|replies|pagination|pager|widget|copyright|legal|skip|hidden|print-only)(?:$|[\s_-])",
    re.IGNORECASE,
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: Flow content that ends a head whose end tag is left out.
FLOW = CLOSES_P | frozenset("body li dl dt dd td tr a b i em strong span img br".split())
#: A class or id word marks no element that holds this share of the page's text or more.
MOST = 0.5
#: Containers of an article, in which a header tag or a heading belongs to the text.
MAIN = frozenset(("article", "main"))


#: Elements nested deeper belong to their ancestor at this depth.
DEPTH = 48


@dataclass(frozen=True)
class PageParams:
    """A node is judged where at least `pages` different pages of a host have it. It is low where its composite
    importance and those of all below it are under `least`, a content where its own is under `least_within` (0.1: 70 % of 43 pages, 44 % of 4,000 share it). Within an article,
    which tells its text by its own tag, nodes too are low only under `least_within`. `gamma` is the share of what is below a node
    in its importance, to the power of the number of its styles. The tree takes no more than `most` of an article, and
    never all that is no furniture; a page that would lose more is a copy of others, and keeps all of it."""

    pages: int = 4
    least: float = 0.75
    least_within: float = 0.1
    gamma: float = 0.9
    most: float = 0.5
    broadcast_rows: int = 1_000_000


@dataclass
class Node:
    """An element: the key of its path, its parent's, its depth, whether it is an article's, and the presentations of its
    children, repeats in a row once."""

    key: int
    parent: int
    depth: int
    main: bool = False
    children: list[int] = field(default_factory=list)


@dataclass
class Block:
    """A run of text: the keys of the elements around it from the root on, whether it stands in furniture or in an article, and its text."""

    keys: tuple[int, ...]
    furniture: bool
    main: bool
    pieces: list[str] = field(default_factory=list)
    marks: tuple[int, ...] = ()  # the numbers of the elements around it that a class or id word marks

    @cached_property
    def text(self) -> str:
        return " ".join("".join(self.pieces).split())

    @property
    def content(self) -> int:
        """The key of this text at its node."""
        return _key(self.keys[-1] if self.keys else 0, self.text)


def _key(at: int, name: str) -> int:
    return xxhash.xxh3_64_intdigest(name.encode("utf-8", "surrogatepass"), at & 0xFFFFFFFFFFFFFFFF)


@dataclass
class Open:
    """An element that is not closed yet."""

    tag: str
    node: Node
    keys: tuple[int, ...]
    silent: bool = False
    furniture: bool = False
    main: bool = False
    marks: tuple[int, ...] = ()


class _Reader(HTMLParser):
    """Builds nodes and blocks in page order; tolerant of unclosed and misnested tags, and of pages that break off."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Open("", Node(0, 0, 0), ())
        self.stack: list[Open] = []
        self.nodes: list[Node] = []
        self.blocks: list[Block] = []
        self.fresh = True
        self.marked = 0

    def _top(self) -> Open:
        return self.stack[-1] if self.stack else self.root

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE:
            self.fresh = True
        if tag in FLOW and any(x.tag == "head" for x in self.stack) and not any(x.tag in SILENT - {"head"} for x in self.stack):
            self._close("head")
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self._close("p", stop=FURNITURE | MAIN | {"div", "section", "td", "li", "blockquote"})
        elif tag in ("li", "option", "tr", "td", "th", "dt", "dd"):
            self._close(tag, stop={"ul", "ol", "table", "dl", "select"})
        top = self._top()
        around = top.marks
        named = dict(attrs)
        marks = f"{named.get('class') or ''} {named.get('id') or ''}".strip()
        role = (named.get("role") or "").lower()
        hidden = "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in (named.get("style") or "").replace(" ", "").lower()
        own = tag in FURNITURE and not (tag == "header" and top.main) or role in ROLES or hidden
        is_main = tag in MAIN or role in ("main", "article")
        if marks and MARKED.search(marks) and tag not in ("html", "body") and not is_main:
            self.marked += 1
            around = (*around, self.marked)
        silent = top.silent or tag in SILENT
        node, keys = top.node, top.keys
        if tag not in INLINE and not silent and node.depth < DEPTH:
            name = f"{tag}.{'.'.join(sorted(marks.lower().split()))}.{role}"
            look = _key(0, name)
            if node.children[-1:] != [look]:
                node.children.append(look)
            node = Node(_key(node.key, name), node.key, node.depth + 1, top.main or is_main)
            keys = (*keys, node.key)
            self.nodes.append(node)
        self.stack.append(Open(tag, node, keys, silent, top.furniture or own, top.main or is_main, around))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def _close(self, tag: str, stop: Iterable[str] = ()) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return
            if self.stack[i].tag in stop:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.fresh = True
        if tag not in VOID:
            self._close(tag, stop=("html", "body") if tag in INLINE else ())

    def handle_data(self, data: str) -> None:
        top = self._top()
        if top.silent:
            return
        last = self.blocks[-1] if self.blocks else None
        if last is None or self.fresh or (last.furniture, last.main, last.marks) != (top.furniture, top.main, top.marks):
            self.blocks.append(Block(top.keys, top.furniture, top.main, marks=top.marks))
            self.fresh = False
        self.blocks[-1].pieces.append(data)


def parsed(html: str) -> tuple[list[Node], list[Block]]:
    """The page's elements, and its blocks that have text."""
    reader = _Reader()
    reader.feed(html)
    # What the parser holds back is a tag or a reference that breaks off; only the latter is text.
    rest = reader.rawdata
    if not rest.startswith("<"):
        reader.close()
    blocks = [b for b in reader.blocks if b.text]
    held: dict[int, int] = {}
    total = 0
    for b in blocks:
        if not b.furniture:
            n = len(b.text)
            total += n
            for m in b.marks:
                held[m] = held.get(m, 0) + n
    for b in blocks:
        b.furniture = b.furniture or any(held[m] < MOST * total for m in b.marks)
    return reader.nodes, blocks


def host_of(url: str | None) -> str:
    """The host in lower case without `www.`; '' without one."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", url or "", re.IGNORECASE)
    host = m[1].lower() if m else ""
    return host.removeprefix("www.")


def is_low(b: Block, low: frozenset[int] | set[int]) -> bool:
    """Whether a branch that the block stands in, or its own content, is low."""
    return bool(low) and (not low.isdisjoint(b.keys) or b.content in low)


def main_text(blocks: list[Block], low: frozenset[int] | set[int], most: float = PageParams.most) -> str:
    """The text of the branches that stay: an article's alone, where the page has one."""
    kept = [b for b in blocks if not b.furniture]
    article = [b for b in kept if b.main]
    kept = article or kept
    stays = [b for b in kept if not is_low(b, low)]
    if stays and (not article or sum(len(b.text) for b in stays) >= (1 - most) * sum(len(b.text) for b in article)):
        kept = stays
    return " ".join(b.text for b in kept)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Rows of the merged trees that one partition holds where they are composed, level by level.
ROWS_A_PART = 200_000

#: Kinds of rows in a host's tree: a page has a node; a page shows a style of it; a page has a content at it.
HAS, STYLE, CONTENT = 0, 1, 2
_ROWS = pa.schema([("host", pa.string()), ("key", pa.int64()), ("kind", pa.int32()), ("what", pa.int64()), ("parent", pa.int64()), ("depth", pa.int32()), ("main", pa.bool_()), ("page", pa.int64())])


def tree_rows(url: str | None, html: str) -> set[tuple]:
    """What one page adds to its host's tree: the nodes that show any text there, their styles and contents. `page` is a hash of all its text, by which copies of a page count once."""
    nodes, blocks = parsed(html)
    host, page = host_of(url), _signed(_key(0, "\n".join(b.text for b in blocks)))
    rows = set()
    shown = {key for b in blocks for key in b.keys}
    for n in nodes:
        if n.key not in shown:
            continue
        style = _key(len(n.children), ",".join(map(str, n.children)))
        rows.add((host, _signed(n.key), HAS, 0, _signed(n.parent), n.depth, n.main, page))
        rows.add((host, _signed(n.key), STYLE, _signed(style), 0, 0, False, page))
    for b in blocks:
        rows.add((host, _signed(b.keys[-1] if b.keys else 0), CONTENT, _signed(b.content), 0, 0, False, page))
        if not b.keys:
            rows.add((host, 0, HAS, 0, 0, 0, False, page))
    return rows


def style_tree(pages: DataFrame, p: PageParams) -> tuple[DataFrame, DataFrame]:
    """The merged trees: nodes (host, key, depth, main, pages, importance, peak) and contents (host, key, content, pages, importance).

    With m pages that have the node: a content that n of them share has importance 1 - log n / log m. A node's own importance
    is the entropy of its styles over its pages, in units of log m. Below are its child nodes and its contents, each by
    the pages that show it. Its composite importance is (1 - gamma ** styles) of its own and gamma ** styles of what is below; without
    child nodes it is that of its contents. Its peak is the greatest importance of itself and all below it. A node of fewer than `pages` pages has importance 1. The tree is composed from the
    deepest level up, one small aggregate for each level.
    """
    names = [f.name for f in _ROWS]

    def nodes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, pieces in text_slices(batches, "html"):
            rows = [r for url, html in zip(part.column("url").to_pylist(), pieces, strict=True) for r in tree_rows(url, html)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ROWS)], names)

    ddl = "host string, key long, kind int, what long, parent long, depth int, main boolean, page long"
    shown = pages.select(pages["url"].cast("string"), pages["html"].cast("string")).mapInArrow(nodes, ddl)
    place = [F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("main").alias("main")]
    merged = cut_lineage(shown.groupBy("host", "key", "kind", "what", "page").agg(*place).groupBy("host", "key", "kind", "what").agg(F.count(F.lit(1)).alias("n"), *place))
    n, kind = F.col("n"), F.col("kind")
    of = lambda k, value: F.sum(F.when(kind == k, value))
    logs = lambda k: of(k, n * F.log(n)) / of(k, n)
    m = F.col("m")
    unit = F.log(F.greatest(m, F.lit(2)))
    own = merged.groupBy("host", "key").agg(of(HAS, n).alias("m"), *(F.max(F.when(kind == HAS, F.col(c))).alias(c) for c in ("parent", "depth", "main")), F.count_if(kind == STYLE).alias("styles"), (F.log(of(STYLE, n)) - logs(STYLE)).alias("entropy"), logs(CONTENT).alias("logs"))
    own = cut_lineage(own.select("host", "key", "parent", "depth", "main", "m", "styles", F.least(F.lit(1.0), F.col("entropy") / unit).alias("own"), (1 - F.col("logs") / unit).alias("text")))
    size = own.agg(F.max("depth"), F.count(F.lit(1))).first()
    parts = max(1, -(-size[1] // ROWS_A_PART))
    own = cut_lineage(own.repartition(parts, "host", "key"))
    below, levels = None, []
    for d in range(size[0] or 0, -1, -1):
        level = own.filter(F.col("depth") == d).repartition(parts, "host", "key")
        level = level.withColumns({"weight": F.lit(0).cast("long"), "sum": F.lit(0.0), "top": F.lit(0.0)}) if below is None else level.join(below, ["host", "key"], "left").fillna({"weight": 0, "sum": 0.0, "top": 0.0})
        share = F.pow(F.lit(p.gamma), F.col("styles"))
        held = (F.col("sum") + F.coalesce(F.col("text") * m, F.lit(0.0))) / F.greatest(F.col("weight") + F.when(F.col("text").isNotNull(), m).otherwise(0), F.lit(1))
        composite = F.when(m < p.pages, 1.0).when(F.col("weight") == 0, F.coalesce("text", F.lit(0.0))).otherwise(F.coalesce((1 - share) * F.col("own"), F.lit(0.0)) + F.coalesce(share, F.lit(1.0)) * held)
        text = F.when(m < p.pages, 1.0).otherwise(F.coalesce("text", F.lit(0.0)))
        level = cut_lineage(level.select("host", "key", "parent", "depth", "main", m.alias("pages"), composite.alias("importance"), F.greatest(composite, text, "top").alias("peak")))
        levels.append(level.select("host", "key", "depth", "main", "pages", "importance", "peak"))
        above = level.filter("depth > 0").select("host", F.col("parent").alias("key"), "pages", "importance", "peak").repartition(parts, "host", "key")
        below = above.groupBy("host", "key").agg(F.sum("pages").alias("weight"), F.sum(F.col("importance") * F.col("pages")).alias("sum"), F.max("peak").alias("top"))
    contents = merged.filter(kind == CONTENT).select("host", "key", F.col("what").alias("content"), n.alias("pages")).join(own.select("host", "key", "m"), ["host", "key"])
    importance = F.when(m < p.pages, 1.0).otherwise(1 - F.log("pages") / unit)
    return reduce(DataFrame.unionByName, levels), contents.select("host", "key", "content", "pages", importance.alias("importance"))


def low_branches(pages: DataFrame, p: PageParams) -> DataFrame:
    """(host, key) of the low nodes and contents. A low content on fewer than `pages` pages is none."""
    nodes, contents = style_tree(pages, p)
    enough = F.col("pages") >= p.pages
    least = F.when(F.col("main"), p.least_within).otherwise(p.least)
    low = nodes.filter(enough & (F.col("peak") < least)).select("host", "key")
    return low.unionByName(contents.filter(enough & (F.col("importance") < p.least_within)).select("host", F.col("content").alias("key")))


def extract_main_text(pages: DataFrame, params: PageParams | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_low (blocks, furniture too, that the tree calls low).

    A null html counts as empty; an empty page, and one of only furniture, has an empty text. Pages without a host form one
    site. Repeated rows give repeated rows. An empty table gives an empty result. Other columns are ignored. The low branches
    are broadcast if they are at most `broadcast_rows` (8 bytes each); beyond that they are joined to the pages by host.
    """
    p = params or PageParams()
    spark = pages.sparkSession
    own = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    low = cut_lineage(low_branches(own, p))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_low", pa.int64())])
    ddl = "page_id long, url string, text string, n_chars long, n_low long"
    mask = (1 << 64) - 1

    def extracted(part: pa.RecordBatch, pieces: list[str], lows: Iterable[frozenset[int] | set[int]]) -> pa.RecordBatch:
        texts, cut = [], []
        for html, known in zip(pieces, lows, strict=True):
            blocks = parsed(html)[1]
            texts.append(main_text(blocks, known, p.most))
            cut.append(sum(is_low(b, known) for b in blocks))
        return pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(cut, pa.int64())], schema=schema)

    if low.limit(p.broadcast_rows + 1).count() <= p.broadcast_rows:
        known: dict[str, set[int]] = {}
        for r in low.collect():
            known.setdefault(r["host"], set()).add(r["key"] & mask)
        shared = spark.sparkContext.broadcast(known)

        def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, pieces in text_slices(batches, "html"):
                yield extracted(part, pieces, [shared.value.get(host_of(u), frozenset()) for u in part.column("url").to_pylist()])

        return own.mapInArrow(extract, ddl)

    def extract_joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, pieces in text_slices(batches, "html"):
            yield extracted(part, pieces, [{x & mask for x in lo or ()} for lo in part.column("low").to_pylist()])

    host = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?i:(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+))", 1)), r"^www\.", "")
    lists = low.groupBy("host").agg(F.collect_list("key").alias("low"))
    return own.withColumn("host", host).join(lists, "host", "left").select("page_id", "url", "html", "low").mapInArrow(extract_joined, ddl)


def op10_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_main_text(read_table(spark, sf_dir, "pages"))
