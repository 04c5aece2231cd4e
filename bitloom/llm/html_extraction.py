"""Main-text extraction from HTML by consensus paths of each host.

1. Every page is parsed tolerantly into containers and text blocks, and its containers are scored
   by the text below them that isn't linked (full weight for a block's own container, less for
   those above it, with bonuses and maluses by tag, class and id).
2. Each page votes for the generalised tag-class paths of its best containers (digits are
   dropped from classes), and Spark sums the votes per host and path.
   Names don't drop anything alone: an element named like a sidebar, an advert or comments, or a form, stays if it
   holds half of the page's text and, inside, what marks the main part of a page (``excused``); a page of which
   nothing would be left is read with the names left aside.
3. Pages are read again and the text below their host's winning path is extracted. A page that
   doesn't have that path, or a page without a host, uses its own best container.

Time and memory are linear in the page, whatever its markup: a tag that doesn't end is looked for
once, open elements are counted, and paths are numbers within a page.

Rows: null and empty html give an empty text; very long html is read whole, one page at a time;
repeated rows each give a row and vote each; of equally good containers (ties) the earlier one
counts, of equal votes the path that sorts last; an empty table gives no rows; extra columns are
ignored, whatever their names.

Scale: both passes are narrow. Votes are summed within each batch, then per task, before they are
shuffled, so a host with a third of all pages sends a few rows per task. The winners (one row per
host) are broadcast only up to ``broadcast_hosts`` rows and ``broadcast_bytes`` bytes; beyond, they are joined by
host, where AQE can split a hot host.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import materialize, pieces, tidy

#: Tag roles of HTML.
CONTAINERS = frozenset("html body div article main section td th tr table tbody center figure header footer nav aside form ul ol dl blockquote fieldset details".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre figcaption hr br address caption option summary legend".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content isn't markup; without an end tag it goes up to the end of the page.
RAW = frozenset("script style noscript textarea title iframe".split())
#: Left out with their content if they are closed within their parent; else only the start tag is.
EMBEDDED = frozenset("template svg math object canvas audio video".split())
DROPPED = frozenset("nav aside footer form button select head header menu dialog label".split())
#: Controls, which are words of a sentence within one, outside a form.
CONTROLS = frozenset("button label".split())
_SENTENCE = frozenset("p h1 h2 h3 h4 h5 h6".split())
#: Tags whose start ends an open element of the same group.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Reader comments, also in names written without separators.
_COMMENTS = r"(?:user|reader|page|post|article|blog|fb|facebook|disqus)?comments?(?:list|area|section|thread|form|box|wrapper|wrap|container|feed|block|body|text|content|item|count|meta|author|respond|reply|replies)?s?"
NEGATIVE = re.compile(r"(?i)(?:^|[-_\s])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo(?:tion)?s?|sidebars?|" + _COMMENTS + r"|respond|repl(?:y|ies)|discussions?|disqus|cookies?|consent|gdpr|notices?|banners?|alerts?|popups?|modal|newsletter|subscribe|signup|share|sharing|social|related|recommend(?:ed|ations)?|breadcrumbs?|pagination|pager|menus?|nav|navbar|navigation|toolbar|footers?|headers?|masthead|copyright|widgets?|login|search|skip|hidden)(?:$|[-_\s0-9])")
NEGATIVE_ARTICLE = re.compile(r"(?i)(?:^|[-_\s])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo(?:tion)?s?|" + _COMMENTS + r"|respond|repl(?:y|ies)|related|recommended|teasers?)(?:$|[-_\s0-9])")
_COMMENT_NAME = re.compile(r"(?i)(?:^|[-_\s])(?:" + _COMMENTS + r"|respond|repl(?:y|ies)|discussions?|disqus|related|recommend(?:ed|ations)?|teasers?)(?:$|[-_\s0-9])")
#: Classes that say what an article is, whatever others say of its state.
_ARTICLE_NAMES = frozenset("post hentry h-entry entry story article page single type-post type-page".split())
#: Names that say what a layout has, not what the element is.
_LAYOUT = re.compile(r"(?i)(?:has|with|no|without)[-_][a-z0-9]+")
POSITIVE = re.compile(r"(?i)(?:^|[-_\s])(?:articles?|body|content|entry|main|page|post|text|story|blog)(?:$|[-_\s0-9])")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

#: Comments, declarations and tags. A quote after = that closes hides the > inside it; others are plain characters.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>", re.S)
#: The same where quotes hide nothing.
_PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_MARK = re.compile(r"<[!?/a-zA-Z]")
_ATTR = re.compile(r"(?is)(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)")
_DIGITS = re.compile(r"[0-9]+")


class _Tags:
    """Comments, declarations and tags of a page, in order.

    From the first tag on that doesn't end because of its quotes, quotes hide nothing, so all tags end at the next >. After the
    last > there are no more tags. So no part of the page is searched more than a few times.
    """

    def __init__(self, source: str):
        self.source, self.pattern, self.last = source, _TOKEN, source.rfind(">")

    def next(self, at: int) -> re.Match | None:
        while m := _MARK.search(self.source, at):
            found = self.pattern.match(self.source, m.start())
            if found is None and m.start() < self.last and self.pattern is _TOKEN and m[0] != "</" and m[0][1] not in "!?":
                self.pattern = _PLAIN
                found = _PLAIN.match(self.source, m.start())
            if found is not None:
                return found
            if m.start() > self.last and self.source.find("<!", m.start()) < 0 and self.source.find("<?", m.start()) < 0:
                return None
            at = m.start() + 1
        return None


def embedded_ends(source: str) -> dict[int, int]:
    """Where the content of embedded elements ends, by where it starts; none for those not closed within their parent."""
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    opened: Counter = Counter()
    endless: set[str] = set()
    at = 0

    def pop() -> tuple[str, int]:
        tag, start = stack.pop()
        opened[tag] -= 1
        return tag, start

    tags = _Tags(source)
    for m in iter(lambda: tags.next(at), None):
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW and not closing and (tag in ("script", "style") or not opened["svg"] and not opened["math"]):
            end = None if tag in endless or m[3].endswith("/") else re.compile(rf"(?i)</{re.escape(tag)}\s*>").search(source, at)
            if end:
                at = end.end()
            elif not m[3].endswith("/"):
                endless.add(tag)
        elif closing and opened[tag]:
            while (top := pop())[0] != tag:
                pass
            if tag in EMBEDDED:
                ends[top[1]] = at
        elif not closing and (tag in EMBEDDED or tag in BLOCKS or tag in DROPPED) and tag not in VOID and not m[3].endswith("/"):
            if tag in BLOCKS and stack and stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                pop()
            stack.append((tag, at))
            opened[tag] += 1
    return ends


_LONG_REFERENCE = re.compile(r"&#(?:0*+[0-9]{8,}|[xX]0*+[0-9a-fA-F]{7,});?")


def decoded(text: str) -> str:
    """``text`` with its character references decoded; numbers too long for a character give U+FFFD."""
    return entities.unescape(_LONG_REFERENCE.sub("\ufffd", text) if "&#" in text else text)


#: Why a container may be dropped: it never holds main text, or its name or tag suggests so, or its name says it holds comments or teasers.
HARD, NAMED, REMARKS = 1, 2, 3


class Node:
    __slots__ = ("tag", "path", "up", "first", "stop", "doubt", "dropped", "factor", "score", "size", "main", "around", "good", "titled", "named")

    def __init__(self, tag: str, path: int, up: Node | None, first: int, doubt: int, factor: float, good: bool = False):
        self.tag, self.path, self.up, self.first, self.stop = tag, path, up, first, -1
        self.doubt, self.dropped, self.factor, self.score, self.good = doubt, False, factor, 0.0, good
        self.size = 0  # unlinked characters below
        self.main = 0  # characters below a main element or a single article; 0 without
        self.named = 0  # characters below a container named for content
        self.titled = False  # a page title is in it
        self.around = False  # navigation, headers or footers are below


class Page:
    """Containers and blocks of one page. ``blocks``: (text, linked characters, container or None if dropped)."""

    def __init__(self, source: str):
        self.steps: dict[tuple[int, str], int] = {}  # number of the path that a step leads to from another path
        self.paths: list[tuple[int, str]] = [(-1, "")]  # the last step of each path
        self.root = Node("html", 0, None, 0, 0, 0.6)
        self.nodes: list[Node] = [self.root]
        self.blocks: list[tuple[str, int, Node | None]] = []  # text, linked characters, container
        self._parse(source)
        self._drop()
        self.blocks = [(text, linked, None if node.dropped else node) for text, linked, node in self.blocks]
        for text, linked, node in self.blocks:
            share = max(0, len(text) - 2 * linked)
            for weight in (1.0, 0.5, 0.25, 0.12, 0.06):
                if node is None:
                    break
                node.score += weight * share * node.factor
                node = node.up

    def _drop(self) -> None:
        """Decide which containers are dropped, from the inside out, then passed down."""
        for text, linked, node in self.blocks:
            node.size += max(0, len(text) - 2 * linked)
        for node in reversed(self.nodes):
            if node.up is not None and node.doubt != HARD:
                node.up.size += node.size
        total = self.root.size
        bad = {}
        for node in reversed(self.nodes):
            if node.doubt == 0 and node.tag in ("main", "article"):
                node.main = node.size
            if node.doubt == 0 and node.good:
                node.named = node.size
            bad[id(node)] = node.doubt == HARD or node.doubt > 0 and not self._excused(node, total)
            if node.up is not None:
                if not bad[id(node)]:
                    node.up.main = max(node.up.main, node.main)
                    node.up.named = max(node.up.named, node.named)
                    node.up.around |= node.around
                    node.up.titled |= node.titled
                elif node.tag in ("nav", "header", "footer", "aside") or node.doubt == NAMED and node.tag != "form":
                    node.up.around = True
        for leave in (False, True):
            for node in self.nodes:
                own = node.doubt == HARD if leave else bad[id(node)]
                node.dropped = own or node.up is not None and node.up.dropped
            if any(not node.dropped for _, _, node in self.blocks):
                break

    @staticmethod
    def _excused(node: Node, total: int) -> bool:
        """A doubtful container that holds half of the page and in it its title or one main part, or, unless it is named for remarks, the page's frame."""
        if 2 * node.size < total or not node.size:
            return False
        return node.titled or 2 * node.main >= node.size or node.doubt != REMARKS and (node.around or 2 * node.named >= node.size)

    def path_id(self, path: str) -> int | None:
        """The number of a path written out, if the page has it."""
        at = 0
        for step in path.split(">")[1:]:
            at = self.steps.get((at, step), -1)
            if at < 0:
                return None
        return at

    def path_text(self, at: int) -> str:
        out = []
        while at:
            at, step = self.paths[at]
            out.append(step)
        return "".join(f">{x}" for x in reversed(out))

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, Node, bool]] = [("html", self.root, False)]  # tag, its container, whether it opened one
        parts: list[str] = []
        opened = Counter(["html"])  # tags in the stack
        linked = depth_a = at = 0
        ends: dict[int, int] | None = None

        def flush() -> None:
            nonlocal linked, parts
            if parts:
                text = " ".join(decoded("".join(parts)).split())
                if text:
                    node = stack[-1][1]
                    self.blocks.append((text, min(linked, len(text)), node))
                parts = []
            linked = 0

        def close(to: int) -> None:
            while len(stack) > to:
                tag, node, own = stack.pop()
                opened[tag] -= 1
                if own:
                    node.stop = len(self.blocks)

        tags = _Tags(source)
        for m in iter(lambda: tags.next(at), None):
            if m.start() > at:
                parts.append(source[at : m.start()])
                if depth_a:
                    linked += m.start() - at
            at = m.end()
            if m[2] is None:
                if m[0].startswith("<![CDATA["):
                    parts.append(entities.escape(m[0][9:].removesuffix("]]>"), quote=False))
                continue
            tag, closing = m[2].lower(), bool(m[1])
            if tag in RAW and not closing:
                if not m[3].endswith("/"):
                    end = re.compile(rf"(?i)</{re.escape(tag)}\s*>").search(source, at)
                    at = end.end() if end else len(source)
                continue
            if tag in EMBEDDED:
                if not closing and not m[3].endswith("/"):
                    ends = embedded_ends(source) if ends is None else ends
                    at = ends.get(at, at)
                continue
            if tag == "a":
                depth_a = 0 if closing else 1
            if tag not in BLOCKS and tag not in DROPPED and tag != "span":
                continue
            if closing:
                if tag == "span" and not opened["span"]:
                    continue
                k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0) if opened[tag] else 0
                if k:
                    flush()
                    close(k)
                elif tag in BLOCKS:
                    flush()
                depth_a = depth_a if tag == "span" else 0
                continue
            attrs = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in _ATTR.finditer(m[3])} if m[3] else {}
            here = stack[-1][1]
            named = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
            if tag in CONTROLS and stack[-1][0] in _SENTENCE and not opened["form"]:
                continue
            names = _LAYOUT.sub("", named)
            hard = (
                tag in DROPPED and tag != "form" and not (tag == "header" and (opened["article"] or opened["main"]))
                or attrs.get("role", "").lower() in ROLES - {"form", "search"} or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true"
                or "display:none" in attrs.get("style", "").replace(" ", "").lower()
            )
            doubted = tag == "form" or attrs.get("role", "").lower() in ("form", "search")
            if names and tag not in ("html", "body", "main"):
                if tag == "article":
                    doubted |= bool(NEGATIVE_ARTICLE.search(names)) and not _ARTICLE_NAMES & set(names.lower().split())
                else:
                    doubted |= bool(NEGATIVE.search(names))
            bad = HARD if hard else 0 if not doubted else REMARKS if _COMMENT_NAME.search(names) else NAMED
            if tag == "span" and not bad:
                continue
            if tag != "span" or bad:
                flush()
            if tag in VOID:
                continue
            if tag == "h1":
                stack[-1][1].titled = True
            depth_a = 0
            if tag in CLOSES:
                # only up to the list or table that this one belongs to
                for i in () if not any(opened[t] for t in CLOSES[tag]) else range(len(stack) - 1, 0, -1):
                    if stack[i][0] in CLOSES[tag]:
                        close(i)
                        break
                    if stack[i][0] in ("ul", "ol", "dl", "table", "select"):
                        break
            elif tag != "span" and stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and tag in BLOCKS:
                close(len(stack) - 1)
            here = stack[-1][1]
            if tag in CONTAINERS or bad:
                if tag == "html":
                    continue
                key = tag + "".join(f".{c}" for c in sorted({_DIGITS.sub("", c).strip("-_").lower() for c in attrs.get("class", "").replace(">", " ").split()} - {""}))
                # so that a container inside doesn't beat an article with its title
                factor = 3.0 if tag == "article" else 2.2 if tag == "main" else 0.6 if tag in ("body", "ul", "ol", "dl", "table", "tbody", "tr") else 1.0
                if named and POSITIVE.search(named):
                    factor *= 1.3
                path = self.steps.setdefault((here.path, key), len(self.paths))
                if path == len(self.paths):
                    self.paths.append((here.path, key))
                node = Node(tag, path, here, len(self.blocks), bad, factor, bool(named) and bool(POSITIVE.search(names)))
                self.nodes.append(node)
                stack.append((tag, node, True))
            else:
                stack.append((tag, here, False))
            opened[tag] += 1
        if at < len(source):
            parts.append(source[at:])
        flush()
        close(0)
        self.root.stop = len(self.blocks)

    def ranked(self) -> list[Node]:
        """Containers that may hold the main text, best first; the earlier of equals first."""
        return sorted((n for n in self.nodes if not n.dropped and n.score > 0), key=lambda n: -n.score)

    def text(self, nodes: list[Node]) -> str:
        """Kept blocks below ``nodes`` in page order; a block below two of them counts once."""
        take = sorted({i for n in nodes for i in range(n.first, n.stop)})
        return " ".join(self.blocks[i][0] for i in take if self.blocks[i][2] is not None)


def votes(page: Page) -> Counter:
    """Up to 100 points for each of the page's three best containers' paths."""
    best = page.ranked()[:3]
    return Counter({page.path_text(n.path): max(1, int(100 * n.score / best[0].score)) for n in reversed(best)})


def extract(source: str, path: str | None) -> str:
    page = Page(source)
    if path is not None and (wanted := page.path_id(path)) is not None:
        text = page.text([n for n in page.nodes if n.path == wanted and not n.dropped])
        if text:
            return text
    best = page.ranked()[:1]
    return page.text(best) if best else ""


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


@F.arrow_udf(T.StringType())
def _hosts(url: pa.Array) -> pa.Array:
    return pa.array([host_of(u) for u in url.to_pylist()], pa.string())


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total: Counter = Counter()
        for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            host = host_of(url)
            if host and source:
                for path, n in votes(Page(source)).items():
                    total[host, path] += n
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in total]), pa.array([p for _, p in total]), pa.array(list(total.values()), pa.int64())], names=["host", "path", "n"])


def host_paths(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path) of the winning path of each host; equal votes go to the path that sorts last."""
    slim = pages.select(F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    summed = slim.mapInArrow(tidy(_vote), "host string, path string, n long").groupBy("host", "path").agg(F.sum("n").alias("n"))
    return summed.groupBy("host").agg(F.max_by("path", F.struct("n", "path")).alias("path"))


def _extract(box):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "html", 8 << 20):
                url = batch.column(1).to_pylist()
                paths = batch.column(3).to_pylist() if box is None else [box.value.get(host_of(u)) for u in url]
                text = [extract(s, p) if s else "" for s, p in zip(batch.column(2).to_pylist(), paths, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return tidy(run)


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_hosts: int = 200_000, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """page_id, url, text, n_chars of every page. Null and empty html give an empty text; repeated rows each give a row."""
    spark = pages.sparkSession
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    winners = materialize(host_paths(slim), "host-paths")
    out = f"page_id {dict(slim.dtypes)['page_id']}, url string, text string, n_chars long"
    size = winners.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path")), F.lit(0)).alias("bytes")).first()
    if size.n <= broadcast_hosts and size.bytes <= broadcast_bytes:
        box = spark.sparkContext.broadcast({r.host: r.path for r in winners.collect()})
        return slim.mapInArrow(_extract(box), out)
    # the key of the votes, so that both ways give a page the same path
    joined = slim.withColumn("host", _hosts("url")).join(winners, "host", "left").select("page_id", "url", "html", "path")
    return joined.mapInArrow(_extract(None), out)


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
