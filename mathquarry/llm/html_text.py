"""Main text of web pages, with the templates of a site removed.

A page is parsed into a tree; every block element's subtree gets a hash, and Spark counts in how many
different surroundings of a host each hash stands: a surrounding is the subtree of the element around
it, so a copied article counts once, however many pages show it. What stands in a third of a host's
different pages and in four at least is template and is deleted, inside articles too, but never an article as a whole. Lists of links
outside of articles are hashed a second time without their labels, as menus differ from page to page.
Beside that goes what an element itself says to be navigation, advertising, a form or comments.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathquarry.llm.common import forget, sliced, written

#: Template of a host: in this share of its different pages, and in so many surroundings at least.
SHARE, AT_LEAST = 1 / 3, 4
#: Links that a list without other text has at least to be compared without its labels.
LINKS = 3
#: Template tables of up to this many hashes (8 bytes each) are joined by broadcast, larger ones by a shuffle.
TEMPLATE_BROADCAST = 500_000

# Fixed values of HTML: elements without content, with raw content, that begin a block, and closing rules.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option".split()
)
CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"},
}
SCOPE = set("table ul ol dl select body html article section div main aside nav header footer form td th li dd blockquote figure button".split())
# Elements, roles and names of what is not main text.
NOT_TEXT = RAW | set("head nav header footer aside form button select menu template svg canvas object embed dialog audio video".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu|sidebar|breadcrumbs?|footer|header|cookies?|consent|notice|newsletter|subscri\w*|popup|modal|social|share|related|recommend\w*|comments?|respond|disqus|pagination|pager|widget|masthead|toolbar|skip-link)(?:$|[\s_-])",
    re.I,
)
MAIN = ("article", "main")
# Class names and ids of an article that is not the page's own.
NOT_MAIN = set("comment comments reply replies ad ads advert advertisement sponsored promo related recommended".split())

# A tag ends where HTML's tokenizer ends it: quotes count only around an attribute's value. Nothing is tried twice.
_ATTRIBUTES = r"""(?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+)?+|=)*+"""
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?+|</(?![a-zA-Z])[^>]*+>?+|<(/?)([a-zA-Z][^\s/>]*+)(" + _ATTRIBUTES + r")(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(=?[^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^\s>"'][^\s>]*+))?+)?+""")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I | re.A) for tag in RAW}
_BLANK = re.compile(r"\s+")


class Node:
    __slots__ = ("attrs", "children", "digest", "holds", "list_digest", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children, self.digest = tag, attrs, [], 0
        self.list_digest = 0  # of a list of links
        self.holds = False  # an article of the page stands in it

    def attributes(self) -> dict[str, str]:
        found: dict[str, str] = {}
        for k, a, b, c in _ATTRIBUTE.findall(self.attrs) if self.attrs else ():
            found.setdefault(k.lower(), html.unescape(a or b or c or ""))
        return found


class _Open:
    """The open elements, and where those of each name and the last one that limits a search stand."""

    def __init__(self, root: Node):
        self.stack, self.where, self.scopes = [root], {}, []

    def push(self, node: Node) -> None:
        at = len(self.stack)
        self.stack.append(node)
        self.where.setdefault(node.tag, []).append(at)
        if node.tag in SCOPE:
            self.scopes.append(at)

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            tag = self.stack.pop().tag
            self.where[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()

    def last(self, tag: str) -> int:
        found = self.where.get(tag)
        return found[-1] if found else 0

    def close(self, tag: str) -> None:
        """An end tag closes the last element of its name, but not from inside of one that limits the search."""
        at = self.last(tag)
        if at and (tag in SCOPE or not self.scopes or at > self.scopes[-1]):
            self.cut(at)

    def make_room(self, closed: set[str]) -> None:
        """Close the innermost of these elements; one that limits the search may be closed itself."""
        at = max(map(self.last, closed))
        if at and (not self.scopes or at >= self.scopes[-1]):
            self.cut(at)


def parse(page: str) -> Node:
    """A tree of elements and texts (character references not yet decoded); never fails, in time linear in the page."""
    root = Node("#page")
    open_, at, n = _Open(root), 0, len(page)
    match, stack = _TOKEN.search, open_.stack
    while at < n:
        found = match(page, at)
        if found is None:
            stack[-1].children.append(page[at:])
            break
        if found.start() > at:
            stack[-1].children.append(page[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            if page.startswith("<![CDATA[", found.start()):
                stack[-1].children.append(html.escape(page[found.start() + 9 : at].removesuffix("]]>"), quote=False))
            continue
        if not found[4]:
            break  # the page ends within a tag
        tag = tag.lower()
        if found[1]:
            open_.close(tag)
            continue
        closes = CLOSES.get(tag)
        if closes is None and tag in BLOCK:
            closes = CLOSES["p"]
        if closes:
            open_.make_room(closes)
        node = Node(tag, found[3])
        stack[-1].children.append(node)
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            node.children.append(page[at : end.start() if end else n])
            close = page.find(">", end.end()) if end else -1
            at = n if close < 0 else close + 1
        elif tag not in VOID and not found[3].endswith("/"):
            open_.push(node)
    return root


def digest(root: Node) -> int:
    """Hash of every subtree: tags, and texts with white space made one; stored in the nodes, with what else counting needs."""
    order, todo = [], [(root, False)]
    while todo:
        at, linked = todo.pop()
        order.append((at, linked))
        linked = linked or at.tag == "a"
        todo += [(c, linked) for c in at.children if isinstance(c, Node)]
    shape: dict[int, tuple[int, bool, int]] = {}  # links in it, whether it has text beside them, hash without labels
    for at, linked in reversed(order):
        said, bare = [at.tag], [at.tag]
        links, other = int(at.tag == "a"), False
        for child in at.children:
            if isinstance(child, str):
                text = " ".join(child.split())
                said.append(text)
                if text and at.tag not in RAW:
                    other = other or not (linked or at.tag == "a")
            else:
                said.append(format(child.digest, "x"))
                n, beside, hashed = shape.pop(id(child))
                links, other = links + n, other or beside
                bare.append(format(hashed, "x"))
                at.holds = at.holds or child.holds or child.tag in MAIN and not _is_boiler(child)
        at.digest = xxhash.xxh3_64_intdigest("\0".join(said))
        hashed = xxhash.xxh3_64_intdigest("\1".join(bare))
        if links >= LINKS and not other:
            at.list_digest = hashed
        shape[id(at)] = links, other, hashed
    return root.digest


def _is_boiler(node: Node) -> bool:
    """Whether the element says itself that it is no main text; what an article stands in is not judged by its name."""
    if node.tag in NOT_TEXT and not (node.holds and node.tag == "form"):
        return True
    if not node.attrs:
        return False
    named = node.attributes()
    if "hidden" in named or named.get("aria-hidden", "").lower() == "true":
        return True
    if node.tag in MAIN:
        return any(x in NOT_MAIN for k in ("class", "id") for x in named.get(k, "").lower().split())
    if node.holds or node.tag in ("html", "body"):
        return False
    return named.get("role", "").lower() in ROLES or any(NAMES.search(named.get(k, "")) for k in ("class", "id"))


def _may_go(node: Node) -> bool:
    """Whether a subtree may be template: a block, but no article and nothing that one stands in."""
    return node.tag in BLOCK and not node.holds and node.tag not in ("html", "body", *MAIN)


def subtrees(root: Node) -> set[tuple[int, int]]:
    """(hash, surrounding) of block subtrees that may be template: of the page itself as (0, hash) first."""
    page = digest(root)
    out: set[tuple[int, int]] = {(0, page)}
    todo = [(c, root.digest, False) for c in root.children if isinstance(c, Node)]
    while todo:
        at, around, main = todo.pop()
        if at.tag in RAW or at.tag == "head":
            continue
        if _may_go(at):
            out.add((at.digest, around))
            if at.list_digest and not main:
                out.add((at.list_digest, page))
        main = main or at.tag in MAIN
        todo += [(c, at.digest, main) for c in at.children if isinstance(c, Node)]
    return out


def main_text(root: Node, template: set[int]) -> str:
    """Blocks of the main text in page order, one a line. ``template``: hashes as :func:`subtrees` gives them."""
    digest(root)
    blocks: list[list[str]] = [[]]

    def cut() -> None:
        if blocks[-1]:
            blocks.append([])

    # a stack of what is still to be said, and whether it stands in an article; None cuts a block
    todo: list[tuple[Node | str | None, bool]] = [(c, False) for c in reversed(root.children)]
    while todo:
        at, main = todo.pop()
        if at is None:
            cut()
        elif isinstance(at, str):
            blocks[-1].append(at)
        elif at.tag == "br":
            blocks[-1].append(" ")
        elif _is_boiler(at) or _may_go(at) and (at.digest in template or not main and at.list_digest in template):
            blocks[-1].append(" ") if at.tag not in BLOCK else cut()
        else:
            edge = [(None, False)] if at.tag in BLOCK else []
            main = main or at.tag in MAIN
            todo += [*edge, *((c, main) for c in reversed(at.children)), *edge]
    lines = (_BLANK.sub(" ", html.unescape("".join(x))).strip() for x in blocks)
    return "\n".join(x for x in lines if x)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit((url or "").strip()).hostname or "").removeprefix("www.").removeprefix("m.")
    except ValueError:
        return ""


def page_templates(pages: DataFrame) -> DataFrame:
    """``pages``: url, html. (host, hashes): block subtrees that recur on many pages of their host.

    As a template needs a third of its host's different pages, a host has no more of them than three
    times the subtrees of one page. Null html is an empty page; repeated rows are one page of their
    host; an empty table gives no rows; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "html"):
            hosts, found, around = [], [], []
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                seen = subtrees(parse(page or ""))
                hosts += [host_of(url)] * len(seen)
                found += [x - 2**63 for x, _ in seen]
                around += [x - 2**63 for _, x in seen]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(found, pa.int64()), pa.array(around, pa.int64())], ["host", "hash", "around"])

    placed = pages.select(F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "host string, hash long, around long").distinct()
    counted = written(placed.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= AT_LEAST), "subtrees")
    page = F.lit(-(2**63))
    total = counted.where(F.col("hash") == page).select("host", F.col("n").alias("pages"))
    many = counted.where(F.col("hash") != page).join(total, "host").where(F.col("n") >= F.col("pages") * SHARE)
    templates = written(many.groupBy("host").agg(F.collect_list("hash").alias("hashes")), "templates")
    forget(counted)
    return templates


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row: page_id long, url, text string (empty if none), n_chars long (code points).

    Null html is empty, a null or odd url is a host without a name. Repeated rows each get their row;
    an empty table gives none; other columns are not looked at. Character references are decoded,
    white space inside a block is one space, blocks are joined by a line break, ``<br>`` is white space.
    """
    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    templates = page_templates(plain.select("url", "html"))
    size = templates.agg(F.sum(F.size("hashes"))).first()[0] or 0
    hosted = plain.withColumn("host", _host_column()("url"))
    side = F.broadcast(templates) if size <= TEMPLATE_BROADCAST else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "html"):
            texts = []
            for page, hashes in zip(batch.column("html").to_pylist(), batch.column("hashes").to_pylist(), strict=True):
                texts.append(main_text(parse(page or ""), {x + 2**63 for x in hashes or ()}))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = hosted.join(side, "host", "left").select("page_id", "url", "html", "hashes")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def _host_column():
    @F.arrow_udf("string")
    def host(urls: pa.Array) -> pa.Array:
        return pa.array(map(host_of, urls.to_pylist()), pa.string())

    return host


__all__ = ["extract_pages", "main_text", "page_templates", "parse", "subtrees"]
