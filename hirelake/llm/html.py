"""Main text of web pages, with site templates removed.

Each page's element subtrees are hashed; Spark counts on how many different pages of a host a subtree recurs, and
subtrees that recur on many are deleted. Numbers in texts don't count, link targets don't, and of a list of links
outside the article nothing but its elements does, so that a menu is one subtree on all pages of its host. What recurs
because a text is copied is told from templates by the longest block of text of its pages, which copies share.

Then goes what markup itself says is no main text (menus, footers, forms, scripts ...), and if a page marks its article,
what is outside.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import chunks, joined
from .tables import written

#: A subtree is template if it recurs on so many different pages, with so many different longest blocks (or all that
#: the host has), and on this share of the host's pages or on so many of them.
LEAST_PAGES, LEAST_SHARE, MANY_PAGES = 5, 0.01, 100
#: Running text, and all that is inside an article, must recur with this share of the host's longest blocks.
TEXT_SHARE = 0.5
#: A list of links has so many of them and no other text.
LINKS = 3
#: So many templates (8 bytes each) are broadcast; with more, pages are joined with theirs.
BROADCAST_ROWS = 1_000_000

#: Quotes count only after an equals sign; a tag that meets another one outside quotes is text.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^<>]*+>|<\?[^<>]*+>|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>=]++|=\s*+\"[^\"]*\"|=\s*+'[^']*'|=)*+)>", re.S)
_ATTRIBUTE = re.compile(r"(?<![-\w:.])([a-zA-Z_:][-\w:.]*+)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _RAW}
#: Elements that break the text into blocks.
_BLOCK = frozenset("address article aside blockquote body br caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_DROP = frozenset("head script style noscript template svg math canvas iframe object embed nav header footer aside form button select input textarea dialog menu noembed noframes xmp title".split())
_CONTENT = frozenset("article main".split())
#: Blocks that hold running text.
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th b i em strong a span figcaption br".split())
_NAME = r"(?:ads?|advert[a-z]*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|pagination|popup|promo[a-z]*|related|respond|share|sharing|sidebar|skip|social|sponsor[a-z]*|subscribe|toolbar|widget)"
#: What stands round an article, and words that go with these (comment-list, reader-comments, related-posts).
_ROUND = r"(?:comment(?:s|list)?|disqus|recommend(?:ed|ations)|related|respond|share|sharing|teasers?|trending)"
_WITH = r"(?:area|articles?|bar|block|body|box|buttons?|container|content|entry|form|inner|items?|links?|list|more|page|posts?|readers?|section|site|stories|thread|title|user|wrap|wrapper)"
#: A class or id made of such names alone (cookie-banner, but not has-sidebar, no-comments, related-work or social-science).
_NAMES = re.compile(rf"(?:^|\s)(?:{_NAME}(?:[-_]+{_NAME})*|(?:{_WITH}[-_]+)*{_ROUND}(?:[-_]+(?:{_ROUND}|{_WITH}))*)(?:\s|$)", re.I)
_ROUNDS = re.compile(rf"(?:^|[\s_-]){_ROUND}(?:[\s_-]|$)", re.I)
#: Elements that are never dropped for a class or id, but for an article in another one.
_WHOLE = frozenset("html body main article".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar alertdialog".split())
#: An open element of the key is closed by the start of one of the values.
_P_ENDS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_CLOSED_BY = {"p": _P_ENDS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "head": frozenset(["body"])}
_FENCES = frozenset("ul ol dl table select article main section div aside nav header footer form body html".split())
_DIGITS = re.compile(r"[0-9]+")
_INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup tt u var label".split())


class Node:
    __slots__ = ("tag", "dropped", "named", "round", "told", "parts", "hash", "template")

    def __init__(self, tag: str, told: bool = False, named: bool = False, round_: bool = False):
        #: told: by attributes. named: dropped for nothing but its class or id, round: for one that stands round an article.
        #: hash: what templates are told by, None where it can't be one.
        dropped = told or tag in _DROP
        self.tag, self.told, self.dropped, self.named, self.round, self.parts, self.hash, self.template = tag, told, dropped or named, named and not dropped, round_, [], None, False

    def holds(self) -> bool:
        """Whether an article may be inside although this is dropped: a form round all, or a name such as banner."""
        return self.tag == "form" and not self.told or self.named and not self.round


class _Open:
    """The open elements. Each knows the nearest one that isn't inline and the nearest that closing tags don't leave."""

    def __init__(self, root: Node):
        self.nodes, self.solid, self.fence = [root], [0], [0]
        self.of_tag: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        at = len(self.nodes)
        self.nodes.append(node)
        self.solid.append(self.solid[-1] if node.tag in _INLINE else at)
        self.fence.append(at if node.tag in _FENCES else self.fence[-1])
        self.of_tag.setdefault(node.tag, []).append(at)

    def close(self, at: int) -> None:
        for node in self.nodes[at:]:
            self.of_tag[node.tag].pop()
        del self.nodes[at:], self.solid[at:], self.fence[at:]


def parse(html: str) -> Node:
    """A tree of elements and their text; broken markup is closed as browsers roughly do. Linear in the page."""
    root = Node("html")
    stack = _Open(root)
    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            stack.nodes[-1].parts.append(html[at:])
            break
        if m.start() > at:
            stack.nodes[-1].parts.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        opened = stack.of_tag.get(tag)
        if m[1]:
            if opened and (tag not in _INLINE or opened[-1] > stack.fence[-1]):
                stack.close(opened[-1])
            continue
        if tag == "html" or tag == "body" and opened:
            continue
        while tag not in _INLINE:  # elements that this one closes, with the inline ones left open in them
            top = stack.solid[-1]
            if not top or tag not in _CLOSED_BY.get(stack.nodes[top].tag, ()):
                break
            stack.close(top)
        if tag in ("h1", "h2") and (headers := stack.of_tag.get("header")):
            top = stack.nodes[headers[-1]]  # the heading of an article, not of the site
            if any(x and x[-1] < headers[-1] for x in map(stack.of_tag.get, _CONTENT)) and not top.told and not top.named:
                top.dropped = False
        inner = tag == "article" and opened
        name = _name(m[3]) if inner or tag not in _WHOLE else ""
        node = Node(tag, _told(m[3]), bool(_NAMES.search(name)), bool(_ROUNDS.search(name)))
        stack.nodes[-1].parts.append(node)
        if tag in _RAW:
            end = _RAW_END[tag].search(html, at)
            node.parts.append(html[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in _VOID and not m[3].endswith("/"):
            stack.push(node)
    return root


def _name(attributes: str) -> str:
    """The classes and the id of an element, the parts of each joined by hyphens."""
    if "=" not in attributes:
        return ""
    return " ".join(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", "".join(values)) for name, *values in _ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id"))


def _told(attributes: str) -> bool:
    """Whether attributes other than class and id say that the element is no main text."""
    if "=" not in attributes and "hidden" not in attributes:
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "role" and value.lower() in _ROLES or name == "aria-hidden" and value.lower() == "true":
            return True
    return re.search(r"(?:^|\s)hidden(?:[\s=/]|$)", attributes, re.I) is not None


def hash_subtrees(root: Node) -> tuple[int, int, dict[int, bool]]:
    """Sets the hash of each subtree that may be template. Gives the hash of the whole page, that of its longest block of
    text, and the hashes with whether they must recur like running text."""
    out: dict[int, bool] = {}
    longest, lead = -1, 0
    # Children come before their parents: nodes are listed parents first, and worked through backwards.
    nodes: list[tuple[Node, bool]] = [(root, False)]
    for node, inside in nodes:
        inside = inside or node.tag in _CONTENT
        nodes.extend((part, inside) for part in node.parts if isinstance(part, Node))
    told: dict[int, tuple[bytes, bytes, int, bool, bool]] = {}
    for node, inside in reversed(nodes):
        exact, shape = hashlib.blake2b(node.tag.encode(), digest_size=8), hashlib.blake2b(node.tag.encode(), digest_size=8)
        links, other, some, own, last = int(node.tag == "a"), False, False, [], b""
        for part in node.parts:
            if isinstance(part, str):
                text = " ".join(part.split())
                if text:
                    exact.update(b"\0" + _DIGITS.sub("0", text).encode("utf-8", "surrogatepass"))
                    own.append(text)
                    some, other = True, other or node.tag != "a"
                continue
            e, f, k, o, t = told.pop(id(part))
            exact.update(b"\1" + e)
            if f != last:  # list items of one kind count once, however many
                shape.update(b"\1" + f)
            last, links, other, some = f, links + k, other or (o and node.tag != "a"), some or t
            if t and part.tag in _INLINE:
                own.append(e.hex())
        if node.tag not in _DROP:
            length = sum(map(len, own))
            if length > longest:
                longest, lead = length, int.from_bytes(hashlib.blake2b("\0".join(own).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        told[id(node)] = exact.digest(), shape.digest(), links, other, some
        node.hash = None
        if some and node.tag in _BLOCK and node.tag not in _WHOLE and (other or links >= LINKS):
            listed = not other and not inside
            node.hash = int.from_bytes(shape.digest() if listed else exact.digest(), "little", signed=True) ^ (1 if inside else 2 if listed else 0)
            out[node.hash] = inside or node.tag in _TEXT
    return int.from_bytes(told[id(root)][0], "little", signed=True), lead, out


def _article(root: Node) -> Node | None:
    """The article with the longest text of the outermost ones, or else the first main element.

    Those inside what goes count only where there are no others, and only if what goes is a form or has a name such as
    banner. What stands in comments, related posts, menus or templates is never the article.
    """
    found: dict[tuple[bool, str], list[Node]] = {}
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        if node is not root and node.template:
            continue
        if node is not root and node.dropped:
            if not node.holds():
                continue
            inside = True
        if node.tag in _CONTENT:
            found.setdefault((inside, node.tag), []).append(node)
            if node.tag == "article":
                continue
        stack.extend((part, inside) for part in reversed(node.parts) if isinstance(part, Node))
    for inside in (False, True):
        if articles := found.get((inside, "article")):
            return articles[0] if len(articles) == 1 else max(articles, key=lambda x: len(_lines(x)))
        if mains := found.get((inside, "main")):
            return mains[0]
    return None


def _blocks(root: Node, lines: list[list[str]]) -> None:
    stack: list[Node | str | None] = [root]
    while stack:
        node = stack.pop()
        if node is None:
            lines.append([])
        elif isinstance(node, str):
            lines[-1].append(node)
        elif node is not root and (node.template or node.dropped):
            lines.append([])
        else:
            if node.tag in _BLOCK:
                lines.append([])
                stack.append(None)
            stack.extend(reversed(node.parts))


def _lines(node: Node) -> str:
    lines: list[list[str]] = [[]]
    _blocks(node, lines)
    texts = (" ".join(unescape("".join(x)).split()) for x in lines)
    return "\n".join(t for t in texts if t)


def text_of(root: Node) -> str:
    """Blocks of the main text of a tree in page order, one a line. A page of which all stands in forms is taken whole."""
    text = _lines(_article(root) or root)
    if text:
        return text
    nodes = [root]
    for node in nodes:
        if node.tag == "form" and not node.told and not node.template:
            node.dropped = node.named
        if node is root or not node.dropped:
            nodes.extend(part for part in node.parts if isinstance(part, Node))
    return _lines(root)


def mark(root: Node, templates: frozenset[int] | set[int]) -> int:
    """Marks the outermost subtrees that are templates, and counts them; the root's hashes must be set."""
    marked, stack = 0, [root]
    while stack:
        node = stack.pop()
        if node.hash is not None and node.hash in templates:
            node.template = True
            marked += 1
        else:
            stack.extend(part for part in node.parts if isinstance(part, Node))
    return marked


def main_text(html: str, templates: frozenset[int] = frozenset()) -> str:
    """The main text of a page, given the hashes of its host's templates."""
    root = parse(html)
    hash_subtrees(root)
    mark(root, templates)
    return text_of(root)


def host_of(url: Column | str) -> Column:
    """The host of a URL in lower case; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][-+.\w]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in chunks(batches, "html"):
        out: dict[str, list] = {"page": [], "host": [], "content": [], "lead": [], "tree": [], "text": []}
        for page, host, html in zip(*(chunk.column(c).to_pylist() for c in ("page", "host", "html")), strict=True):
            content, lead, trees = hash_subtrees(parse(html or ""))
            rows = [(None, False), *trees.items()]
            for name, value in (("page", page), ("host", host), ("content", content), ("lead", lead)):
                out[name] += [value] * len(rows)
            out["tree"] += [tree for tree, _ in rows]
            out["text"] += [text for _, text in rows]
        yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.bool_() if c == "text" else pa.int64()) for c, v in out.items()})


def _rows(pages: DataFrame) -> DataFrame:
    """page, host (both hashed), content, lead, tree, text: a row for each subtree of a page, and one without a tree."""
    own = pages.select(F.xxhash64("page_id", "url", "html").alias("page"), F.xxhash64(host_of("url")).alias("host"), "html")
    return own.mapInArrow(_subtrees, "page long, host long, content long, lead long, tree long, text boolean")


def site_templates(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host (hashed), tree: the subtrees that recur on many different pages of a host.

    Pages with equal markup count once, and pages with an equal longest block of text count once among these. All is
    counted by (host, subtree) with partial sums, so a host with a third of all pages is spread.
    """
    once = _rows(pages).select("host", "tree", "lead", "content", "text").distinct()
    leads = once.groupBy("host", "tree", "lead").agg(F.count("*").alias("n"), F.bool_or("text").alias("text"))
    counted = written(leads.groupBy("host", "tree").agg(F.sum("n").alias("n"), F.count("*").alias("leads"), F.bool_or("text").alias("text")).where(f"n >= {least_pages}"), "subtrees")
    sizes = counted.where("tree IS NULL").select("host", F.col("n").alias("pages"), F.col("leads").alias("all_leads"))
    both = counted.where("tree IS NOT NULL").join(sizes, "host")
    spread = (F.col("leads") >= F.least(F.lit(least_pages), "all_leads")) & ((F.col("n") >= MANY_PAGES) | (F.col("n") >= F.col("pages") * LEAST_SHARE))
    running = (F.col("leads") >= least_pages) & (F.col("leads") >= F.col("all_leads") * TEXT_SHARE)
    return both.where(F.when(F.col("text"), running).otherwise(spread)).select("host", "tree")


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """page_id, url, text (the main text, blocks joined by one line feed) and n_templates (subtrees that went as templates).

    One row for each row of pages; a null or empty html has an empty text, a page without a URL belongs to the empty
    host, repeated rows count once and give repeated results, an empty table gives none. Nesting may be as deep as it
    will. Columns other than page_id, url and html are ignored.
    """
    templates = written(site_templates(pages, least_pages), "templates")
    own = pages.select("page_id", "url", "html", F.xxhash64(host_of("url")).alias("host"), F.xxhash64("page_id", "url", "html").alias("page"))
    if templates.count() <= BROADCAST_ROWS:
        table = templates.toArrow()
        shared = pages.sparkSession.sparkContext.broadcast(np.sort(_key(table.column("host").to_numpy(), table.column("tree").to_numpy())))
        both = own.withColumn("templates", F.lit(None).cast("array<long>"))
    else:
        shared = None
        met = _rows(pages).where("tree IS NOT NULL").select("page", "host", "tree").join(templates, ["host", "tree"])
        both = own.join(met.groupBy("page").agg(F.collect_set("tree").alias("templates")), "page", "left").select(*own.columns, "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "html"):
            roots, trees = [], []
            for html in chunk.column("html").to_pylist():
                root = parse(html or "")
                trees.append(list(hash_subtrees(root)[2]))
                roots.append(root)
            if shared is None:
                found = [set(x or ()) for x in chunk.column("templates").to_pylist()]
            else:
                found = _known(shared.value, chunk.column("host").to_pylist(), trees)
            counts = [mark(root, x) for root, x in zip(roots, found, strict=True)]
            yield pa.RecordBatch.from_arrays([chunk.column("page_id"), chunk.column("url"), pa.array([text_of(x) for x in roots], pa.string()), pa.array(counts, pa.int64())], names=["page_id", "url", "text", "n_templates"])

    return both.mapInArrow(run, T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_templates", T.LongType())]))


def _key(host: np.ndarray, tree: np.ndarray) -> np.ndarray:
    return joined(host.astype(np.int64).view(np.uint64), tree.astype(np.int64).view(np.uint64))


def _known(keys: np.ndarray, hosts: list[int], trees: list[list[int]]) -> list[set[int]]:
    """Of each page's subtrees, those that are templates of its host."""
    host = np.repeat(np.array(hosts, np.int64), [len(x) for x in trees])
    tree = np.array([t for x in trees for t in x], np.int64)
    key = _key(host, tree)
    at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
    hit = keys[at] == key if len(keys) else np.zeros(len(key), bool)
    bounds = np.cumsum([0, *(len(x) for x in trees)])
    return [set(tree[a:b][hit[a:b]].tolist()) for a, b in zip(bounds, bounds[1:])]
