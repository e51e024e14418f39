"""HTML extraction: containers scored on each page, paths voted on by host, pages extracted again by the winners."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body caption html legend option tbody td tfoot th thead tr".split())
#: Elements that a new one of the same group ends, up to the element that holds the group.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}
#: Parts of a page that are not its text, by element and by role.
LEFT_OUT = frozenset("nav footer header aside form script style title noscript template iframe object svg canvas button select textarea input label dialog menu head video audio map".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
#: Words of a class or id that name such parts. A name counts if all its words are of these or of the next two lists, so
#: "share-buttons" does and "share-price-analysis" doesn't.
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promos promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup popup popover modal overlay nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer copyright comment comments commentlist disqus reply replies respond discussion share sharing social related recommended recommendations pagination pager toolbar login form search skip".split()
)
#: Those that an article has parts of, too: they count outside an article or main element only.
HEADS = frozenset("header head masthead foot legal rail".split())
#: Words that say nothing beside those.
PLAIN = frozenset("a all area bar block body bottom box btn button buttons by col column container content desktop element for global group holder icon icons id inline inner item items js label large layer left link links list listing main media message mobile module my new no outer page panel posts primary right row secondary section site slot small sticky strip text the title tool tools top unit user view website widget wrap wrapper zone".split())
ARTICLES = ("article", "main")
#: Elements that can hold an article.
CONTAINERS = frozenset("article main section div td body blockquote center".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>?|[^<]+|<""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPLIT = re.compile(r"[^a-z]+")
#: White space of HTML beside the no-break space, which reads as a space too.
SPACE = re.compile(r"[\s ]+")


class Node:
    """An element; ``name`` is its generalised tag and classes, ``path`` the digest of the names from the root to it."""

    __slots__ = ("children", "home", "inside", "name", "out", "parent", "path", "tag", "upper")

    def __init__(self, tag: str, name: str, parent: Node | None, out: bool):
        self.tag, self.name, self.parent, self.out = tag, name, parent, out
        self.inside = parent is not None and (parent.inside or parent.tag in ARTICLES)
        self.children: list = []  # nodes and texts
        self.path = "" if parent is None else blake2b(f"{parent.path}/{name}".encode("utf-8", "replace"), digest_size=16).hexdigest()
        # the nearest container above, and the nearest article here or above: scores climb by these
        self.upper = None if parent is None else parent if parent.tag in CONTAINERS else parent.upper
        self.home = self if tag in ARTICLES else None if parent is None else parent.home


#: Only these attributes matter here.
USED = re.compile("class|id|role|hidden|style", re.IGNORECASE)


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


@lru_cache(20_000)
def _kind(tag: str, text: str, inside: bool) -> tuple[str, bool]:
    """The generalised name of a start tag, and whether it is left out, ``inside`` an article or outside."""
    attrs = _attributes(text)
    return _generalised(tag, attrs), _left_out(tag, attrs, inside)


def _named_so(name: str, inside: bool) -> bool:
    words = [w for w in SPLIT.split(name) if w]
    telling = WORDS if inside else WORDS | HEADS
    return not telling.isdisjoint(words) and all(w in telling or w in PLAIN for w in words)


def _left_out(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    if tag in ("html", "body"):
        return False
    names = [x.lower() for x in (*attrs.get("class", "").split(), attrs.get("id", ""))]
    if tag == "header" and (inside or any(re.search(r"(?:^|[^a-z])(?:article|entry|post|story)(?:[^a-z]|$)", x) for x in names)):
        tag = "div"  # the article's own heading
    if tag in LEFT_OUT or attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return True
    return tag not in ("article", "main") and any(_named_so(x, inside) for x in names)


def _generalised(tag: str, attrs: dict[str, str]) -> str:
    """The tag and its classes without digits, sorted: pages of one template agree on it."""
    return ".".join([tag, *sorted({re.sub(r"[0-9]+", "", c) for c in attrs.get("class", "").lower().split()} - {""})])


class _Open:
    """The elements open at a point of the page, and at which heights those of each tag stand."""

    def __init__(self, root: Node):
        self.stack, self.at, self.blocks = [root], {}, []

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def cut(self, height: int) -> None:
        """Closes everything from ``height`` up."""
        while len(self.stack) > height:
            tag = self.stack.pop().tag
            self.at[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def block(self) -> int:
        """The height of the last open block."""
        return self.blocks[-1] if self.blocks else 0

    def last(self, tags) -> int:
        """The height of the last open element of these tags; 0, the root's, if none is."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def first(self, tags, above: int) -> int | None:
        """The lowest open element of these tags higher than ``above``."""
        places = ((held, bisect_right(held, above)) for held in (self.at.get(t, ()) for t in tags))
        return min((held[k] for held, k in places if k < len(held)), default=None)


def parse(source: str) -> Node:
    """The element tree, by the rules of HTML that ordinary pages need: void and raw elements, implied end tags.

    A tag finds the element that it closes by the heights of open tags, so a page takes time in proportion to its length,
    however deep it is nested and however many tags have no partner.
    """
    root = Node("", "", None, False)
    open_ = _Open(root)
    at, size = 0, len(source)
    while at < size:
        m = TOKEN.match(source, at)
        at = m.end()
        first, node = source[m.start()], open_.stack[-1]
        if first != "<":
            node.children.append(html.unescape(m[0]) if "&" in m[0] else m[0])
        elif m[3] is None:
            if m[1] is not None:
                node.children.append(m[1])
            elif m[0] == "<":
                node.children.append("<")
        elif m[2]:
            tag = m[3].lower()
            height = open_.last((tag,))
            fence = 0 if tag in ("html", "body", "table") else open_.last(("table", "body"))
            if height > fence:
                open_.cut(height)
        else:
            tag = m[3].lower()
            if tag in CLOSES_P:
                paragraph = open_.last(("p",))
                if paragraph and paragraph == open_.block():
                    open_.cut(paragraph)
            if tag in ENDS:
                group, fence = ENDS[tag]
                ended = open_.first(group, open_.last(fence))
                if ended is not None:
                    open_.cut(ended)
            node = open_.stack[-1]
            name, out = _kind(tag, m[4] if USED.search(m[4]) else "", node.inside or node.tag in ARTICLES)
            new = Node(tag, name, node, out)
            node.children.append(new)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(source, at)
                at = end.end() if end else size
            elif tag not in VOID:
                open_.push(new)
    return root


def _blocks(node: Node) -> list[str]:
    """Texts of the blocks below ``node`` in page order, white space made one space."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", "".join(run)).strip(" ")
        run.clear()
        if text:
            out.append(text)

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif not x.out:
            if x.tag == "br":
                run.append(" ")
            elif x.tag in BLOCK:
                flush()
                todo.append(None)
            todo.extend(reversed(x.children))
    flush()
    return out


def _own(root: Node) -> dict[int, list[int]]:
    """For each element not left out: code points of text in it that no block stands between, and how many of links.

    An element's inline children hand theirs up, in one pass from the last element to the first.
    """
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.out:
            order.append(node)
            todo.extend(c for c in node.children if isinstance(c, Node))
    sums: dict[int, list[int]] = {}
    for node in reversed(order):
        own = linked = 0
        for c in node.children:
            if isinstance(c, str):
                own += len(c.strip())
            elif not c.out and c.tag not in BLOCK:
                x, y = sums[id(c)]
                own, linked = own + x, linked + y
                if c.tag == "a":
                    linked += sum(len(t) for t in c.children if isinstance(t, str))
        sums[id(node)] = [own, linked]
    return sums


def containers(root: Node) -> list[tuple[Node, float]]:
    """Elements that can hold an article, in page order, with scores: their paragraphs' text, half of it one level up
    (as for the next levels), less the text of links. The innermost article or main element about a paragraph has all of
    it and half as much again, however deep the paragraph lies. A share ends where it falls below one code point, so
    each paragraph climbs as many containers as its length has bits."""
    score: dict[int, float] = {}
    order: list[Node] = []
    sums = _own(root)
    todo = [root]
    while todo:
        node = todo.pop()
        if node.out:
            continue
        if node.tag in CONTAINERS:
            order.append(node)
        own, linked = sums[id(node)]
        if own:
            full = share = float(max(0, own - 2 * linked))
            home = node.home
            if home is not None:
                score[id(home)] = score.get(id(home), 0.0) + 1.5 * full
            up = node if node.tag in CONTAINERS else node.upper
            while up is not None and share >= 1:
                if up is not home:
                    score[id(up)] = score.get(id(up), 0.0) + share
                share /= 2
                up = up.upper
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return [(n, score.get(id(n), 0.0)) for n in order]


def host(url: Column) -> Column:
    """The host that a URL names, lower case, without www; empty where it names none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^:/?#]*)", 1)), r"^www\.", "")


def _at(root: Node, path: str) -> list[Node]:
    """Elements not left out whose generalised path has this digest, in page order; all lie equally deep."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.out:
            continue
        if node.path == path:
            found.append(node)
        else:
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return found


def extract(source: str, path: str | None) -> str:
    """The page's text from all containers of the path with this digest; without one, from its own best container."""
    root = parse(source)
    texts = [b for n in _at(root, path) for b in _blocks(n)] if path else []
    if not texts:
        best = max(containers(root), key=lambda x: x[1], default=None)
        texts = _blocks(best[0] if best and best[1] > 0 else root)
    return "\n".join(texts)


VOTES = "host string, path string, votes double, pages long"
#: Parts that the pages of one host are dealt in when they meet its winning path.
PARTS = 16


def votes(pages: DataFrame) -> DataFrame:
    """Votes for paths by ``host``: each page divides one vote among its containers in proportion to their scores.

    A path is sent as a digest of 32 characters, however deep it is.
    """

    def run(batches):
        tally: dict[tuple[str, str], list] = {}

        def flush():
            rows = [(*k, *v) for k, v in tally.items()]
            tally.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.float64(), pa.int64()), strict=True)], names=["host", "path", "votes", "pages"])

        for batch in batches:
            for name, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                scored = [(s, n.path) for n, s in containers(parse(source or "")) if s > 0]
                total, own = sum(s for s, _ in scored), {}
                for s, path in scored:
                    own[path] = own.get(path, 0.0) + s / total
                for path, share in own.items():
                    held = tally.setdefault((name, path), [0.0, 0])
                    held[0] += share
                    held[1] += 1
                if len(tally) > 50_000:
                    yield flush()
        if tally:
            yield flush()

    counted = pages.select("host", "html").mapInArrow(run, VOTES)
    return counted.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("pages").alias("pages"))


def winners(pages: DataFrame) -> DataFrame:
    """The winning path of each host: most votes, then the first by digest."""
    order = Window.partitionBy("host").orderBy(F.desc(F.round("votes", 6)), "path")
    return votes(pages).withColumn("place", F.row_number().over(order)).where("place = 1").select("host", "path")


def extract_pages(pages: DataFrame) -> DataFrame:
    """Main text of each page: page_id, url, text.

    A null or empty html gives an empty text; a null url counts to the host of no name; repeated rows give their text
    each; very long and very deep pages take time and memory in proportion to their length; a null page_id stays null; paths with equal votes go by their digests; an empty table gives an empty one;
    further columns are left out, whatever their names. Pages meet their host's path in a join, those of one host in
    several parts, so a host with a third of all pages is no single task.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    pages = common.spread(pages).withColumn("host", host(F.col("url")))
    won = common.written(winners(pages)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    pages = pages.withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.lit(PARTS)).cast("int")).join(won, ["host", "part"], "left")

    def run(batches):
        for batch in batches:
            texts = [extract(s or "", p) for s, p in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select("page_id", "url", "html", "path").mapInArrow(run, "page_id long, url string, text string")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; nulls, ties, repeats and empty tables as in ``extract_pages``."""
    return extract_pages(common.table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
