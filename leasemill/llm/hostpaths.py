"""Main text of web pages by consensus paths of their hosts.

1. Every page is parsed into containers and text blocks. Menus, forms, scripts, comments and the like are left out by element, role, and
   words of class and id. A container's score is the text outside links of the blocks that stand in it, half of that of the container
   below it, and so on, more for article elements and telling names. The page votes for its containers near the best, by score.
2. A container's path holds the elements and classes of the containers from the root down to it, numbers generalised; an element without
   a class shows its id, one without either its place among its like. Votes are summed by host and path in Spark; the
   path with most votes is its host's. One odd page doesn't move it.
3. The winning paths come back to the pages, and every page is extracted again: the blocks of all containers on the path. A page
   without such a container takes its own best one.

A host may hold any share of the pages: its votes are summed within tasks first, and the paths of large hosts are broadcast
(``groups.joined``), so their pages stay where they are.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leasemill.llm import groups
from leasemill.llm.store import stored

# Element names of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HEAD = frozenset("base link meta noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article body center div main section td".split())
BLOCKS = CONTAINERS | HEADINGS | frozenset(
    "address aside blockquote caption dd details dialog dl dt fieldset figcaption figure footer form header hgroup hr html legend li "
    "menu nav ol p pre summary table tbody tfoot th thead tr ul".split())
#: When one of these begins, it closes those of the first kind that stand within the nearest of the second.
CELLS, ROWS = frozenset("td th".split()), frozenset("td th tr".split())
SECTIONS = ROWS | frozenset("tbody tfoot thead caption".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "td": (CELLS, {"tr", "table"}), "th": (CELLS, {"tr", "table"}), "tr": (ROWS, {"table"}),
    "tbody": (SECTIONS, {"table"}), "tfoot": (SECTIONS, {"table"}), "thead": (SECTIONS, {"table"}),
}
#: An end tag reaches no element beyond the nearest of these, but for those of the table's own.
SCOPE = frozenset("caption object table td template th".split())
IN_TABLE = SECTIONS | {"table"}

# Elements, roles, and words of class and id that are not the article, and words that name it.
LEFT_OUT = HEAD | RAW | frozenset("aside audio button canvas dialog fieldset footer form head label map menu nav object option select svg video".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
COMMENTS = frozenset("comment comments disqus replies reply respond".split())
NOISE = COMMENTS | frozenset(
    "ad ads adsense adslot advert advertisement advertising adverts alert aside banner breadcrumb breadcrumbs consent cookie cookies copyright "
    "disclaimer follow foot footer form gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices "
    "outbrain overlay pager pagination paywall popular popup promo promoted promotion rail recommended related search share sharing "
    "sidebar sidebars signup social sponsor sponsored subscribe subscription taboola teaser teasers toc toolbar topbar trending "
    "widget widgets".split())
CARDS = COMMENTS | frozenset("ad ads advert promo recommended related sponsored teaser".split())
NEGATED = frozenset("has hide no with without".split())
NAMED = frozenset("article articlebody body content entry main post story".split())

#: Candidates have this share of the best score at least.
NEAR = 0.5
#: A container grows to its parent where containers of its kind, or blocks beside it, add this share of text in blocks half as long or longer.
MORE = 0.2

_TAG = re.compile(
    r"<!--(?:.*?-->|.*)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?:(?P<given>(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)(?P<end>>|\Z)|[^>]*(?:>|\Z))|</[^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NUMBER = re.compile(r"[0-9]+")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in RAW}


class Node:
    """An element of a page. ``own`` is the text outside links of the blocks that it holds and that are in it, ``count`` their number."""

    __slots__ = ("tag", "given", "up", "noise", "link", "titles", "heading", "inside", "holds", "own", "count", "score", "box", "inner", "place", "depth", "_names")

    def __init__(self, tag: str, given: dict[str, str], up: Node | None) -> None:
        self.tag, self.given, self.up = tag, given, up
        self.noise = self.titles = self.holds = False
        self.link = tag == "a" or (up is not None and up.link)
        self.heading = tag in HEADINGS or (up is not None and up.heading)
        self.inside = up is not None and (up.inside or up.tag in ("article", "main"))
        self.own = self.count = self.score = 0
        self.depth = up.depth + 1 if up is not None else 0
        # The container that it is or stands in, and by element the containers that stand in this one.
        self.box: Node = up.box if up is not None and tag not in CONTAINERS else self
        self.inner: dict[str, list[Node]] = {}
        self.place = 0
        if up is not None and self.box is self:
            like = up.box.inner.setdefault(tag, [])
            like.append(self)
            self.place = len(like) if not given else 0
        self._names = None

    @property
    def names(self) -> list[str]:
        """The words of class and id."""
        if self._names is None:
            self._names = [w.lower() for w in _WORD.findall(f"{self.given.get('class', '')} {self.given.get('id', '')}")] if self.given else []
        return self._names

    @property
    def path(self) -> str:
        """The steps of the containers from the root down."""
        steps, node = [], self.box
        while node.up:
            steps.append(node.step)
            node = node.up.box
        return "".join([f">{step}" for step in reversed(steps)])

    @property
    def step(self) -> str:
        """Its kind; for an element without attributes that doesn't name itself also its place among the containers of its element."""
        return f"{self.kind}:{self.place}" if self.place and self.tag not in ("article", "body", "main") else self.kind

    @property
    def kind(self) -> str:
        """Element and classes in order, or element and id, digits as 0."""
        if classes := self.given.get("class", "").split():
            kind = ".".join([self.tag, *sorted({_NUMBER.sub("0", c) for c in classes})])
        else:
            name = self.given.get("id", "").strip()
            kind = f"{self.tag}#{_NUMBER.sub('0', name)}" if name else self.tag
        return kind.replace(">", "_")

    @property
    def is_body_text(self) -> bool:
        return self.tag in ("article", "main") or self.given.get("itemprop") == "articleBody"

    def left_out(self) -> bool:
        """Whether the element's kind, role or names say that it is not the article; ``holds`` speaks for a frame around it."""
        if self.tag in LEFT_OUT:
            return not (self.tag == "form" and self.holds)
        if self.tag == "header":
            return not self.inside
        if not self.given or self.tag == "body":
            return False
        if "hidden" in self.given or self.given.get("aria-hidden") == "true" or _HIDING.search(self.given.get("style", "")):
            return True
        names = self.names
        if self.tag == "article":
            return not CARDS.isdisjoint(names)
        if self.tag in HEADINGS or self.tag == "main":
            return False
        if not COMMENTS.isdisjoint(names):
            return True
        if self.holds:
            return False
        if self.given.get("role", "").lower() in ROLES or "header" in names and not self.inside:
            return True
        return any(w in NOISE and (i == 0 or names[i - 1] not in NEGATED) for i, w in enumerate(names))


def _given(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


class _Reader:
    """Reads a page into nodes and blocks; a block is a list of (innermost element, text)."""

    def __init__(self) -> None:
        self.root = Node("html", {}, None)
        self.nodes, self.open, self.blocks = [self.root], [self.root], []
        self.text: list[tuple[Node, str]] = []
        self.breaks = 0

    def end_block(self) -> None:
        self.breaks = 0
        if self.text:
            self.blocks.append(self.text)
            self.text = []

    def close(self, n: int) -> None:
        if any(node.tag in BLOCKS for node in self.open[n:]):
            self.end_block()
        del self.open[n:]

    def add(self, text: str) -> None:
        if text and not text.isspace():
            self.breaks = 0
            if self.open[-1].tag == "head":
                self.close(len(self.open) - 1)
        if text:
            self.text.append((self.open[-1], html.unescape(text)))

    def line_break(self) -> None:
        """One is white space, a second one right after it ends the block."""
        self.breaks += 1
        if self.breaks > 1:
            self.end_block()
        self.text.append((self.open[-1], " "))

    def end_tag(self, tag: str) -> None:
        if tag == "br":
            return self.line_break()
        same = HEADINGS if tag in HEADINGS else {tag}
        for i in range(len(self.open) - 1, 0, -1):
            at = self.open[i].tag
            if at in same:
                return self.close(i)
            if at == "table" or at in SCOPE and tag not in IN_TABLE or at in BLOCKS and tag not in BLOCKS | LEFT_OUT:
                break
        if tag == "p":
            self.end_block()

    def start_tag(self, tag: str, given: str) -> None:
        if self.open[-1].tag == "head" and tag not in HEAD:
            self.close(len(self.open) - 1)
        if tag == "html" or tag == "body" and any(n.tag == "body" for n in self.open):
            return
        if tag in BLOCKS:
            i = len(self.open) - 1
            while i and self.open[i].tag not in BLOCKS:
                i -= 1
            if self.open[i].tag == "p" or tag in HEADINGS and self.open[i].tag in HEADINGS:
                self.close(i)
        if tag in CLOSES:
            closed, within = CLOSES[tag]
            reach = None
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in closed:
                    reach = i
                elif self.open[i].tag in within or self.open[i].tag in CONTAINERS:
                    break
            if reach:
                self.close(reach)
        elif tag == "a" and self.open[-1].tag == "a":
            self.open.pop()
        if tag == "br":
            return self.line_break()
        if tag in BLOCKS:
            self.end_block()
        if tag not in VOID:
            node = Node(tag, _given(given) if given.strip(" /\n") else {}, self.open[-1])
            self.nodes.append(node)
            if tag not in RAW and not (given.endswith("/") and tag in ("svg", "path")):
                self.open.append(node)

    def read(self, page: str) -> None:
        at = 0
        while m := _TAG.search(page, at):
            self.add(page[at : m.start()])
            at = m.end()
            if m["data"]:
                self.text.append((self.open[-1], m["data"]))
            tag = (m["name"] or "").lower()
            if tag and m["end"] == "":
                break  # the page ends within a tag
            if not tag:
                continue
            if m["close"]:
                self.end_tag(tag)
                continue
            self.start_tag(tag, m["given"] or "")
            if tag in RAW:
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
        self.add(page[at:])
        self.end_block()


def parse(page: str | None) -> tuple[list[Node], list[tuple[Node, str]]]:
    """The elements of a page, and its blocks that may belong to the article, in order: (element that holds the whole block, text).

    Character references are decoded, white space is one blank, blocks without text are left out. Unclosed and stray tags are read
    as browsers do. Elements that are not the article are marked, with all that is in them.
    """
    reader = _Reader()
    reader.read(page or "")
    for node in reversed(reader.nodes):
        if node.up and (node.holds or node.is_body_text and node.tag != "article" or node.tag == "h1" and (node.inside or node.up.tag == "form")):
            node.up.holds = True
    for node in reader.nodes[1:]:
        node.noise = node.up.noise or node.left_out()
        # Of a header within the article, the headings.
        node.titles = node.up.titles or node.inside and (node.tag == "header" or "header" in node.names)
    out = []
    for block in reader.blocks:
        kept = [(n, t) for n, t in block if not n.noise and (n.heading or not n.titles)]
        text = " ".join("".join([t for _, t in kept]).split())
        if not text:
            continue
        holder = kept[0][0]
        for n, _ in kept[1:]:
            while n is not holder:
                n, holder = (n.up, holder) if n.depth > holder.depth else (n, holder.up)
        holder.own += max(0, len(text) - sum(len(t) for n, t in kept if n.link))
        holder.count += 1
        out.append((holder, text))
    return reader.nodes, out


def ranked(nodes: list[Node]) -> list[tuple[Node, float]]:
    """The containers with their scores, best first; the outer one of equals. None without text outside links. Fills ``own`` and ``count``."""
    for node in nodes:
        node.score = node.own
    for node in reversed(nodes):
        if node.up:
            node.up.own += node.own
            node.up.count += node.count
            node.up.score += node.score / 2 if node.box is node else node.score
    out = []
    for node in nodes:
        if node.box is node and node.score:
            factor = 2 if node.is_body_text else 1.25 if not NAMED.isdisjoint(node.names) else 1
            out.append((node, node.score * factor))
    return sorted(out, key=lambda x: (-x[1], x[0].depth))


def whole(best: Node) -> Node:
    """The article that a container is part of: the outermost article element or else main around it; without one, the container
    grows as ``MORE`` says."""
    node, article, main = best, None, None
    while node:
        if node.tag == "main":
            main = node
        elif node.is_body_text:
            article = node
        node = node.up
    if article or main:
        return article or main
    best = best.box
    while best.up and (up := best.up.box).up:
        beside = [n for like in up.inner.values() for n in like if n is not best and n.kind != best.kind]
        more = up.own - best.own - sum(n.own for n in beside)
        blocks = up.count - best.count - sum(n.count for n in beside)
        if not blocks or more < MORE * best.own or more / blocks < best.own / best.count / 2:
            break
        best = up
    return best


def candidates(page: str | None) -> list[tuple[str, int]]:
    """(path, votes) of a page's containers near the best, which has 1,000 votes; none for a page without text."""
    order = ranked(parse(page)[0])
    votes: dict[str, int] = {}
    for node, score in order:
        if score >= NEAR * order[0][1]:
            votes.setdefault(whole(node).path, round(1000 * score / order[0][1]))
    return sorted(votes.items())


def main_text(page: str | None, path: str | None) -> str:
    """The blocks of a page's containers on a path, joined by line feeds; without such a container, those of its own best."""
    nodes, blocks = parse(page)

    def text(chosen: set[int]) -> str:
        inside = set()
        for node in nodes:
            if id(node) in chosen or node.up and id(node.up) in inside:
                inside.add(id(node))
        return "\n".join([t for holder, t in blocks if id(holder) in inside])

    on = _on_path(nodes, path) if path is not None else set()
    if on or not blocks:
        return text(on)
    order = ranked(nodes)
    return text({id(whole(order[0][0]))}) if order else ""


def _on_path(nodes: list[Node], path: str) -> set[int]:
    """The containers on a path that are not left out."""
    steps = path.split(">")[1:]
    reached = {id(nodes[0]): 0}
    for node in nodes[1:]:
        if node.box is node:
            n = reached.get(id(node.up.box))
            if n is not None and n < len(steps) and node.step == steps[n]:
                reached[id(node)] = n + 1
    return {id(n) for n in nodes if reached.get(id(n)) == len(steps) and not n.noise}


#: The host of an address: what stands between its scheme and the port, path, query or fragment.
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host(url: Column) -> Column:
    """The lower-cased host of an address; the empty string where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")))


def votes(page: Column) -> Column:
    """array of struct(path, votes) of a page."""
    kind = pa.list_(pa.struct([("path", pa.string()), ("votes", pa.int64())]))

    @F.arrow_udf("array<struct<path:string,votes:long>>")
    def cast(pages: pa.Array) -> pa.Array:
        return pa.array([[{"path": p, "votes": v} for p, v in candidates(h.as_py())] for h in pages], kind)

    return cast(page)


def winning_paths(pages: DataFrame) -> DataFrame:
    """The stored table (host, n, path): every host, its number of pages, and its path.

    Ties go to the longer path, then to the later one in order. Hosts without any text have no path, nor have pages without a host.
    """
    cast = pages.select(host(F.col("url")).alias("host"), votes(F.col("html")).alias("votes"))
    one = cast.select("host", F.posexplode_outer("votes").alias("at", "vote"))
    by_path = one.groupBy("host", F.col("vote.path").alias("path")).agg(
        F.sum("vote.votes").alias("votes"), F.sum(F.when(F.coalesce("at", F.lit(0)) == 0, 1).otherwise(0)).alias("pages"))
    best = F.max(F.when(F.col("path").isNotNull(), F.struct("votes", F.length("path").alias("length"), "path")))
    winner = by_path.groupBy("host").agg(F.sum("pages").alias("n"), best.alias("best"))
    return stored(winner.select("host", "n", F.when(F.col("host") != "", F.col("best.path")).alias("path")), "host-paths")


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, path and text, one row per row of ``pages(page_id, url, html, ...)``.

    ``path`` is that of the page's host. Null and empty pages have an empty text, pages without a host are read by themselves, repeated
    rows are rows of their own, an empty table gives none; other columns are not looked at.
    """
    given = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    known = groups.joined(given, winning_paths(pages), "host")

    @F.arrow_udf("string")
    def take(htmls: pa.Array, paths: pa.Array) -> pa.Array:
        return pa.array([main_text(h.as_py(), p.as_py()) for h, p in zip(htmls, paths)], pa.string())

    return known.select("page_id", "url", "path", take("html", "path").alias("text"))


def digest(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points), one row per row of pages."""
    return extracted(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
