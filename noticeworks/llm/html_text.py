"""Main text of web pages by composite text density.

A page is cut into tags and text in one pass of a single pattern and hung into a light tree
of elements. Elements that never hold article text (scripts, forms, navigation and the
like, or named so by role, class or id) take no part. Of every other node the number of
characters C and tags T of its subtree are known, and of these the characters LC and tags
LT of links. The composite text density of a node is

    C / T * log(C / LC * T / LT)  to base  ln(C / (C - LC) * LC + LCb / Cb * C + e)

with b for the body and 1 in place of a zero divisor: characters per tag, less the more of
them are links. A run of text between two block tags is a node of its own, so that tags
inside a line (bold, breaks) cost nothing. The sum of the densities of a node's children
tells how much of it is running text; the subtree with the greatest sum is the article's
core, the outermost of equal ones. The least density on the path from there to the body is
the page's threshold. Beside that path, from the nearest article or main element with a
heading (or the body) down, siblings whose density reaches the threshold belong to the
article too, and so do headings, plain blocks of text below the body, and all that an
article element holds, unless more than half of it is links. Inside the chosen subtrees all
text stays.

Blocks follow in page order with an empty line between them; character references are
decoded, and white space inside a block is one space.

Defined cases: a null, empty or textless page gives an empty text; markup that breaks off
swallows what belongs to it and no more; an end tag without a start is ignored; repeated
rows are read each by itself; nesting and length of a page are not limited; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame

from noticeworks.llm.common import blocks

#: Bytes of pages that are worked on at once.
PAGES = 1 << 20

# Every alternative takes at least one character and never fails late, so a page is read once.
_MARKUP = re.compile(
    r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<rest>(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)"
    r"|[!?/][^>]*+>?)",
    re.S,
)
_NAMES = re.compile(r"""(?:^|[\s"'/])(?:class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Words of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content that holds no markup up to its own end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements inside a line, with those that show nothing or stand in a line like a word.
INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big br button canvas cite code data datalist del dfn em embed font i iframe img input ins kbd "
    "label map mark math noembed noframes noscript object option output q rp rt ruby s samp script select small span strike strong "
    "style sub sup svg template textarea time title tt u var video wbr".split()
)
#: Elements that may stand before the body.
BEFORE_BODY = frozenset("head title meta link script style base noscript template".split())
#: Blocks that hold text, not other blocks with a meaning of their own.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure address".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are left open when the next one of their kind begins, and what they stay inside of.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "thead": (("thead", "tbody", "tfoot"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
    "option": (("option",), ("select", "datalist")),
}

#: Elements without article text.
NEVER = frozenset(
    "head script style noscript template nav footer aside button select option datalist textarea input iframe object embed "
    "svg math canvas audio video map dialog menu noembed noframes xmp title".split()
)
#: Words in a role, class or id that tell the same.
NEVER_NAMED = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar navigation nav navbar "
    "menu breadcrumb breadcrumbs pagination pager footer masthead comment comments reply replies disqus respond cookie cookies "
    "consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations toolbar search complementary contentinfo notice notices alert skip".split()
)
#: Words beside these that tell of the page's make-up, not of the element.
LAYOUT = frozenset("has with without no open closed main article".split())
#: Elements that these words can't take out.
ALWAYS = frozenset("html body article main".split())


class Node:
    __slots__ = ("name", "parent", "children", "text", "chars", "tags", "link_chars", "link_tags", "density", "sum", "headings", "inside", "dropped")

    def __init__(self, name: str, parent: Node | None):
        self.name, self.parent = name, parent
        self.children: list[Node] = []
        self.text = ""
        self.chars = self.tags = self.link_chars = self.link_tags = self.headings = 0
        self.density = self.sum = 0.0
        self.inside = name in ("article", "main") or (parent is not None and parent.inside)
        self.dropped = False


def named_out(name: str, rest: str, inside: bool) -> bool:
    """Whether an element's role, class or id tells that it holds no article text."""
    if name in ALWAYS or "=" not in rest:
        return False
    for found in _NAMES.findall(rest):
        for token in "".join(found).split():
            words = [word.lower() for word in _WORDS.findall(token)]
            wanted = NEVER_NAMED if inside else NEVER_NAMED | {"header"}
            if not wanted.isdisjoint(words) and LAYOUT.isdisjoint(words) and words[0] != "content":
                return True
    return False


class Tree:
    """Builds the nodes of one page, parents before children. A node without a name is a run of text between two block tags."""

    def __init__(self):
        self.root = Node("html", None)
        self.nodes = [self.root]
        # Open elements: name, the node that takes their text, whether nothing in them counts.
        self.open: list[tuple[str, Node, bool]] = [("html", self.root, False)]
        self.places: dict[str, list[int]] = {}
        self.line: list[tuple[str, bool]] = []  # pieces of the run so far, and whether a link holds them
        self.silent = 0  # open elements in which nothing counts
        self.silent_from = 0

    def text(self, piece: str) -> None:
        if piece and not self.silent:
            self.line.append((unescape(piece) if "&" in piece else piece, bool(self.places.get("a"))))

    def flush(self, node: Node) -> None:
        """Ends a run of text; runs of white space are nothing."""
        whole = " ".join("".join(piece for piece, _ in self.line).split())
        if whole:
            leaf = Node("", node)
            leaf.text, leaf.chars = whole, len(whole)
            linked = [piece for piece, link in self.line if link]
            leaf.link_chars = min(len(whole), sum(len(" ".join(piece.split())) for piece in linked))
            leaf.link_tags = len(linked)
            node.children.append(leaf)
            self.nodes.append(leaf)
        self.line = []

    def last(self, names) -> int:
        return max((self.places[name][-1] for name in names if self.places.get(name)), default=-1)

    def close_to(self, depth: int) -> None:
        """Closes all open elements from this depth on."""
        while len(self.open) > depth:
            name, node, silent = self.open.pop()
            if name not in INLINE and not self.silent:
                self.flush(node)
            self.places[name].pop()
            self.silent -= silent

    def start(self, name: str, rest: str) -> None:
        if self.places.get("head") and name not in BEFORE_BODY:
            self.close_to(self.places["head"][-1])
        line = name in INLINE
        if not line:
            # What stands open outside of a silent element is left as it is.
            least = self.silent_from if self.silent else 0
            if self.places.get("p") and self.places["p"][-1] > least:
                self.close_to(self.places["p"][-1])
            if name in SIBLINGS:
                own, bounds = SIBLINGS[name]
                place = self.last(own)
                if place > max(self.last(bounds), least):
                    self.close_to(place)
            if not self.silent:
                self.flush(self.open[-1][1])
        elif name == "br" and not self.silent:
            self.line.append((" ", False))
        if name in VOID:
            return
        parent = node = self.open[-1][1]
        silent = False
        if not self.silent:
            out = named_out(name, rest, parent.inside)
            silent = name in NEVER or (name == "header" and not parent.inside) or (line and out)
            if not line and not silent:
                node = Node(name, parent)
                node.dropped = out or name == "form"
                parent.children.append(node)
                self.nodes.append(node)
                if name in ("article", "main", "h1"):
                    self.frame(node, name == "main")
            if silent:
                self.silent_from = len(self.open)
        self.silent += silent
        self.places.setdefault(name, []).append(len(self.open))
        self.open.append((name, node, silent))

    def frame(self, node: Node, whole: bool) -> None:
        """A form around an article is the frame of a page, and so is whatever lies around a main element."""
        place = (self.places.get("form") or [0])[-1]
        if place:
            self.open[place][1].dropped = False
        while whole and node is not None:
            node.dropped, node = False, node.parent

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", "")
        elif self.places.get(name):
            self.close_to(self.places[name][-1])

    def finish(self) -> None:
        self.close_to(1)
        self.flush(self.root)
        for node in self.nodes[1:]:
            node.dropped = node.dropped or node.parent.dropped
        self.nodes = [node for node in self.nodes if not node.dropped]


def parse(html: str) -> Tree:
    tree, place, size = Tree(), 0, len(html)
    while place < size:
        found = _MARKUP.search(html, place)
        if not found:
            tree.text(html[place:])
            break
        tree.text(html[place : found.start()])
        place = found.end()
        name = found["name"]
        if name is None:
            continue
        name = name.lower()
        if found["end"]:
            tree.end(name)
            continue
        if name in ("html", "body"):
            if tree.places.get("head"):
                tree.end("head")
            continue  # the page itself; its attributes decide nothing
        tree.start(name, found["rest"])
        if name in RAW:
            closing = re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I).search(html, place)
            place = closing.end() if closing else size
            tree.end(name)
    tree.finish()
    return tree


def weigh(tree: Tree) -> None:
    """Characters, tags, density and sum of densities of every node, from the leaves up."""
    for node in reversed(tree.nodes):
        node.tags += bool(node.name)
        node.headings += node.name in HEADINGS
        if node.parent is not None:
            for count in ("chars", "tags", "link_chars", "link_tags", "headings"):
                setattr(node.parent, count, getattr(node.parent, count) + getattr(node, count))
    share = tree.root.link_chars / max(tree.root.chars, 1)
    for node in tree.nodes:
        if not node.chars:
            continue
        chars, links = node.chars, node.link_chars
        tags = max(node.tags, 1)
        base = log(chars / max(chars - links, 1) * links + share * chars + e)
        node.density = chars / tags * max(0.0, log(chars / max(links, 1) * tags / max(node.link_tags, 1)) / base)
        if node.parent is not None:
            node.parent.sum += node.density


def main_nodes(tree: Tree) -> list[Node]:
    """The subtrees of the article, in page order."""
    weigh(tree)
    best = max(tree.nodes, key=lambda node: node.sum)
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(node.density for node in path)
    framed = [place for place, node in enumerate(path) if node.name in ("article", "main")]
    top = next((place for place in framed if path[place].headings), framed[0] if framed else len(path) - 1)
    chosen = {id(best)}
    for above, below in zip(path[1 : top + 1], path):
        for node in above.children:
            if node is below or node.dropped or 2 * node.link_chars > node.chars:
                continue
            within = above.name == "article" or (above.parent is not None and node.name in TEXT_BLOCKS)
            if within or node.name in HEADINGS or node.density >= threshold:
                chosen.add(id(node))
    return [node for node in tree.nodes if id(node) in chosen]


def main_text(html: str | None) -> str:
    """The blocks of a page's article, an empty line between them."""
    tree = parse(html or "")
    found, stack = [], main_nodes(tree)[::-1]
    while stack:
        node = stack.pop()
        if node.text:
            found.append(node.text)
        stack.extend(child for child in reversed(node.children) if not child.dropped)
    return "\n\n".join(found)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every page."""

    def run(batches):
        for block in blocks(batches, "html", PAGES):
            texts = [main_text(html) for html in block.column(2).to_pylist()]
            yield pa.record_batch(
                [block.column(0), block.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.selectExpr("cast(page_id as bigint) as page_id", "url", "html")
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
