"""Main text of web pages by tree scoring.

Each page is parsed into a tree inside its row. Paragraphs pass points for their length and commas to
their ancestors (all to the parent, half to the next, a quarter to the one above, ...), discounted by the share of
their text inside links. The best container is kept together with those of its siblings that score
well or read like prose. Menus, scripts, adverts and the like are left out by tag or by class. An element that only its name, or being a
form, speaks against stays if it holds the page's article: an article or main element, or most of the page's prose.

No shuffle: one pass over the pages in Arrow batches.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# Elements of HTML by what they mean for reading
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
LEFT_OUT = {"nav", "footer", "aside", "head", "button", "select", "template", "svg", "menu", "dialog", "object", "canvas", "datalist"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "body", "html", "article", "div", "section", "main"}
_BAD = (
    r"(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|masthead|menu|modal|nav|navbar|navigation|"
    r"newsletter|notice|popup|promo\w*|related|replies|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget|complementary|contentinfo)"
)
_PARTS = r"(?:area|articles|bar|block|bottom|box|buttons?|col|column|container|form|global|icons|inner|item|items|left|links|list|main|overlay|page|posts|primary|right|secondary|section|site|slot|stories|thread|top|unit|wrap|wrapper|\d+)"
#: A class, id or role that is a bad word, or one together with parts of a layout; "has-sidebar" or "related-work" is none.
BAD_NAME = re.compile(rf"(?:^|\s)(?:{_PARTS}[-_]+)*{_BAD}(?:[-_]+(?:{_PARTS}|{_BAD}))*(?:$|\s)", re.I)
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|replies)(?:$|[\s_-])", re.I)
GOOD_NAME = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|story|text)(?:$|[\s_-])", re.I)
PRIOR = {"article": 25.0, "main": 20.0, "section": 3.0, "div": 5.0, "td": 3.0, "blockquote": 3.0, "pre": 3.0, "ul": -3.0, "ol": -3.0, "header": -5.0}


class _Node:
    __slots__ = ("tag", "parent", "skip", "link", "prior", "own", "score", "chars", "link_chars", "first", "last", "suspect", "free", "within", "holds")

    def __init__(self, tag: str, parent: "_Node | None", skip: bool, prior: float):
        self.tag, self.parent, self.skip, self.prior = tag, parent, skip, prior
        self.link = tag == "a" or (parent is not None and parent.link)
        self.own = self.score = 0.0  # points given here, and with those passed up from below
        self.chars, self.link_chars = 0, 0
        self.first = self.last = -1  # range of blocks inside
        self.suspect = ""  # the name that speaks against it
        self.free = 0  # characters of prose under no other suspect below
        self.within = parent.within if parent is not None else None  # the innermost suspect around it
        self.holds = False  # an article or main element below

    def take(self, chars: int, linked: int, first: int, last: int) -> None:
        self.chars += chars
        self.link_chars += linked
        self.first = first if self.first < 0 else self.first
        self.last = last


class _Stack:
    """The open elements, with the places of each tag and of blocks, so no step looks through the whole stack.

    An element gives its sums to its parent when it closes.
    """

    def __init__(self, root: _Node):
        self.open, self.at, self.blocks = [root], {root.tag: [0]}, [0]

    def push(self, node: _Node) -> None:
        k = len(self.open)
        self.open.append(node)
        self.at.setdefault(node.tag, []).append(k)
        if node.tag in BLOCK:
            self.blocks.append(k)

    def close(self, k: int) -> None:
        while len(self.open) > k:
            node = self.open.pop()
            self.at[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()
            if node.first >= 0:
                node.parent.take(node.chars, node.link_chars, node.first, node.last)

    def last(self, tags) -> int:
        """The place of the innermost open element of the tags, -1 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)


def _parse(page: str, dropped: frozenset[int] = frozenset()) -> tuple[list[_Node], list[tuple[_Node, str, int]]]:
    """All elements, and in page order the text blocks with the block element that holds them and the characters inside links.

    ``dropped`` has the places in the list of elements whose text is left out; the list is the same with any.
    """
    root = _Node("html", None, False, 0.0)
    nodes, blocks = [root], []
    stack = _Stack(root)
    text: list[tuple[str, bool]] = []

    def flush() -> None:
        if text:
            whole = " ".join("".join(t for t, _ in text).split())
            if whole:
                node = stack.open[stack.blocks[-1]]
                linked = min(len(" ".join("".join(t for t, in_link in text if in_link).split())), len(whole))
                # inline elements around the text close later and hold nothing of their own
                node.take(len(whole), linked, len(blocks), len(blocks))
                blocks.append((node, whole, linked))
            text.clear()

    def say(piece: str) -> None:
        if piece and not stack.open[-1].skip:
            text.append((html.unescape(piece) if "&" in piece else piece, stack.open[-1].link))

    at, n = 0, len(page)
    while at < n:
        found = TAG.search(page, at)
        if found is None:
            say(page[at:])
            break
        say(page[at : found.start()])
        at = found.end()
        name = found[2]
        if name is None:
            if found[0].startswith("<![CDATA["):
                say(found[0][9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if found[1]:
            if name == "br":
                text.append((" ", False))
                continue
            k = stack.last((name,))
            # an inline end tag doesn't close blocks
            if k > 0 and (name in BLOCK or k > stack.blocks[-1]):
                if stack.blocks[-1] >= k:
                    flush()
                stack.close(k)
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif not stack.open[-1].skip:
                text.append((" " if name == "br" else "", False))
            continue
        if name in BLOCK:
            flush()
            if name in CLOSES_P and stack.open[stack.blocks[-1]].tag == "p":
                stack.close(stack.blocks[-1])
            k = stack.last(SELF_CLOSING.get(name, ()))
            if k > 0 and k > stack.last(SCOPE):
                stack.close(k)
        parent = stack.open[-1]
        skip, prior, suspect = parent.skip or name in LEFT_OUT or len(nodes) in dropped, PRIOR.get(name, 0.0), "form" if name == "form" else ""
        if found[3] and not skip:
            words = " ".join(a or b or c for a, b, c in NAMED.findall(found[3]))
            if words:
                if BAD_NAME.search(words) and name not in ("body", "html", "article", "main"):
                    suspect = words
                elif GOOD_NAME.search(words):
                    prior += 10.0
        if name == "label" and stack.last(("form",)) > 0:
            skip = True
        # a header outside an article belongs to the page
        if name == "header" and stack.last(("article", "main")) < 0:
            skip = True
        node = _Node(name, parent, skip, prior)
        if suspect and not skip:
            node.suspect, node.within = suspect, node
        nodes.append(node)
        if not found[3].rstrip().endswith("/") or name in BLOCK or name == "a":
            stack.push(node)
    flush()
    stack.close(1)
    return nodes, blocks


#: Prose under which a suspect element is no page's article, and how many times the prose outside it has to be.
LEAST_ARTICLE, TIMES_OUTSIDE = 250, 4


def _read(page: str) -> tuple[list[_Node], list[tuple[_Node, str, int]]]:
    """What :func:`_parse` gives without the suspect elements that don't hold the article.

    A suspect element stays if an article or main element is below it, or if its prose is several times that of all the page outside suspect
    elements. A list of comments stays only where there is hardly anything else.
    """
    nodes, blocks = _parse(page)
    if not any(n.suspect for n in nodes):
        return nodes, blocks
    for node in reversed(nodes):
        if node.parent is not None and (node.holds or node.tag in ("article", "main")) and not node.skip:
            node.parent.holds = True
    outside = 0
    for node, whole, linked in blocks:
        if node.within is None:
            outside += len(whole) - linked
        else:
            node.within.free += len(whole) - linked
    dropped: set[int] = set()
    gone: set[int] = set()
    for k, node in enumerate(nodes):
        if node.parent is not None and id(node.parent) in gone:
            gone.add(id(node))
        elif node.suspect:
            prose = node.chars - node.link_chars
            around = prose >= LEAST_ARTICLE and outside * TIMES_OUTSIDE < prose and (not COMMENTS.search(node.suspect) or outside < 40)
            if node.holds or around:
                outside += node.free
            else:
                dropped.add(k)
                gone.add(id(node))
    return _parse(page, frozenset(dropped)) if dropped else (nodes, blocks)


#: Blocks whose points go to their parent first.
_PASSED_UP = ("p", "pre", "li", "h1", "h2", "h3", "h4", "h5", "h6")


def extract(page: str | None) -> str:
    """The article's text: white space folded, blocks in page order joined by one space; empty if none.

    Of containers of equal score the outermost that stands first is the best one. A sibling of the best container is
    kept if it scores a fifth of it, or reads like prose, or is a heading. Time grows with the page's length, however deep it is nested.
    """
    if not page:
        return ""
    nodes, blocks = _read(page)
    if not blocks:
        return ""
    linked = lambda x: x.link_chars / x.chars if x.chars else 0.0
    for node, whole, _ in blocks:
        density = linked(node) if node.tag == "p" or node.chars == len(whole) else 0.0
        points = (1 + whole.count(",") + whole.count("، ") + min(len(whole) / 100, 3.0)) * (1 - density)
        (node.parent if node.tag in _PASSED_UP and node.parent else node).own += points
    # children stand after their parents, so from the end each has all of its points before it passes half of them up
    for node in reversed(nodes):
        node.score += node.own
        if node.parent is not None:
            node.parent.score += node.score / 2
    scored = [node for node in nodes if node.score > 0]
    for node in scored:
        node.score += node.prior
    best = max(scored, key=lambda x: x.score * (1 - linked(x)), default=None)
    if best is None:  # everything stands inside links
        return ""
    keep = [(best.first, best.last)]
    if best.parent is not None:
        good = max(10.0, 0.2 * best.score)
        for node in nodes:
            if node.parent is best.parent and node is not best and node.first >= 0:
                prose = node.chars > 80 and linked(node) < 0.25 or node.tag == "p" and node.chars <= 80 and not node.link_chars
                heading = node.tag in ("h1", "h2", "h3") and not node.link_chars
                if node.score * (1 - linked(node)) >= good or prose or heading:
                    keep.append((node.first, node.last))
    wanted = sorted({i for a, b in keep for i in range(a, b + 1)})
    return " ".join(blocks[i][1] for i in wanted)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(p) for p in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            [*batch.schema.names[1:], "text", "n_chars"],
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """``pages`` with html replaced by text and n_chars (code points); other columns stay, but for those two names.

    Null or empty html, or a page without text, gives an empty text. Rows are kept one to one.
    """
    rest = [f for f in pages.schema.fields if f.name not in ("html", "text", "n_chars")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + ["text string", "n_chars long"])
    return pages.select("html", *[f.name for f in rest]).mapInArrow(_run, schema)
