"""Main text of HTML pages by scoring the element tree (operator 9).

A page is parsed into a tree (tags that HTML leaves open are closed as browsers
do). Elements that are never article text by their tag, role or name are cut out.
Every remaining paragraph earns points for its length and commas and passes them to
its ancestors, in full to the parent and less with each level; an element's score is
its points times its share of text outside links. The best element is the container
(or the article or main element around it, or the elements that hold no other text);
of its siblings those with text are kept with it unless a third of it is links, and a
heading before it.

Blocks are the texts between block-level tags, character references decoded,
white space turned into one space, trimmed, joined by line ends in page order.

Defined cases: a null or empty page, and a page without text, give an empty text;
repeated rows give a row each; an empty table gives no rows; columns other than id,
URL and HTML are never looked at. The whole page is parsed, however long.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT_SCHEMA = "page_id long, url string, text string, n_chars long"

# Fixed by HTML: elements without content, with raw content, and block-level ones.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt "
                  "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend "
                  "li main menu nav ol option p pre search section summary table tbody td tfoot th thead "
                  "tr ul".split())
#: A start tag that ends open elements of these kinds, up to the nearest of the others.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}),
        "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "option": ({"option"}, {"select"})}
#: Elements that are no article text.
CUT = frozenset("head script style noscript template textarea title nav footer aside form button select "
                "input iframe svg canvas object audio video dialog menu search xmp noembed noframes".split())
CUT_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert form menu menubar "
                      "toolbar".split())
#: Words of class and id names that mark menus, notices, adverts, sidebars and comments.
CUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs comment "
    "comments commentlist consent cookie cookies disqus footer gdpr header login masthead menu menus modal "
    "nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup "
    "promo promoted promotion related replies respond share sharing shoutbox sidebar signup skip social "
    "sponsor sponsored subscribe subscription toc toolbar topbar widget widgets".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd h2 h3 h4 h5 h6 figcaption".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_UNCLOSED = re.compile(r"<!--.*|<!\[CDATA\[.*", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "parent", "children", "cut", "points", "length", "linked")

    def __init__(self, tag: str, parent: Node | None, cut: bool = False) -> None:
        self.tag, self.parent, self.cut = tag, parent, cut
        self.children: list[Node | str] = []
        self.points = 0.0
        self.length = self.linked = 0


def _is_cut(tag: str, attributes: str, inside: Node) -> bool:
    if tag in CUT:
        return True
    if tag == "header":     # the site's, not an article's own
        return not _within(inside, ("article", "main"))
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            return True
        if name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.lower() in CUT_ROLES:
            return True
        if name in ("class", "id") and not CUT_WORDS.isdisjoint(
                w.lower() for w in _NAME_WORDS.findall(value)):
            return True
    return False


def _within(node: Node | None, tags: tuple[str, ...]) -> Node | None:
    while node is not None and node.tag not in tags:
        node = node.parent
    return node


def parse(page: str) -> Node:
    """The element tree of a page; texts are strings among the children."""
    root = at = Node("#root", None)
    place = 0
    # No tag ends beyond the last ">", so none is looked for there: unclosed ones cost nothing.
    last = page.rfind(">") + 1
    while True:
        token = (_TOKEN.search(page, place, last) if place < last else None) or _UNCLOSED.search(page, max(place, last))
        end = token.start() if token else len(page)
        if end > place:
            at.children.append(page[place:end])
        if token is None:
            return root
        place = token.end()
        if token[0].startswith("<!--"):
            place = place if token[0].endswith("-->") else len(page)
            continue
        if token[0].startswith("<![CDATA["):
            if not token[0].endswith("]]>"):
                place = len(page)
            at.children.append(html.escape(page[token.start() + 9:place].removesuffix("]]>")))
            continue
        closing, tag, attributes = (token[1], token[2], token[3]) if token[2] else (
            token[4], token[5], token[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            found = _within(at, (tag,))
            # An end tag does not close the article or table cell around it.
            limit = _within(at, ("article", "main", "td", "body"))
            if found is not None and (tag in BLOCK or limit is None or _below(found, limit)):
                at = found.parent
            continue
        if tag in BLOCK and tag != "option":
            open_p = _within(at, ("p",))
            if open_p is not None:
                at = open_p.parent
        if tag in ENDS:
            ends, keeps = ENDS[tag]
            open_one = at
            while open_one is not None and open_one.tag not in ends and open_one.tag not in keeps:
                open_one = open_one.parent
            while open_one is not None and open_one.tag in ends:
                at, open_one = open_one.parent, open_one.parent
        node = Node(tag, at, _is_cut(tag, attributes, at))
        at.children.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{tag}[\s/>]", re.I).search(page, place)
            body = stop.start() if stop else len(page)
            place = page.find(">", body) + 1 or len(page)
        elif tag not in VOID and not attributes.endswith("/"):
            at = node
        elif tag not in VOID and tag in BLOCK:
            at = node       # a slash does not close a block in HTML


def _below(node: Node, limit: Node) -> bool:
    while node is not None and node is not limit:
        node = node.parent
    return node is limit


def _walk(root: Node) -> Iterator[Node]:
    """Kept elements, parents first."""
    stack = [root]
    while stack:
        node = stack.pop()
        if node.cut:
            continue
        yield node
        stack.extend(reversed([c for c in node.children if type(c) is Node]))


def score(root: Node) -> dict[int, float]:
    """Scores of the elements that got points, by identity."""
    order = list(_walk(root))
    for node in reversed(order):
        own = 0
        direct = []
        for c in node.children:
            if type(c) is str:
                size = len(c.strip())
                own += size
                if size:
                    direct.append(c)
            elif not c.cut:
                node.length += c.length
                node.linked += c.linked
        node.length += own
        if node.tag == "a":
            node.linked = node.length
        if node.length and (node.tag in PARAGRAPHS or (direct and node.tag in ("div", "section", "article"))):
            size = node.length if node.tag in PARAGRAPHS else sum(len(d.strip()) for d in direct)
            commas = sum(d.count(",") for d in direct)
            points = 1 + commas + min(size / 100, 3)
            holder, share = node.parent if node.tag in PARAGRAPHS else node, 1.0
            level = 1
            while holder is not None:
                holder.points += points * share
                level += 1
                share = 0.5 if level == 2 else 1 / (3 * (level - 1))
                holder = holder.parent
    return {id(n): n.points * (1 - n.linked / n.length) for n in order if n.points and n.length}


def main_blocks(page: str) -> list[str]:
    """The blocks of a page's main text."""
    root = parse(page)
    scores = score(root)
    nodes = {id(n): n for n in _walk(root)}
    ranked = [n for i, n in nodes.items() if i in scores and n.tag != "#root"]
    if not ranked:
        # No paragraph: whatever text is left.
        return _blocks([root])
    best = max(ranked, key=lambda n: scores[id(n)])
    around = _within(best, ("article", "main"))
    if around is not None:
        best = around
    if best.tag in ("body", "html", "#root") or best.parent is None:
        return _blocks([best])
    while around is None and best.parent.tag not in ("body", "html", "#root") \
            and best.parent.length == best.length:
        best = best.parent      # a wrapper without other text
    siblings = [c for c in best.parent.children if type(c) is Node and not c.cut]
    at = siblings.index(best)
    kept = []
    for i, c in enumerate(siblings):
        text = c.length and c.linked / c.length <= 0.33
        heading = i == at - 1 and c.tag in ("h1", "h2")
        if c is best or heading or text:
            kept.append(c)
    return _blocks(kept)


def _is_menu(node: Node) -> bool:
    """A list of links."""
    links = sum(1 for n in _walk(node) if n.tag == "a")
    return links >= 3 and node.length > 0 and node.linked / node.length > 0.8


def _blocks(roots: list[Node]) -> list[str]:
    out: list[str] = []
    held: list[str] = []

    def end() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append(text)

    stack: list[Node | str | None] = list(reversed(roots))
    while stack:
        item = stack.pop()
        if item is None:
            end()
        elif type(item) is str:
            held.append(item)
        elif item.cut or (item.tag in ("ul", "ol") and _is_menu(item)):
            end()
        else:
            if item.tag in BLOCK:
                end()
                stack.append(None)
            elif item.tag == "br":
                held.append(" ")
            stack.extend(reversed(item.children))
    end()
    return out


def main_texts(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html") -> DataFrame:
    """One row per page: id, URL, main text and its length in characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n".join(main_blocks(p)) if p else "" for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html")).mapInArrow(run, RESULT_SCHEMA)
