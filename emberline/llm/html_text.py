"""Main text of web pages by tree scoring.

Each page is read as a tree of elements. A paragraph gives points for its length and its commas
to its parent and, halved, to its grandparent; an element's points are discounted by the share of
its text that stands in links. The element with the most points is the container; siblings of it
that score well, or are good paragraphs, are kept with it. Within what is kept, furniture
(menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments)
is left out, and each block of text becomes one line. Beside an article or main element, headings and
further articles stay; so does loose text that reads like a paragraph. Class and id words make furniture of block elements only, never of headings, paragraphs and
parts of lists and tables, and only where a whole name consists of them and of words for boxes ("related-posts", not "related-work"). They do not make
furniture of an element with most of the page's prose, nor of one around main or around the article with the most
prose; a section inside an article or main goes by its name only if that tells of reader comments, or if half of its text stands in links.
Formulas and the labels of drawings are text. A button is part of the text inside a heading, paragraph or list part.

Defined cases: a null or empty page has empty text; text outside any block is a block of its own;
unclosed and stray tags are mended as browsers do for paragraphs, list items and table cells; a
page without paragraphs falls back to all text that is not furniture; hidden elements count like others;
repeated rows each get a row; an empty table gives no rows. Other columns are not read. Every page is
parsed whole, where it lies, in time linear in its length however deep it is; nothing is shuffled.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names as HTML defines or uses them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr option optgroup legend button".split())
#: An opening tag ends an open one of these, unless a tag of the second set lies between.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])), "dd": (frozenset(["dd", "dt"]), frozenset(["dl"])), "dt": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])), "tbody": (frozenset(["tr", "td", "th", "thead", "tbody"]), frozenset(["table"])),
}
_FAMILIES = tuple(ENDS.values())
_FAMILY_OF = {name: k for k, name in enumerate(ENDS)}
_FAMILY_NAMES = frozenset().union(*(x for pair in _FAMILIES for x in pair))
_NO_ENDS = (None,) * len(_FAMILIES)
#: A paragraph outside of one of these is not ended by what is inside.
P_SCOPES = frozenset("button td th caption table".split())
DROP = frozenset(
    "nav aside footer form select input textarea script style noscript template iframe object embed dialog menu head title desc metadata annotation annotation-xml canvas audio video search option datalist".split()
)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist note".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements adbox adslot banner sponsor sponsored promo promos promotion promotions nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer masthead "
    "comment comments commentlist reply replies disqus respond cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup login share sharing social related recommend recommended recommendations "
    "widget toolbar pagination pager skip search form copyright disclaimer alert".split()
)
#: Words that name boxes and places, not contents: beside one of the above they leave a name what it is.
BOX_WORDS = frozenset(
    "box block bar list lists link links item items container wrapper wrap inner outer area panel section unit slot top bottom left right site page global main primary secondary post posts article articles news story "
    "stories button buttons icon icons media module row col column content header body group holder the".split()
)
_NAME_PARTS = re.compile(r"[^\W\d_]+")
#: A name of these parts says nothing of what stands inside.
NAMELESS = frozenset("h1 h2 h3 h4 h5 h6 p li dd dt td th tr tbody thead tfoot pre blockquote figure figcaption caption summary address hgroup".split())
HEADER_WORDS = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)
COMMENT_WORDS = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies)(?:$|[\s_-]|\d)", re.I)
CONTENT_WORDS = re.compile(r"article|body|content|entry|main|post|story|text", re.I)
PARAGRAPHS = frozenset("p pre td blockquote li dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


class Node:
    """An element: its name, attributes that matter, and children (elements and strings).

    What a tag may end is inherited from the parent, so that nothing walks up the tree: the paragraph that is open
    here, and of each family of ENDS the outermost element that its next tag ends.
    """

    __slots__ = ("name", "names", "role", "parts", "parent", "points", "content", "in_article", "in_main", "in_text", "paragraph", "ends", "length", "linked")

    def __init__(self, name: str, attributes: str, parent: Node | None):
        self.name, self.parent, self.parts, self.points = name, parent, [], 0.0
        self.names = self.role = ""
        self.content = False
        self.length = self.linked = 0
        if parent is None:
            self.in_article = self.in_main = self.in_text = False
            self.paragraph, self.ends = None, _NO_ENDS
        else:
            self.in_article = parent.in_article or parent.name == "article"
            self.in_main = parent.in_main or parent.name in ("article", "main")
            self.in_text = parent.name in NAMELESS or parent.in_text and parent.name not in BLOCK
            self.paragraph = self if name == "p" else None if name in P_SCOPES else parent.paragraph
            self.ends = parent.ends
            if name in _FAMILY_NAMES:
                self.ends = tuple(None if name in stops else held or (self if name in closes else None) for (closes, stops), held in zip(_FAMILIES, parent.ends))
        if attributes and attributes.strip():
            for key, a, b, c in _ATTRIBUTE.findall(attributes):
                key = key.lower()
                if key in ("class", "id"):
                    self.names += " " + (a or b or c)
                elif key == "role":
                    self.role = (a or b or c).lower()

    def furniture(self) -> bool:
        if self.name in ("html", "body", "main"):
            return False
        if self.name == "article":
            return bool(self.names and COMMENT_WORDS.search(self.names))
        if self.by_nature() or self.named():
            return True
        # A header inside an article carries its heading.
        return (self.name == "header" or bool(self.names and not self.content and self.name in BLOCK and self.name not in NAMELESS and HEADER_WORDS.search(self.names))) and not self.in_article

    def by_nature(self) -> bool:
        """Furniture whatever its class."""
        if self.name == "button":
            return not self.in_text
        return self.name in DROP or self.role in FURNITURE_ROLES and self.name not in ("html", "body", "main", "article")

    def named(self) -> bool:
        """Furniture by a class or an id."""
        return bool(self.names) and not self.content and self.name in BLOCK and self.name not in NAMELESS and any(map(names_furniture, self.names.split()))


def names_furniture(name: str) -> bool:
    """Whether a class or id is of furniture words, among words for boxes."""
    parts = _NAME_PARTS.findall(name.lower())
    return any(w in FURNITURE_WORDS for w in parts) and all(w in FURNITURE_WORDS or w in BOX_WORDS for w in parts)


def parse(page: str) -> Node:
    root = Node("#root", "", None)
    at, end = root, len(page)
    place = 0
    opened: Counter[str] = Counter()

    def leave(node: Node) -> Node:
        """Close everything up to and with an open element; each is closed once."""
        up = at
        while up is not node:
            opened[up.name] -= 1
            up = up.parent
        opened[node.name] -= 1
        return node.parent

    while place < end:
        m = _TOKEN.match(page, place)
        place = m.end()
        name = m[2]
        if name is None:
            if m[0] == "<" and page[place : place + 1].isascii() and page[place : place + 2].lstrip("/")[:1].isalpha():
                close = page.find(">", place)  # a tag with an odd quote ends at the next >, or never
                if close < 0:
                    break
                place = close + 1
                continue
            if m[0][0] != "<" or m[0] == "<":
                at.parts.append(m[0])
            continue
        name = name.lower()
        if m[1]:
            if opened[name] > 0:
                up = at
                while up.name != name:
                    up = up.parent
                at = leave(up)
            elif name == "p":
                at.parts.append(Node("p", "", at))
            continue
        if name in CLOSES_P and at.paragraph is not None:
            at = leave(at.paragraph)
        if name in ENDS and (last := at.ends[_FAMILY_OF[name]]) is not None:
            at = leave(last)
        node = Node(name, m[3], at)
        at.parts.append(node)
        if name in VOID or m[3].endswith("/") and name not in BLOCK:
            continue
        if name in RAW:
            close = _RAW_END[name].search(page, place)
            # The end tag runs to the next >; without one, nothing closes any more.
            stop = page.find(">", close.end()) if close else -1
            place = stop + 1 if stop >= 0 else end
            continue
        opened[name] += 1
        at = node
    return root


def _walk(node: Node):
    """Elements that are not furniture, parents first, without recursion."""
    todo = [node]
    while todo:
        x = todo.pop()
        yield x
        todo.extend(p for p in reversed(x.parts) if isinstance(p, Node) and not p.furniture())


def measure(root: Node) -> None:
    """Give every element that is not furniture the characters below it, and those of them in links."""
    for x in reversed(list(_walk(root))):
        x.length = sum(len(p) if isinstance(p, str) else p.length for p in x.parts if isinstance(p, str) or not p.furniture())
        x.linked = x.length if x.name == "a" else sum(p.linked for p in x.parts if isinstance(p, Node) and not p.furniture())


def _text(node: Node) -> str:
    """All text below that is not furniture."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            todo.extend(p for p in reversed(x.parts) if isinstance(p, str) or not p.furniture())
    return "".join(out)


def _own_text(node: Node, links: bool = True) -> str:
    """Text of a paragraph, without blocks inside it."""
    out, todo = [], list(reversed(node.parts))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.name not in BLOCK and (links or x.name != "a") and not x.furniture():
            todo.extend(reversed(x.parts))
    return _SPACE.sub(" ", entities.unescape("".join(out))).strip()


def mark_content(root: Node, comments: bool = False) -> None:
    """Mark the elements that no class word makes furniture; with comments, those named after comments too."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo.extend(p for p in reversed(x.parts) if isinstance(p, Node) and not p.by_nature())
    prose, seen = {}, {id(root): True}
    for x in order:
        text = _own_text(x, False) if x.name in PARAGRAPHS or x.name in ("div", "section", "article", "main", "body") else ""
        prose[id(x)] = 1 + text.count(",") + min(len(text) / 100, 3) if len(text) >= 25 else 0.0
        if x is not root:
            seen[id(x)] = seen[id(x.parent)] and not x.furniture()
    for x in reversed(order):
        x.length += sum(len(p) for p in x.parts if isinstance(p, str))
        if x.name == "a":
            x.linked = x.length
        if x.name == "section" and x.in_main and x.linked <= x.length / 2 and not (x.names and COMMENT_WORDS.search(x.names)):
            x.content = True
        if x is not root:
            prose[id(x.parent)] += prose[id(x)]
            x.parent.length += x.length
            x.parent.linked += x.linked
    total = prose[id(root)]
    if not total:
        return
    around = [x for x in order if x.name == "main"][:1]
    articles = [x for x in order if x.name == "article" and not x.furniture() and prose[id(x)] >= total / 4]
    # Where an article stands free, others in furniture are teasers or replies.
    if articles and not any(seen[id(x)] for x in articles):
        around.append(max(articles, key=lambda x: prose[id(x)]))
    for x in around:
        while x is not None:
            x.content = True
            x = x.parent
    for x in order:
        if prose[id(x)] > total / 2 and (comments or not (x.names and COMMENT_WORDS.search(x.names))):
            x.content = True


def container(root: Node) -> Node | None:
    """The element with the most points after the discount for links."""
    scored: list[Node] = []
    for x in _walk(root):
        if x.name not in PARAGRAPHS and x.name not in ("div", "section", "article", "main"):
            continue
        text = _own_text(x)
        if len(text) < 25 and not (x.name == "p" and text):
            continue
        points = 1 + text.count(",") + min(len(text) / 100, 3) if len(text) >= 25 else 0.2
        up = x.parent if x.name in PARAGRAPHS else x
        for share in (1.0, 0.5):
            if up is None or up.name in ("#root", "html"):
                break
            if not up.points:
                scored.append(up)
                up.points += {"article": 10, "main": 8, "section": 3, "div": 2}.get(up.name, 0.01) + (5 if up.names and CONTENT_WORDS.search(up.names) else 0)
            up.points += share * points
            up = up.parent
    measure(root)
    best, most = None, 0.0
    for x in scored:
        x.points *= 1 - x.linked / max(1, x.length)
        if x.points > most:
            best, most = x, x.points
    return best


def kept(best: Node) -> list[Node | str]:
    """The container and the siblings that belong to it, in page order.

    Siblings of every container are scored alike. Beside an article or main, a further article stays with any points,
    and a heading that follows stays only with what follows it.
    """
    if best.parent is None or best.name == "body":
        return [best]
    whole = best.name in ("article", "main")
    reads = lambda text, share: share < 0.25 and (len(text) > 80 or text.endswith((".", "!", "?")))
    out: list[Node | str] = []
    held: list[Node | str] = []
    loose: list[Node | str] = []
    passed = False

    def settle() -> None:
        """Text that stands loose, with what is inline in it, counts as one paragraph."""
        text = "".join(x if isinstance(x, str) else _text(x) for x in loose)
        linked = sum(x.linked for x in loose if isinstance(x, Node))
        if text.strip() and reads(text.strip(), linked / len(text)):
            out.extend([*held, *loose])
        loose.clear()

    for x in best.parent.parts:
        if x is not best and (isinstance(x, str) or x.name not in BLOCK and not x.furniture()):
            loose.append(x)
            continue
        settle()
        if x is best:
            out.append(x)
            passed = True
        elif not x.furniture():
            if whole and passed and x.name in HEADINGS:
                held.append(x)
                continue
            text, share = _text(x).strip(), x.linked / max(1, x.length)
            good = x.points >= max(10, best.points / 5) or whole and x.name == "article" and x.points > 0 and share < 0.25
            if good or x.name in HEADINGS and text or x.name in PARAGRAPHS and reads(text, share):
                out += [*held, x]
            held.clear()
    settle()
    return out


def blocks(nodes: list[Node | str]) -> list[str]:
    """The text of each block, in page order."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if held and (text := _SPACE.sub(" ", entities.unescape("".join(held))).strip()):
            out.append(text)
        held.clear()

    todo: list = [(x, False) for x in reversed(nodes)]
    while todo:
        x, closing = todo.pop()
        if isinstance(x, str):
            held.append(x)
        elif closing:
            flush()
        elif x.name == "br":
            held.append(" ")
        elif not x.furniture():
            is_block = x.name in BLOCK
            if is_block:
                flush()
                todo.append((x, True))
            todo.extend((p, False) for p in reversed(x.parts))
    flush()
    return out


def main_text(page: str | None) -> str:
    for comments in (False, True):
        root = parse(page or "")
        mark_content(root, comments)
        best = container(root)
        if found := blocks([root] if best is None else kept(best)):
            break
    return "\n".join(found)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars."""

    def read(batches):
        for batch in batches:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(read, "page_id long, url string, text string, n_chars long")
