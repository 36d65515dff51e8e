"""Main text of HTML pages by scoring the tree of blocks.

Each page becomes a tree of its block elements. Text blocks pass points for
length and commas to the element that holds them, which passes half of its
points on to its own parent, and so on up to the root; an element's score is
its points times the share of its characters that are not links. The element
of highest score is the container of the article, together with those of its
siblings that look like parts of the same text.

A page is one row, so the work is one pass over the pages without a shuffle.
Time and memory of a page are linear in its length, whatever its nesting.

Defined cases: a null or empty page has no text ("" and 0 characters); text
outside any element belongs to the root; a tag without an end is closed by
its parent's end; ``<br>`` is white space inside its block; comments, scripts
and tags that never end reach to the end of the page. Rows that repeat are
extracted each. New columns replace old ones of the same name.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Elements of HTML by how they take part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content never is text of the article; they end where they say, and what is in them is left out.
NEVER = frozenset("head nav aside footer menu dialog search select button datalist template object svg math canvas audio video map fieldset".split())
#: Elements whose content is not markup.
RAW = "script|style|textarea|title|noscript|iframe|xmp|noembed|noframes"
#: What an element ends when it begins: the open element of the first set, unless one of the second is inside.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}), "body": ({"head"}, set()),
}
#: Words in class, id and role that mark what is not the article wherever it stands.
APART = frozenset(
    "ad ads advert adverts advertisement advertising advertorial adsense adbox adslot sponsor sponsored promo promotion promoted comment comments commentlist respond disqus reply replies"
    " cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login paywall share sharing social sharethis related recommended recommendations"
    " recommendation breadcrumb breadcrumbs pagination pager toolbar hidden noprint skip dialog complementary alertdialog".split()
)
#: Words that mark the frame of a page; a frame around the article itself is not taken away.
FRAME = frozenset("nav navbar navigation menu menubar sidebar sidenav header masthead topbar footer colophon banner widget widgets contentinfo search form".split())
#: Names of elements that hold the article.
HOLDS = frozenset("article articlebody post content entry main story body text page prose hentry".split())

#: Cells of fewer characters are data of their table; longer ones lay out a page.
DATA_CELL = 100

PIECES = re.compile(
    rf"""<!--(?:>|->|.*?(?:-->|--!>|\Z))
    |<(?P<raw>{RAW})(?=[\s/>])(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+(?:>|\Z).*?(?:</(?P=raw)(?=[\s/>])[^>]*+(?:>|\Z)|\Z)
    |</(?P<end>[a-z][^\s/>]*+)[^>]*+(?:>|\Z)
    |<(?P<tag>[a-z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)(?:>|\Z)
    |<[!?/][^>]*+(?:>|\Z)
    |(?P<text>[^<]++|<)""",
    re.I | re.S | re.X,
)
ATTRIBUTE = re.compile(r"""([a-z][\w:-]*)\s*+(?:=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""", re.I)
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

KEEP, AWAY, FRAMED = 0, 1, 2


def marks(tag: str, attrs: str) -> tuple[int, bool]:
    """Whether an element is apart from the article by its name and attributes, and whether it says that it holds an article."""
    away, holds = (AWAY if tag in NEVER else FRAMED if tag in ("header", "form") else KEEP), tag in ("article", "main")
    if not attrs or attrs.isspace():
        return away, holds
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attrs)}
    style = re.sub(r"\s", "", found.get("style", "")).lower()
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
        return AWAY, False
    names = [{w.lower() for w in NAME_WORDS.findall(name)} | {name.lower()} for k in ("class", "id", "role") for name in found.get(k, "").split()]
    bad = [n for n in names if n & APART]
    good = any(n & HOLDS and not n & APART and not n & FRAME for n in names)
    holds = not bad and (holds or found.get("itemprop", "").lower() == "articlebody" or found.get("role", "").lower() in ("main", "article"))
    if tag in ("html", "body") or away == AWAY:
        return away, False
    if bad and not (good and tag not in ("aside", "section")):
        return AWAY, False
    if any(n & FRAME for n in names) and not good:
        return FRAMED, holds
    return away, holds


class Page:
    """The block elements of a page in document order, and its text in pieces."""

    def __init__(self, page: str):
        self.parent, self.tag, self.away, self.holds = [-1], ["#root"], [KEEP], [False]
        self.pieces: list[tuple[int, int, bool, str]] = []  # element, block, in a link, text
        self.block = 0
        self.read(page)

    def read(self, page: str) -> None:
        stack, opened, link, block = [0], {}, False, 0
        tag, pieces = self.tag, self.pieces

        def close(to: int) -> None:
            while len(stack) > to:
                opened[tag[stack.pop()]] -= 1

        def close_tag(names, barrier) -> None:
            if any(opened.get(n) for n in names):
                for at in range(len(stack) - 1, 0, -1):
                    if tag[stack[at]] in names:
                        return close(at)
                    if tag[stack[at]] in barrier:
                        return None

        for m in PIECES.finditer(page):
            kind = m.lastgroup
            if kind == "text":
                pieces.append((stack[-1], block, link, entities.unescape(m["text"])))
            elif kind == "end":
                name = m["end"].lower()
                if name == "a":
                    link = False
                if name in BLOCKS:
                    block, link = block + 1, False
                if opened.get(name):
                    close_tag((name,), ())
            elif kind == "attrs":
                name = m["tag"].lower()
                if name in BLOCKS:
                    block, link = block + 1, False
                    if name not in ("html", "body"):
                        close_tag(("p",), ("table", "button", "object"))
                    if name in ENDS:
                        close_tag(*ENDS[name])
                elif name == "br":
                    pieces.append((stack[-1], block, link, " "))
                elif name == "a":
                    link = "href" in m["attrs"].lower()
                if name in VOID:
                    continue
                away, holds = marks(name, m["attrs"])
                if name in BLOCKS or away or name in NEVER:
                    self.parent.append(stack[-1])
                    tag.append(name)
                    self.away.append(away)
                    self.holds.append(holds)
                    opened[name] = opened.get(name, 0) + 1
                    if not m["attrs"].rstrip().endswith("/") or name in BLOCKS:
                        stack.append(len(tag) - 1)
                    else:
                        opened[name] -= 1
        self.block = block


def main_text(page: str | None) -> str:
    """The blocks of the article, one a line."""
    if not page:
        return ""
    p = Page(page)
    parent, tag, n = p.parent, p.tag, len(p.parent)
    article_inside = [False] * n
    for i in range(n - 1, 0, -1):
        if p.holds[i] or article_inside[i]:
            article_inside[parent[i]] = True
    gone, inside, table = [False] * n, [-1] * n, [-1] * n  # taken away; the nearest element around that says it holds the article; the nearest table
    for i in range(n):
        up = parent[i]
        if i:
            framed = p.away[i] == FRAMED and not article_inside[i] and not (tag[i] == "header" and inside[up] >= 0)
            gone[i] = gone[up] or p.away[i] == AWAY or framed
            inside[i] = i if p.holds[i] else inside[up]
            table[i] = i if tag[i] == "table" else table[up]

    blocks: dict[int, list] = {}  # by number: its element, its pieces
    size, links, points = [0] * n, [0] * n, [0.0] * n
    for node, block, link, text in p.pieces:
        if not gone[node]:
            blocks.setdefault(block, []).append((node, link, text))
    lines = []
    for parts in blocks.values():
        text = " ".join("".join(t for _, _, t in parts).split())
        if text:
            node = parts[0][0]
            linked = sum(len(t) for _, link, t in parts if link)
            size[node] += len(text)
            links[node] += min(len(text), linked)
            if not tag[node][0] == "h" or tag[node] == "html":  # headings name a text, they are none
                share = 1 - min(1.0, linked / len(text))
                holder = parent[node] if tag[node] in ("p", "pre", "li", "blockquote") and parent[node] >= 0 else node
                if tag[node] in ("td", "th", "tr") and len(text) < DATA_CELL and table[node] >= 0:
                    holder = table[node]
                points[holder] += share * min(1.0, len(text) / 25) * (1 + text.count(",") + min(len(text) / 100, 3))
            lines.append((node, text))
    for i in range(n - 1, 0, -1):
        size[parent[i]] += size[i]
        links[parent[i]] += links[i]
        points[parent[i]] += points[i] / 2
    score = [points[i] * (1 - links[i] / size[i]) if size[i] else 0.0 for i in range(n)]
    best = max(range(n), key=lambda i: (score[i], -i))
    if not size[best] or score[best] <= 0:  # headings or links only: the element that says so, else the page
        best = max((i for i in range(n) if p.holds[i] and not gone[i]), key=lambda i: size[i], default=0)
    if inside[best] >= 0:
        best = inside[best]
    chosen = {best} | siblings(best, p, score, size, links)
    kept = [False] * n
    for i in range(n):
        menu = tag[i] in ("ul", "ol", "dl", "table") and size[i] and links[i] >= 0.9 * size[i]
        kept[i] = i in chosen or i > 0 and kept[parent[i]] and not menu
    return "\n".join(text for node, text in lines if kept[node])


def siblings(best: int, p: Page, score: list[float], size: list[int], links: list[int]) -> set[int]:
    """Siblings of the container that are parts of the article: headings, texts of few links and containers of a fifth of its score."""
    out, up = set(), p.parent[best]
    if up < 0:
        return out
    named = p.holds[best]  # an element that says that it is the article is whole; beside it only others of its kind count
    for i in range(1, len(p.parent)):
        if p.parent[i] != up or i == best or not size[i]:
            continue
        density = links[i] / size[i]
        if named:
            part = p.tag[i] == p.tag[best] and p.holds[i] and score[i] >= 0.2 * score[best]
        elif re.fullmatch("h[1-6]|hgroup|header", p.tag[i]):
            part = i < best and density < 0.5
        elif p.tag[i] in ("p", "pre", "blockquote"):
            part = density < 0.25
        else:
            part = density < 0.5 and score[i] >= 0.2 * score[best] > 0
        if part:
            out.add(i)
    return out


def extract(pages: DataFrame, *, html_col: str = "html", text_col: str = "text", chars_col: str = "n_chars", drop_html: bool = False) -> DataFrame:
    """Adds the main text of every page and the number of its characters; ``drop_html`` leaves the page itself out."""
    new = [T.StructField(text_col, T.StringType()), T.StructField(chars_col, T.LongType())]
    kept = [f for f in pages.schema.fields if f.name not in (text_col, chars_col) and not (drop_html and f.name == html_col)]
    places, at = [pages.columns.index(f.name) for f in kept], pages.columns.index(html_col)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [main_text(x.as_py()) for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in places), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*(f.name for f in kept), text_col, chars_col])

    return pages.mapInArrow(run, T.StructType([*kept, *new]))
