"""Main text of web pages by two passes of block rules.

The page is cut into blocks at block-level tags. The first pass decides each block by the share of
stop words, the share of characters inside links and its length, and by what surrounds it: what lies
in menus, headers, footers, sidebars, forms, notices, adverts or reader comments is boilerplate. The
second pass gives undecided short blocks the label of the nearest decided neighbours in the same
section of the page.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter
from functools import cache
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """the of and to in a is that it was for on are as with his they be at one have this from or had by not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may long
    der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an er so dass kann dieses wird bei noch nach wie über aus
    le la les de des et un une en du que qui dans pour pas sur au avec est par ce il ne se plus sont ou son
    el los las y que del se por un una con no su para es al lo como más pero sus este ya entre cuando""".split()
)
#: Elements whose whole content is no text.
SKIPPED = frozenset("script style noscript template svg math iframe object select option textarea button head".split())
#: Elements that hold boilerplate.
ASIDE = frozenset("nav header footer aside form menu dialog".split())
#: Elements that begin and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a block-level start tag or the end of their parent closes.
_IMPLIED = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option"])}
#: Words in class, id or role that mark boilerplate.
_BOILER = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|nav\w*|menu|breadcrumb\w*|sidebar|side|widget|related|recommend\w*|share|sharing|social|comment\w*|disqus|respons\w*|reply|replies|footer|header|masthead|copyright|legal|pagination|pager|search|navigation|contentinfo|complementary)(?:$|[\s_-])",
    re.I,
)
#: Words that mark the article itself.
_ARTICLE = re.compile(r"(?:^|[\s_-])(?:article\w*|main|content|post|entry|story|body)(?:$|[\s_-])", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(/?)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>?", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")

#: A block of at least so many characters is long; shorter ones may stay undecided.
LONG, SHORT = 140, 60
LINKED, STOPPED = 0.4, 0.12
GOOD, BAD, UNSURE = 1, -1, 0
#: How much inside an element is boilerplate; an article's own header holds its heading.
NONE, BUT_HEADINGS, ALL = 0, 1, 2


class Block:
    __slots__ = ("parts", "linked", "boiler", "inside", "heading", "section", "parent", "label", "text")

    def __init__(self, boiler: bool, inside: bool, heading: bool, section: int, parent: int):
        self.parts, self.linked = [], 0
        self.boiler, self.inside, self.heading, self.section, self.parent = boiler, inside, heading, section, parent
        self.label, self.text = UNSURE, ""


def blocks(page: str) -> list[Block]:
    """Blocks with text in page order."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool, int, int]] = []  # element, boilerplate, in the article, section, number
    is_open: Counter[str] = Counter()
    current, links, section, at, count = None, 0, 0, 0, 0

    @cache
    def tags() -> _Tags:
        return _Tags(page)

    def top():
        return stack[-1][1:4] if stack else (NONE, False, 0)

    def add(raw: str) -> None:
        nonlocal current
        if current is None:
            if not raw.strip():
                return
            boiler, inside, part = top()
            heading = any(e[0] in _HEADINGS for e in stack[-3:])
            current = Block(boiler == ALL or (boiler == BUT_HEADINGS and not heading), inside, heading, part, stack[-2][4] if len(stack) > 1 else 0)
            out.append(current)
        current.parts.append(raw)
        if links:
            current.linked += len(raw)

    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m[2] or m[6]
        if name is None:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:-3])
            continue
        name, closing, attributes = name.lower(), bool(m[1] or m[5]), m[3] or m[7] or ""
        if not closing and name in SKIPPED:
            if name == "head":
                continue  # its title, scripts and styles go by themselves
            if name in ("script", "style", "textarea"):
                end = _end_of(name).search(page, at)
                at = end.end() if end else len(page)
            elif name in ("noscript", "template", "iframe", "svg", "math", "object", "select", "button") and not attributes.endswith("/"):
                at = tags().after(name, m.start(), at, stack[-1][0] if stack else "")
            continue
        if name == "title" and not closing:
            at = tags().closing(name, at)
            continue
        if name == "br":
            add(" ")
            continue
        if name in BLOCKS or name == "body":
            current = None
        if name in VOID:
            continue
        if name == "a":
            links = max(0, links + (-1 if closing else 1)) if closing or not links else links
        if not closing:
            while stack and stack[-1][0] in _IMPLIED and name in _IMPLIED[stack[-1][0]]:
                is_open[stack.pop()[0]] -= 1
            boiler, inside, part = top()
            if name in BLOCKS or name in ASIDE:
                marks = " ".join(next(filter(None, g), "") for k, *g in _ATTRIBUTE.findall(attributes) if k.lower() in ("class", "id", "role")) if attributes else ""
                if name in ("article", "main"):
                    section += 1
                    boiler, part = ALL if marks and _BOILER.search(marks) else boiler, section
                    inside = inside or boiler != ALL
                elif name in ASIDE or (marks and name not in ("html", "body") and _BOILER.search(marks) and not (_ARTICLE.search(marks) and not inside)):
                    if name == "header" and inside and boiler != ALL and not (marks and _BOILER.search(marks)):
                        boiler = BUT_HEADINGS
                    else:
                        section += 1
                        boiler, part = ALL, section
                elif marks and _ARTICLE.search(marks):
                    section += 1
                    part = section
                if not m[4] or name not in VOID:
                    count += 1
                    stack.append((name, boiler, inside, part, count))
                    is_open[name] += 1
        elif is_open[name]:
            ended = ""
            while ended != name:
                ended = stack.pop()[0]
                is_open[ended] -= 1
            links = 0 if name in BLOCKS else links
    return out


_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
_ends: dict[str, re.Pattern] = {}


def _end_of(name: str) -> re.Pattern:
    if name not in _ends:
        _ends[name] = re.compile(rf"</{name}\s*>", re.I)
    return _ends[name]


class _Tags:
    """Where elements end, from one reading of a page's tags, however many elements are open."""

    _EVERY = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?=[\s/>])[^<>]*?(/?)>")

    def __init__(self, page: str):
        #: Of each element: (begin, end, step in depth) of its tags.
        self.tags: dict[str, list[tuple[int, int, int]]] = {}
        for m in self._EVERY.finditer(page):
            self.tags.setdefault(m[2].lower(), []).append((m.start(), m.end(), -1 if m[1] else 0 if m[3] else 1))
        self.ends: dict[str, dict[int, int]] = {}
        self.closings: dict[str, list[tuple[int, int]]] = {}
        self.depths: dict[str, tuple[list[int], list[int], list[int]]] = {}

    def closing(self, name: str, at: int) -> int:
        """Where the next closing tag ends; at, if there is none."""
        if name not in self.closings:
            self.closings[name] = [(start, end) for start, end, step in self.tags.get(name, []) if step < 0]
        k = bisect.bisect_left(self.closings[name], (at,))
        return self.closings[name][k][1] if k < len(self.closings[name]) else at

    def after(self, name: str, begin: int, at: int, parent: str) -> int:
        """Where the element whose tag stands from begin to at ends; at that tag if its parent, or the page, ends first."""
        if name not in self.ends:
            ends, waiting = self.ends.setdefault(name, {}), []
            for start, end, step in self.tags.get(name, []):
                if step > 0:
                    waiting.append(start)
                elif step < 0 and waiting:
                    ends[waiting.pop()] = end
        end = self.ends[name].get(begin, at)
        return at if parent and parent != name and self._closes(parent, at, end) else end

    def _closes(self, parent: str, at: int, end: int) -> bool:
        """Whether a parent that is open at `at` ends before `end`."""
        if parent not in self.depths:
            tags = self.tags.get(parent, [])
            depth = [0, *accumulate(step for _, _, step in tags)]
            self.depths[parent] = [e for _, e, _ in tags], depth, _next_below(depth)
        ends, _, below = self.depths[parent]
        first = below[bisect.bisect_right(ends, at)] - 1  # depth k is that after k tags
        return first < len(ends) and ends[first] <= end


def _next_below(depth: list[int]) -> list[int]:
    """For each place the next one where the depth is less; the length where there is none."""
    out, waiting = [len(depth)] * len(depth), []
    for i, d in enumerate(depth):
        while waiting and depth[waiting[-1]] > d:
            out[waiting.pop()] = i
        waiting.append(i)
    return out


def first_pass(b: Block) -> int:
    """Boilerplate by place and links; main text by stop words and length; else undecided."""
    if b.boiler or b.linked > LINKED * max(1, sum(map(len, b.parts))):
        return BAD
    if b.heading:
        return UNSURE
    n = len(b.text)
    if n < SHORT:
        return UNSURE
    found = _WORD.findall(b.text.lower())
    density = sum(w in STOP_WORDS for w in found) / max(1, len(found))
    if density >= STOPPED:
        return GOOD
    return GOOD if b.inside and n >= LONG else UNSURE


def second_pass(found: list[Block]) -> None:
    """Undecided blocks take the label of the nearest decided ones before and after in their section of the page.

    What its place alone makes boilerplate lends its label to none. Where the two differ, one of the same parent element prevails, else a block inside the article
    and a heading before main text are kept. Without either, what lies inside the article is kept.
    """
    n = len(found)
    before, after = [None] * n, [None] * n
    for order, out in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict[int, Block] = {}
        for i in order:
            out[i] = last.get(found[i].section)
            if found[i].label != UNSURE and not found[i].boiler:
                last[found[i].section] = found[i]
    chosen = []
    for b, x, y in zip(found, before, after, strict=True):
        near = [z for z in (x, y) if z]
        kin = [z for z in near if z.parent == b.parent]
        if b.label != UNSURE:
            chosen.append(b.label)
        elif len({z.label for z in near}) == 1:
            chosen.append(near[0].label)
        elif len({z.label for z in kin}) == 1:
            chosen.append(kin[0].label)
        else:
            chosen.append(GOOD if b.inside or (b.heading and y and y.label == GOOD) else BAD)
    for b, label in zip(found, chosen, strict=True):
        b.label = label


def main_text(page: str | None) -> str:
    """Main text of one page, blocks joined by newlines."""
    found = blocks(page or "")
    for b in found:
        b.text = _SPACE.sub(" ", html.unescape("".join(b.parts))).strip()
    found = [b for b in found if b.text]
    for b in found:
        b.label = first_pass(b)
    if any(b.inside and b.label == GOOD for b in found):  # an article with text: all outside is boilerplate
        for b in found:
            if not b.inside:
                b.boiler, b.label = True, BAD
    elif not any(b.label == GOOD for b in found):  # a language without a list of stop words
        unsure = [b for b in found if b.label == UNSURE and not b.heading]
        for b in [b for b in unsure if len(b.text) >= LONG] or unsure:  # of short blocks alone, none is less text than another
            b.label = GOOD
    second_pass(found)
    return "\n".join(b.text for b in found if b.label == GOOD)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page, from the whole html.

    A null or empty html, and one without main text, give an empty text. Null and repeated page_ids
    keep their rows; other columns are ignored; an empty table gives an empty result.
    """

    def start():
        return lambda rows: [(p, u, t, len(t)) for p, u, h in rows for t in [main_text(h)]]

    return map_arrow(pages.select(id_col, url_col, html_col), f"{id_col} long, {url_col} string, text string, n_chars long", start, rows=256)


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; a null html and a page without main text give an empty text."""
    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.col("n_chars").cast("long").alias("n_chars"))
