"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into one line per block; lines inside menus, notices, forms and
other furniture carry no text.  Lengths, without links and raised inside an article
element, are summed over a sliding window of lines.  Where the sum surges above a
threshold a stretch of text begins, where it dives to zero it ends; the lines between
are kept, and so are those next to them with the same parent.
"""

import html
import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, quoted

WINDOW = 3
SURGE = 80
BOOST = 4  # how much more a character in an article or main element weighs

# Fixed values of HTML: elements by how they are treated here.
TO_END = frozenset("script style textarea title".split())
RAW = [*sorted(TO_END), *"noscript template svg iframe select button object canvas".split()]
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav aside footer form menu dialog head fieldset".split())
CLOSES_P = BLOCKS - {"body", "option"}
MAIN = frozenset(["article", "main"])

# Words in class, id or role that name page furniture.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner sidebar"
    " menu navbar navigation nav breadcrumb breadcrumbs pagination pager cookie cookies consent gdpr notice notices alert"
    " popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended"
    " recommendations comment comments disqus respond reply replies discussion footer masthead toolbar widget widgets"
    " skip copyright disclaimer complementary contentinfo dialog form header".split()
)

RAW_OPEN = re.compile("<!--|<(" + "|".join(RAW) + r")(?=[\s/>])[^>]*>", re.IGNORECASE)
RAW_CLOSE = {n: re.compile(rf"</{n}\s*>", re.IGNORECASE) for n in RAW}
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[/!?][^>]*>|<[a-zA-Z][^<>]*>|</?[a-zA-Z][^<>]*\Z")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.IGNORECASE)
NAME_PARTS = re.compile(r"[A-Za-z]+")

# Words that say nothing by themselves beside a name of furniture, as in ad-box.
PLAIN = frozenset(
    "area bar block bottom box btn button container inner item items left link links list main outer panel"
    " right section site slot top unit wrap wrapper".split()
)
# What readers add or notices: never the wrapper of a page, however much text it has.
NEVER_WRAP = frozenset("comment comments disqus respond reply replies discussion cookie cookies consent gdpr copyright disclaimer".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = HEADINGS | {"p", "pre", "blockquote"}
TAKEN, DOUBTED, DROPPED = range(3)


def without_raw(page: str) -> str:
    """The page without comments and without elements that hold no text of the page.

    Self-closed elements are empty.  Without a closing tag, comments and the elements
    of ``TO_END`` run to the end of the page; of others only the tag goes.
    """
    made, at, unclosed = [], 0, set()
    while match := RAW_OPEN.search(page, at):
        made += [page[at : match.start()], " "]
        at = match.end()
        name = (match.group(1) or "").lower()
        if not name:
            end = page.find("-->", at)
            at = end + 3 if end >= 0 else len(page)
        elif name in unclosed or name not in TO_END and match.group().endswith("/>"):
            continue
        elif close := RAW_CLOSE[name].search(page, at):
            at = close.end()
        elif name in TO_END:
            at = len(page)
        else:
            unclosed.add(name)
    return "".join([*made, page[at:]])


def furniture(tag: str, attributes: str, in_main: bool) -> int:
    """Whether an element is furniture: not, unless it wraps the page, or always."""
    if tag in ("form", "fieldset"):
        return DOUBTED
    if tag in FURNITURE:
        return DROPPED
    if tag == "header":
        # The header of an article holds its title; that of a page holds its menu.
        return TAKEN if in_main else DOUBTED
    if not attributes or tag in ("body", "html") or tag in MAIN:
        return TAKEN
    found = TAKEN
    for name, *values in ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        key = name.lower()
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return DROPPED
        for token in value.split():
            # The whole token has to name furniture: search-result or no-sidebar do not.
            parts = {p.lower() for p in NAME_PARTS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", token))}
            named = parts & NAMES
            if not named or parts - NAMES - PLAIN or in_main and named <= {"header"}:
                continue
            if parts & NEVER_WRAP:
                return DROPPED
            found = DOUBTED
    return found


class Line(NamedTuple):
    text: str
    linked: int
    main: bool
    skipped: bool
    parent: int
    heading: bool


def lines(page: str) -> list[Line]:
    """The blocks of a page in order, with the length in links and the place of each.

    Elements that may be furniture are judged at the end, by the text they hold:
    one that holds all articles of the page is a wrapper and stays, on a page without
    articles one beside which no text could surge.
    """
    page = without_raw(page)
    # Of each element: parent, kind of furniture, how many articles it is in, nearest container, heading.
    elements: list[tuple[int, int, int, int, bool]] = [(-1, TAKEN, 0, 0, False)]
    stack: list[tuple[str, int, bool]] = [("", 0, False)]
    found: list[tuple[str, int, int]] = []
    text: list[str] = []
    links = at = 0

    def flush():
        nonlocal links
        words = " ".join(html.unescape("".join(text)).split())
        text.clear()
        linked, links = links, 0
        if words:
            found.append((words, linked, stack[-1][1]))

    def add(piece):
        nonlocal links
        if piece:
            text.append(piece)
            if stack[-1][2]:
                links += len(piece.strip())

    def opened(wanted):
        """The open element of that name (a paragraph: in the innermost block), or None."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == wanted:
                return k
            if wanted == "p" and stack[k][0] in BLOCKS:
                return None
        return None

    for match in TAG.finditer(page):
        add(page[at : match.start()])
        at = match.end()
        closing, tag, attributes = match.group(1), (match.group(2) or "").lower(), match.group(3) or ""
        if not tag:
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCKS:
            flush()
        if closing:
            at_tag = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), None)
            if at_tag is not None:
                if any(elements[x[1]][1] or x[0] in MAIN for x in stack[at_tag:]):
                    flush()
                del stack[at_tag:]
            continue
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in CLOSES_P or tag == "body":
            # A block ends an open paragraph and the inline elements in it; a body ends an open head.
            k = opened("head" if tag == "body" else "p")
            if k is not None:
                del stack[k:]
        _, above, link = stack[-1]
        _, _, main, container, heading = elements[above]
        kind = furniture(tag, attributes, main > 0)
        if kind or tag in MAIN:
            flush()
        me = len(elements)
        inside = me if tag in BLOCKS and tag not in LEAVES else container
        elements.append((above, kind, main + (tag in MAIN), inside, tag in HEADINGS or heading and tag not in BLOCKS))
        stack.append((tag, me, tag not in BLOCKS and (link or tag == "a")))
    add(page[at:])
    flush()
    return judged(found, elements)


def judged(found: list[tuple[str, int, int]], elements: list[tuple[int, int, int, int, bool]]) -> list[Line]:
    """The lines, after deciding which elements are furniture."""
    n = len(elements)
    dropped = [False] * n
    for k in range(1, n):
        dropped[k] = dropped[elements[k][0]] or elements[k][1] == DROPPED
    total, in_main, deepest = [0] * n, [0] * n, [0] * n
    for words, _, k in found:
        if not dropped[k]:
            total[k] += len(words)
            in_main[k] += len(words) if elements[k][2] else 0
            deepest[k] = elements[k][2]
    for k in range(n - 1, 0, -1):
        total[elements[k][0]] += total[k]
        in_main[elements[k][0]] += in_main[k]
        deepest[elements[k][0]] = max(deepest[elements[k][0]], deepest[k])
    for k in range(1, n):
        parent, kind, main, _, _ = elements[k]
        if kind == DOUBTED:
            if main:
                most = 2 * total[k] > total[0]
                # A form inside a short article is none, unless an article or nearly all is in it.
                dropped[k] = not (most and (deepest[k] > main or 5 * total[k] > 4 * total[0]))
            elif in_main[0]:
                # A wrapper holds every article; an advert may well be longer than the article beside it.
                dropped[k] = in_main[k] < in_main[0]
            else:
                # Without an article it is the page, if nothing else could be.
                dropped[k] = total[0] - total[k] > SURGE
        dropped[k] = dropped[k] or dropped[parent]
    return [Line(w, linked, elements[k][2] > 0, dropped[k], elements[k][3], elements[k][4]) for w, linked, k in found]


def stretches(lengths: list[int], window: int, surge: int) -> list[tuple[int, int]]:
    """Half-open ranges of lines between the surge and dive points of the windowed sums."""
    n = len(lengths)
    sums = [sum(lengths[i : i + window]) for i in range(n)]
    found = []
    i = 0
    while i < n:
        if sums[i] > surge and lengths[i]:
            end = i
            while end < n and sums[end] > 0:
                end += 1
            found.append((i, end))
            i = end
        else:
            i += 1
    return found


def weight(line: Line) -> int:
    """Characters outside of links, more for those in an article; none for furniture and lists of links."""
    if line.skipped:
        return 0
    if line.main and line.heading:
        return BOOST * len(line.text)
    if 2 * line.linked > len(line.text):
        return 0
    return (BOOST if line.main else 1) * max(1, len(line.text) - line.linked)


def joining(order: list[int], kept: set[int], found: list[Line]) -> set[int]:
    """Lines that follow a kept one, with nothing but lines of the same parent between."""
    made, last = set(), None
    for i in order:
        if i in kept:
            last = found[i].parent
        elif found[i].parent == last:
            made.add(i)
        else:
            last = None
    return made


def main_text(page: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """The article of a page, its blocks joined by two line ends; empty if there is none.

    The lines between surge and dive points are kept, on every page; lying in an
    article (or main) element raises the weight of a line.  Lines beside a kept
    stretch join it as long as they have the same parent.  If nothing surges above ``surge``, all lines that carry
    text are taken, of the article if there is one.
    """
    found = lines(page)
    weights = [weight(line) for line in found]
    ranges = stretches(weights, window, surge)
    if ranges:
        kept = {i for a, b in ranges for i in range(a, b) if weights[i]}
        solid = [i for i, w in enumerate(weights) if w]
        for order in (solid, solid[::-1]):
            kept |= joining(order, kept, found)
    else:
        marked = any(w and line.main for w, line in zip(weights, found))
        kept = {i for i, line in enumerate(found) if weights[i] and (line.main or not marked)}
    return "\n\n".join(found[i].text for i in sorted(kept))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``<id>, <url>, text, n_chars`` of every page; null or empty pages give an empty text.

    Nulls in id and url stay, repeated rows are extracted as often as they come,
    and other columns are not read.  Texts are whole, whatever their length.
    """
    rows = pages.select(
        quoted(id_col).alias("id"), quoted(url_col).alias("url"), F.coalesce(quoted(html_col), F.lit("")).alias("html")
    )

    def run(part):
        made = []
        for key, url, page in part:
            text = main_text(page)
            made.append((key, url, text, len(text)))
        return made

    kind = pages.schema[id_col].dataType.simpleString()
    done = map_rows(rows, run, f"id {kind}, url string, text string, n_chars long", batch=128)
    return done.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
