"""Main text of web pages by two passes of rules over their blocks.

A page is cut into blocks at block-level tags; scripts, styles, forms and other invisible or interactive content never
get into one. Pass one judges each block by itself: inside boilerplate markup (navigation, header, footer, sidebar,
advert, notice, comments), or mostly links, it is bad; long and dense in stop words it is good; what says too little is
open (short). Where a page has hardly any of the stop words known here, density tells nothing of its language: length and
links decide, in bytes, for scripts without spaces say more in a character. Pass two gives each open block the label of its
nearest decided neighbours: both good, or one of them and the nearer; the edges of an article or main element count as good
neighbours of what lies inside.

All steps take time in proportion to the page, broken markup too.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed

#: Words that are frequent in running text of their languages: fixed values.
STOP_WORDS = frozenset(
    "a about after all also an and are as at be been but by can do for from had has have he her his if in into is it its more no not of on one or other she so than that the their them then there these they this to was we were what when which who will with would you "
    "au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur mais ne nous ou par pas plus pour que qui sa se ses son sont sur un une vous "
    "aber als am auch auf aus bei das dem den der des die durch ein eine einem einen einer er es für hat ich ihr im ist mit nach nicht noch nur oder sich sie sind über um und uns von vor war was wenn wie wird wir zu zum zur "
    "al como con cuando del el ella entre era es esta este ha hay la las lo los me mi muy más no nos para pero por porque que se si sin sobre su sus también te tiene todo un una y ya".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Their content is no text of the page.
HIDDEN = frozenset("script style noscript template iframe object embed svg math canvas select option textarea button input form head title video audio map datalist label fieldset".split())
BAD_TAGS = frozenset("nav header footer aside menu dialog".split())
MAIN_TAGS = frozenset("article main".split())
#: Words of a class, id or role that name boilerplate.
_BAD_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|login|menu|nav\w*|breadcrumbs?|pagination|pager|sidebar|side|widget|related|recommend\w*|share|sharing|social|comments?|commentlist|respond|replies|disqus|discussion|footer|header|masthead|toolbar|copyright|legal|complementary|contentinfo|search)(?:$|[\s_-])",
    re.I,
)
_NAME, _STOP = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)"), re.compile("[>\"']")
#: Names of a whole layout, which say what it has and not what it is.
_LAYOUT = re.compile(r"(?:^|(?<=\s))(?:no|has|with|without)[-_]\S+", re.I)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN_NOW = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}
_SPACE = re.compile(r"\s+")
#: Tags that a new one of the kind closes.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

MAX_LINK_SHARE = 0.5
LONG_CHARS, SHORT_CHARS = 200, 70
STOP_HIGH, STOP_LOW = 0.3, 0.1


class Block:
    __slots__ = ("text", "linked", "bad", "main", "label")

    def __init__(self, text: str, linked: int, bad: bool, main: int):
        self.text, self.linked, self.bad, self.main, self.label = text, linked, bad, main, ""


class Tags:
    """The tags of a page, one by one: (begin, end, name or None, attributes).

    A quote keeps its tag open until it closes. Once a search for an end has failed for the rest of the page it isn't
    repeated: from then on a tag ends at the next >, or, where there is none, all that follows is text.
    """

    def __init__(self, page: str):
        self.page, self.quotes = page, True

    def end_of(self, at: int) -> int:
        place = at
        while self.quotes:
            stop = _STOP.search(self.page, place)
            if stop is None:
                break
            if stop[0] == ">":
                return stop.end()
            close = self.page.find(stop[0], stop.end())
            if close < 0:
                break
            place = close + 1
        self.quotes = False
        return self.page.find(">", at) + 1

    def find(self, at: int) -> tuple[int, int, str | None, str] | None:
        page = self.page
        while (begin := page.find("<", at)) >= 0:
            if page[begin + 1 : begin + 2] in ("!", "?"):
                opening, closing = next(x for x in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">")) if page.startswith(x[0], begin))
                close = page.find(closing, begin + len(opening))
                return begin, close + len(closing) if close >= 0 else len(page), None, ""
            if name := _NAME.match(page, begin):
                if not (end := self.end_of(name.end())):
                    return None
                return begin, end, name[1].lower(), page[name.end() : end - 1]
            at = begin + 1
        return None


def blocks_of(page: str) -> list[Block]:
    """The visible blocks of a page in order, character references decoded and white space made one space."""
    out: list[Block] = []
    open_: list[tuple[str, bool, bool, int]] = []  # tag, hidden, bad, number of the innermost article or main element
    n_open: Counter = Counter()
    parts: list[tuple[str, bool]] = []
    links, mains, at, tags = 0, 0, 0, Tags(page)
    top = "", False, False, 0
    _, hidden, bad, main = top

    def end() -> None:
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(x for x, _ in parts))).strip()
            if text:
                linked = len(_SPACE.sub(" ", entities.unescape("".join(x for x, link in parts if link))).strip())
                out.append(Block(text, linked, bad, main))
            parts.clear()

    while True:
        found = tags.find(at)
        text = page[at : found[0] if found else len(page)]
        if text and not hidden:
            parts.append((text, links > 0))
        if found is None:
            break
        begin, at, tag, attributes = found
        if tag is None:
            continue
        closing = page[begin + 1] == "/"
        if tag == "br":
            if not hidden:
                parts.append(("\n", links > 0))
            continue
        if tag == "a":
            links = max(0, links - 1) if closing else 1
            continue
        if tag in BLOCKS or tag in HIDDEN:
            end()
        if closing:
            if n_open[tag]:
                if tag in BLOCKS:
                    links = 0
                while (gone := open_.pop()[0]) != tag:
                    n_open[gone] -= 1
                n_open[tag] -= 1
        elif tag in _RAW:
            close = _RAW[tag].search(page, at)
            at = close.end() if close else len(page)
            continue
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            if tag in _CLOSES and open_ and open_[-1][0] in _CLOSES[tag]:
                n_open[open_.pop()[0]] -= 1
                _, hidden, bad, main = open_[-1] if open_ else top
            named = False
            if attributes and tag in BLOCKS | {"span", "section"} and tag not in ("body", "html", "main"):
                named = any(_BAD_NAMES.search(_LAYOUT.sub("", next(x for x in (m[1], m[2], m[3], "") if x is not None))) for m in _NAMES.finditer(attributes))
            if tag in MAIN_TAGS:
                mains += 1
            inner_head = tag == "header" and main > 0  # the heading of an article is part of it
            open_.append((tag, hidden or tag in HIDDEN or bool(attributes and _HIDDEN_NOW.search(attributes)), bad or ((tag in BAD_TAGS or named) and not inner_head), mains if tag in MAIN_TAGS else main))
            n_open[tag] += 1
        _, hidden, bad, main = open_[-1] if open_ else top
    end()
    return out


def stop_words(text: str) -> tuple[int, int]:
    """How many of a text's words are stop words, and how many words it has."""
    words = text.lower().split()
    return sum(w.strip(".,;:!?()\"'«»") in STOP_WORDS for w in words), len(words)


def judge(block: Block, stops: float, known: bool) -> str:
    """Pass one, for a block outside boilerplate markup and not mostly links: good, bad, or short where it says too little
    by itself. stops: its share of stop words; known: they tell the page's language."""
    if not known:
        return "good" if len(block.text.encode()) >= LONG_CHARS else "short"
    if len(block.text) < SHORT_CHARS:
        return "short"
    if stops >= STOP_HIGH or len(block.text) >= LONG_CHARS and stops >= STOP_LOW:
        return "good"
    return "short" if block.main or stops >= STOP_LOW else "bad"


def neighbours(blocks: list[Block], labels: list[str], step: int) -> list[tuple[str, int]]:
    """Of each block, the nearest decided one on one side: label and place; in one sweep.

    Inside an article or main element its edge stands in for what lies outside, and markup that is boilerplate within it
    isn't asked, for it says nothing of the text around it. At the page's own edge there is no label.
    """
    n = len(blocks)
    out = [("", 0)] * n
    outside, inside, run = ("", -1), ("", -1), 0
    for i in range(n) if step < 0 else range(n - 1, -1, -1):
        b = blocks[i]
        if b.main != run:
            run, inside = b.main, ("good", i + step)
        out[i] = inside if run else outside
        if labels[i] != "short":
            outside = labels[i], i
            if not b.bad:
                inside = outside
    return out


def settled(blocks: list[Block]) -> list[str]:
    """Pass two: a short block takes the label of its nearest decided neighbours before and behind it."""
    counts = [None if b.bad or b.linked > MAX_LINK_SHARE * len(b.text) else stop_words(b.text) for b in blocks]
    known = sum(c[0] for c in counts if c) >= STOP_LOW * sum(c[1] for c in counts if c)
    labels = ["bad" if c is None else judge(b, c[0] / c[1], known) for b, c in zip(blocks, counts, strict=True)]
    out = list(labels)
    for i, ((before, p), (behind, q)) in enumerate(zip(neighbours(blocks, labels, -1), neighbours(blocks, labels, 1), strict=True)):
        if labels[i] == "short":
            if not (before and behind):  # the page's own edge says nothing; a page without any decided block keeps its blocks
                out[i] = before or behind or "good"
            else:
                d, e = i - p, q - i
                out[i] = before if before == behind else (before if d < e else behind if e < d else "good" if blocks[i].main else "bad")
    return out


def settle(blocks: list[Block]) -> None:
    for b, label in zip(blocks, settled(blocks), strict=True):
        b.label = label


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    settle(blocks)
    return "\n".join(b.text for b in blocks if b.label == "good")


def html_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: its id, url, text (empty if there is none) and n_chars.

    A null or empty html gives the empty text; markup that is cut off or never closed is read to its end, and a page of any
    length in time in proportion to it. Repeated rows give
    a row each, an empty table none; further columns are left out. No shuffle.
    """

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x or "") for x in batch.column("h").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("u"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    schema = f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long"
    return pages.select(F.col(id_col).alias("i"), F.col(url_col).alias("u"), F.col(html_col).alias("h")).mapInArrow(run, schema)
