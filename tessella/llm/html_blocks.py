"""Main text of HTML pages by block rules in two passes.

A page is cut into blocks at block-level tags. Pass one judges every block by three measures: link density (blocks that are
mostly links are out), length (short blocks and headings are ambiguous) and stop-word density (of the others, those with enough stop
words are in, and the rest are ambiguous). Pass two gives an ambiguous block the label of the nearest decided block of its
container, or of the page if there is none there; of two as near the one that follows decides. If nothing on the page is let in,
ambiguous blocks are.

Markup is a further measure, which is weighed after those: what the rules would let in is out if it stands in an element whose
tag, class, id or role names a menu, header, footer, sidebar, notice, advert, form or reader comments, or outside the
article element of a page that has one with text let in; and an ambiguous block of an article element isn't put out by its neighbours
outside. Pages without such markup are judged by the three measures alone.

Null and empty pages have empty text. Malformed and cut-off markup is read to its end: an unclosed element lasts as long as
the page, an unclosed tag or comment is markup. Rows that repeat are each extracted alike, and other columns aren't looked at. A page is held by one
task, in time linear in its length; nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Share of a block's characters in links from which the block is out, or in an article ambiguous.
LINKS = 0.4
#: Words, or characters, from which a block is decided by its stop words, and their least share.
LONG, LONG_CHARS = 15, 120
STOP_SHARE = 0.1

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a about after all an and are as at be but by for from had has have he her his i if in into is it its more not of on or
    our she so that the their there they this to was we were what when which who will with you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die du ein eine einem einen einer er es für hat ich ihr im
    in ist ja kann mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wenn wer wie wir wird zu zum zur
    ai au aux avec ce ces comme dans de des du elle en est et eux il ils je la le les leur lui mais me même mon ne nos nous on
    ou où par pas plus pour qu que qui sa se ses son sur ta te tu un une vous y été être
    al algo con como de del desde donde dos el ella en entre era es esta este esto ha hay la las le lo los más me mi muy no
    nos o para pero por que qué se ser si sin sobre son su sus también te tiene un una y ya""".split()
)

# HTML elements.
_BLOCK = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary
    table tbody td tfoot th thead tr ul""".split()
)
_HIDDEN = frozenset("script style noscript template title textarea svg math iframe object canvas audio video head".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_OUT = frozenset("nav aside footer form menu dialog button select fieldset".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CONTAINERS = (_BLOCK - _HEADINGS - frozenset("p li dd dt option optgroup tr td th tbody thead tfoot hr caption html body head".split())) | {"a"}

# Words in a class, id or role that name what isn't the article.
_HINTS = frozenset(
    """ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent
    contentinfo cookie cookies copyright discussion disqus footer gdpr header login masthead menu modal nav navbar navigation
    newsletter notice overlay pagination pager popup promo promoted promotion recommended related replies reply respond search
    share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar widget widgets""".split()
)

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)""",
    re.S,
)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORDS = re.compile(r"[^\W\d_]+")
_PARTS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in _HIDDEN}

IN, OUT, OPEN = 1, 0, None


@dataclass
class Block:
    tag: str
    named: bool  # in an element that names what isn't main text
    article: bool
    home: int  # the innermost container
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _hinted(attributes: str) -> bool:
    if "=" not in attributes:
        return False
    return any(_HINTS.intersection(_PARTS.findall(_CAMEL.sub(" ", m[1]).lower())) for m in _NAMED.finditer(attributes))


def blocks(page: str) -> list[Block]:
    """Blocks with text, in page order."""
    found: list[Block] = []
    stack: list[tuple[str, bool, int]] = []  # open containers, whether they name what isn't main text, and the home around them
    opened: Counter[str] = Counter()
    outs = articles = links = breaks = home = homes = 0
    now = Block("", False, False, 0)
    at = 0

    def text(piece: str) -> None:
        nonlocal breaks
        if piece:
            plain = html.unescape(piece) if "&" in piece else piece
            now.parts.append(plain)
            if links:
                now.linked += len(plain.strip())
            if breaks and not plain.isspace():
                breaks = 0

    def fresh(tag: str) -> None:
        nonlocal now, breaks
        breaks = 0
        now.text = " ".join("".join(now.parts).split())
        if now.text:
            found.append(now)
        now = Block(tag, outs > 0, articles > 0, home)

    while m := _MARKUP.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag in _HIDDEN and not closing:
            if tag != "head" and not attributes.endswith("/"):
                end = _END[tag].search(page, at)
                at = end.start() if end else len(page)
            continue
        if tag == "br":
            breaks += 1
            now.parts.append(" ")
            if breaks == 2:
                fresh(now.tag)
            continue
        if tag in _CONTAINERS:
            if closing:
                while opened[tag]:  # what is open within goes with it
                    name, out, around = stack.pop()
                    opened[name] -= 1
                    outs -= out
                    articles -= name in ("article", "main")
                    links -= name == "a"
                    home = around
                    if name == tag:
                        break
            elif tag not in _VOID:
                out = tag != "a" and (tag in _OUT or tag == "header" and not articles or tag not in ("article", "main") and _hinted(attributes))
                stack.append((tag, out, home))
                opened[tag] += 1
                outs += out
                articles += tag in ("article", "main")
                links += tag == "a"
                if tag != "a":
                    homes += 1
                    home = homes
        if tag in _BLOCK:
            fresh("" if closing else tag)
    text(page[at:])
    fresh("")
    return found


def measured(block: Block) -> tuple[int | None, str]:
    """The label of a block by itself, and the rule that gives it."""
    if block.linked >= LINKS * len(block.text):
        return OPEN if block.article and not block.named else OUT, "links"
    if block.text[0] == "©":
        return OUT, "mark"
    words = _WORDS.findall(block.text.lower())
    if len(words) < LONG and len(block.text) < LONG_CHARS or block.tag in _HEADINGS:
        return OPEN, "length"
    stops = sum(map(STOP_WORDS.__contains__, words))
    return IN if stops >= STOP_SHARE * len(words) else OPEN, "stops"


def first_pass(found: list[Block]) -> list[tuple[int | None, str]]:
    """IN, OUT, or OPEN for ambiguous, and the rule that decides, of every block."""
    judged = [measured(b) for b in found]
    article = any(b.article and not b.named and label == IN for b, (label, _) in zip(found, judged))
    for k, block in enumerate(found):
        if judged[k][0] != OUT and (block.named or article and not block.article):
            judged[k] = OUT, "markup"
    return judged


def second_pass(found: list[Block], labels: list[int | None]) -> list[int]:
    """Open labels take that of the nearest decided block."""
    if IN not in labels:
        return [IN if label is OPEN else label for label in labels]
    best: list[tuple[bool, int, bool, int] | None] = [None] * len(labels)  # in another container, distance, before, label
    for before, order in ((True, range(len(labels))), (False, range(len(labels) - 1, -1, -1))):
        last, last_of = None, {}
        for k in order:
            block = found[k]
            if labels[k] is not OPEN:
                last = last_of[block.home] = k
                continue
            for at, apart in ((last_of.get(block.home), False), (last, True)):
                # a block beside an article has no say in it
                if at is not None and not (apart and block.article and not found[at].article):
                    offer = apart, abs(at - k), before, labels[at]
                    best[k] = offer if best[k] is None else min(best[k], offer)
    return [(IN if best[k] is None else best[k][-1]) if label is OPEN else label for k, label in enumerate(labels)]


def main_text(page: str) -> str:
    found = blocks(page)
    labels = second_pass(found, [label for label, _ in first_pass(found)])
    return "\n".join(b.text for b, label in zip(found, labels) if label == IN)


def _extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([main_text(raw.decode("utf-8", "replace")) for raw in batch], dtype=object)


def extracted(page: Column) -> Column:
    """Main text of a column of bytes."""
    return F.pandas_udf(_extract, "string")(page)
