"""Main text against a plain two-pass version on a parse by the standard library, and on pages without telling markup."""

import re
from collections import Counter
from html.parser import HTMLParser

import pytest

from tessella.llm import html_blocks
from tessella.llm import queries

SF = "/root/testdata/sf0.01"
OUTSIDE = {"nav", "footer", "aside", "form"}
BREAKING = {"p", "li", "ul", "div", "article", "section", "nav", "footer", "aside", "form", "h1", "h2", "body", "html", "head"}


class Cut(HTMLParser):
    """Blocks as [tag, text, linked, in an article, in an element that isn't main text, container]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.found, self.brs, self.homes, self.linked, self.skip = [], [], 0, 0, 0, None
        self.now = self.fresh_block("")

    def fresh_block(self, tag):
        around = [x for x in self.open if x[0] in ("article", "nav", "footer", "aside", "form", "div", "ul", "section")]
        return [tag, "", 0, any(x[0] == "article" for x in around), any(x[1] for x in around), around[-1][2] if around else 0]

    def close(self, tag=""):
        self.now[1] = " ".join(self.now[1].split())
        if self.now[1]:
            self.found.append(self.now)
        self.now, self.brs = self.fresh_block(tag), 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title"):
            self.skip = tag
        elif tag == "br":
            self.now[1] += " "
        elif tag == "a":
            self.linked += 1
        elif tag in BREAKING:
            self.homes += 1
            self.open.append((tag, tag in OUTSIDE or dict(attrs).get("class") == "ad", self.homes))
            self.close(tag)

    def handle_endtag(self, tag):
        if tag == self.skip:
            self.skip = None
        elif tag == "a":
            self.linked -= 1
        elif tag in BREAKING:
            if any(x[0] == tag for x in self.open):
                while self.open.pop()[0] != tag:
                    pass
            self.close()

    def handle_data(self, data):
        if not self.skip:
            self.now[1] += data
            self.now[2] += len(data.strip()) * bool(self.linked)


def brute(page):
    """The two passes over a page, each ambiguous block against every other."""
    cut = Cut()
    cut.feed(page)
    cut.close()
    blocks, labels = cut.found, []
    for tag, text, linked, article, named, _ in blocks:
        words = re.findall(r"[^\W\d_]+", text.lower())
        if linked / len(text) >= 0.4:
            labels.append(None if article and not named else 0)
        elif text.startswith("©"):
            labels.append(0)
        elif tag in ("h1", "h2") or len(words) < 15 and len(text) < 120:
            labels.append(None)
        else:
            labels.append(1 if sum(w in html_blocks.STOP_WORDS for w in words) / len(words) >= 0.1 else None)
    told = any(b[3] and not b[4] and label == 1 for b, label in zip(blocks, labels))
    labels = [0 if b[4] or told and not b[3] else label for b, label in zip(blocks, labels)]
    out = []
    for k, (b, label) in enumerate(zip(blocks, labels)):
        if label is None:
            decided = [j for j in range(len(blocks)) if labels[j] is not None]
            same = [j for j in decided if blocks[j][5] == b[5]]
            heard = same or [j for j in decided if not b[3] or blocks[j][3]]
            label = labels[min(heard, key=lambda j: (abs(j - k), j < k))] if heard and 1 in labels else 1
        out += [b[1]] * label
    return "\n".join(out)


@pytest.fixture(scope="module")
def pages(spark):
    return [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect()]


def without_markup(page):
    """No article or main element, and no class, id or role."""
    return re.sub(r'\s(?:class|id|role)=(?:"[^"]*"|\'[^\']*\')', "", re.sub(r"</?(?:article|main)[^>]*>", "", page))


def test_query_equals_brute_force(spark, pages):
    rows = queries.op6_main_text(spark, SF).orderBy("page_id").collect()
    assert len(rows) == len(pages) >= 200
    for row, page in zip(rows, pages):
        assert row["text"] == brute(page) and row["n_chars"] == len(row["text"])
    stripped = [without_markup(p) for p in pages]
    assert [html_blocks.main_text(p) for p in stripped] == [brute(p) for p in stripped]


def test_rules_find_the_article_without_its_markup(pages):
    both = kept = wanted = 0
    for page in pages:
        found = Counter(html_blocks.main_text(without_markup(page)).split("\n"))
        want = Counter(html_blocks.main_text(page).split("\n"))
        both, kept, wanted = both + sum((found & want).values()), kept + found.total(), wanted + want.total()
    assert both / kept > 0.99 and both / wanted > 0.99


def test_every_rule_decides(pages):
    rules = Counter()
    for page in pages:
        found = html_blocks.blocks(page)
        judged = html_blocks.first_pass(found)
        labels = html_blocks.second_pass(found, [label for label, _ in judged])
        rules.update("neighbours" if label is None else rule for label, rule in judged)
        assert None not in labels
    total = rules.total()
    assert min(rules["links"], rules["stops"], rules["neighbours"]) > 0.2 * total and rules["markup"] < 0.1 * total


LONG = "This is the long text of a page and it has the words that are in every text of the language. "


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<div class=comments><p>{LONG}</p></div><p>{LONG}</p>", LONG.strip()),  # reader comments are prose, too
        (f"<article><p>{LONG}</p><aside><p>{LONG}</p></aside><p>x</p></article><div>{LONG}</div>", f"{LONG.strip()}\nx"),
        (f"<article></article><p>{LONG}</p>", LONG.strip()),  # an article without text tells nothing
        ("<nav><a>x</a></nav><article><h1>T</h1><p>short</p></article><footer>© z</footer>", "T\nshort"),
        (f"<article><p>{LONG}</p><p><a href=x>{LONG}</a></p></article>", f"{LONG.strip()}\n{LONG.strip()}"),
        (f"<div>{LONG}</div><div><a href=x>{LONG}</a></div><p>ambiguous</p>", LONG.strip()),
        (f"<p>ambiguous</p><div><a href=x>links</a></div><div>{LONG}</div>", LONG.strip()),  # nearest decided block is out
        (f"<p>{LONG}</p><div><a href=x>a b</a></div><p>ambiguous</p>", f"{LONG.strip()}\nambiguous"),  # of its container, one is in
        ("漢字" * 80, "漢字" * 80),
    ],
)
def test_rules(page, text):
    assert html_blocks.main_text(page) == text


def test_closing_tags_are_linear():
    assert html_blocks.main_text("<div>" * 60_000 + "x" + "</section>" * 60_000) == "x"
    assert html_blocks.main_text("<div>x</article></div>" * 20_000).count("x") == 20_000
