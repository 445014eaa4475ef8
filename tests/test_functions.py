"""Scalar functions on edge rows, with expectations worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import extracts, origins, text
from tessella.functions import frontmatter as fmt
from tessella.operators import selection, status


@pytest.fixture(scope="module")
def ask(spark):
    """Value of an expression on one text."""

    def run(build, *values):
        df = spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values))))
        return df.select(build(*[F.col(f"c{k}") for k in range(len(values))]).alias("v")).first()["v"]

    return run


@pytest.mark.parametrize(
    "note, fm, body",
    [
        ("plain", {}, "plain"),
        ("---\n---\nx", {}, "---\n---\nx"),
        ("---\na: 1\na: 2\n---\nx", {"a": "2"}, "x"),
        ('---\nurl: "http://a:b"\nno colon here\n  kid: "say \\"hi\\""\nq: "\n---\n\nx\n', {"url": "http://a:b", "kid": 'say \\"hi\\"', "q": '"'}, "x\n"),
        ("---  \nt:  spaced  \n--- \nb---\n", {"t": "spaced"}, "b---\n"),
        (" ---\na: 1\n---\nx", {}, " ---\na: 1\n---\nx"),
        ("---\na: 1\n---", {}, "---\na: 1\n---"),
    ],
)
def test_frontmatter(ask, note, fm, body):
    assert ask(fmt.parsed, note) == fm and ask(fmt.body, note) == body


def test_frontmatter_back(ask):
    note = '---\ntitle: "a: b"\nvalue: 3\nempty: \ntitle: last "one"\n---\n\n\nBody'
    out = ask(lambda c: fmt.serialized_pairs(fmt.updated(fmt.pairs(c), status=F.lit("it's"), value=F.lit("4")), fmt.body(c)), note)
    assert out == '---\ntitle: "last \\"one\\""\nvalue: 4\nempty: \nstatus: "it\'s"\n---\nBody'
    assert ask(lambda c: fmt.serialized_pairs(fmt.pairs(c), c), "x") == "---\n---\nx"
    assert ask(lambda c: F.concat_ws("|", fmt.list_value(c)), '[a, "b c",]') == "a|b c"


@pytest.mark.parametrize("value, number", [("3", 3), (" 4 ", 4), ("4.0", 0), ("", 0), ("high", 0), ("-2", -2), ("99999999999", 0)])
def test_integer(ask, value, number):
    assert ask(lambda c: fmt.integer(F.create_map(F.lit("v"), c), "v"), value) == number
    assert ask(lambda c: fmt.integer(F.create_map(F.lit("v"), c), "w"), value) == 0


@pytest.mark.parametrize(
    "url, origin, kind",
    [
        ("https://example.com/article", "url", "article"),
        ("https://youtube.com/watch?v=abc123", "youtube", "video"),
        ("https://youtu.be/abc123", "youtube", "video"),
        ("https://www.youtube.com/watch?v=dQw4w9WgXcQ", "youtube", "video"),
        ("https://arxiv.org/pdf/2401.12345.pdf", "pdf", "paper"),
        ("https://example.com/download.pdf?v=2", "pdf", "paper"),
        ("https://example.com/a.pdf#p2", "pdf", "paper"),
        ("https://example.com/a.PDF", "url", "article"),
        ("https://example.com/a.pdfx", "url", "article"),
        ("https://example.com/a.pdf\n", "url", "article"),
        ("https://youtube.com/embed/x", "url", "article"),
        ("https://z.com/?u=youtu.be/", "youtube", "video"),
    ],
)
def test_origin(ask, url, origin, kind):
    assert ask(origins.url_origin, url) == origin
    assert ask(lambda c: origins.source_type(origins.url_origin(c)), url) == kind


@pytest.mark.parametrize(
    "given, manifest, path, source, ident, url, file, probe, want",
    [
        ("book", "m", None, None, None, None, None, None, "book"),
        (None, "m", "p", None, None, "u", None, None, "batch"),
        (None, None, "p", None, None, "u", None, None, "ref:vault"),
        (None, None, None, "s", "i", "u", None, None, "ref:mcp"),
        (None, None, None, "s", "", "u", None, None, "url"),
        (None, None, None, None, None, "", "a/b.pdf", None, "pdf"),
        (None, None, None, None, None, None, "a/b.bin", "mov,mp4,m4a", "audio"),
        (None, None, None, None, None, None, "a/b.bin", None, "file"),
        ("", None, None, None, None, None, None, None, None),
    ],
)
def test_origin_precedence(ask, given, manifest, path, source, ident, url, file, probe, want):
    assert ask(lambda *c: origins.origin(*c), given, manifest, path, source, ident, url, file, probe) == want


def test_source_types(ask):
    assert [ask(origins.source_type, o) for o in ("audio", "book", "idea", "text", "ref:vault", "ref:mcp", "batch", "odd")] == ["podcast", "book", "idea", "article", "document", "document", "", "article"]
    assert ask(lambda a, b: origins.source_type(a, b), "url", "paper") == "paper"


@pytest.mark.parametrize("url, found", [("https://youtube.com/watch?v=dQw4w9WgXcQ&t=1", "dQw4w9WgXcQ"), ("https://youtu.be/dQw4w9WgXcQ", "dQw4w9WgXcQ"), ("https://youtube.com/shorts/a_-b4w9WgXcQzz", "a_-b4w9WgXc"), ("https://youtu.be/abc123", None)])
def test_video_id(ask, url, found):
    assert ask(origins.video_id, url) == found


@pytest.mark.parametrize(
    "title, slug",
    [("Hello,  World!", "Hello-World"), ("Çà et là — é", "Çà-et-là-é"), ("日本 語", "日本-語"), ("!?🙂", "untitled"), ("a_b - c", "a_b-c"), (" x ", "x"), ("a" * 100, "a" * 80), ("--", "-"), ("x² ½", "x²-½")],
)
def test_slug(ask, title, slug):
    assert ask(text.slug, title) == slug


def test_small_texts(ask):
    assert ask(text.hash8, "https://example.com") == "100680ad"
    assert ask(text.sanitized, "a\n=\n===b====") == "a = b="
    assert ask(text.frontmatter_escaped, 'a\\"b') == 'a\\\\\\"b' and ask(text.frontmatter_escaped, None) == ""
    assert ask(text.json_escaped, 'a"\nb') == 'a\\" b'
    assert ask(text.title_from_filename, "x/2024_01-02 A note.md") == "A note" and ask(text.title_from_filename, "x/2024-01-02.md") == "2024-01-02"
    assert [ask(text.folder_hint, p) for p in ("a/b/c/d.md", "b/d.md", "a/b/d.md")] == ["b/c", "b", "a/b"]
    assert [ask(text.stem, p) for p in ("a/b.c.md", ".hidden", "a/x")] == ["b.c", ".hidden", "x"]
    assert ask(lambda c: text.duration(c.cast("double")), "3661.9") == "1:01:01" and ask(lambda c: text.duration(c.cast("double")), "360000") == "100:00:00"
    assert [ask(lambda c: text.duration(c.cast("int")), x) for x in ("0", "59")] == ["0:00:00", "0:00:59"]
    assert ask(lambda c: text.mac_date(c.cast("double")), "0") == "" and ask(lambda c: text.mac_date(c.cast("double")), "86400") == "2001-01-02"
    assert ask(text.date_text, "2024-03-04 05:06:07") == "2024-03-04" and ask(text.date_text, "soon, maybe") == "soon, mayb" and ask(text.date_text, None) == ""
    assert ask(lambda c: text.note_preview(c, F.lit(True)), "x\n## Preview\n\n one\ntwo \n\nthree") == "one\ntwo"
    assert ask(lambda c: text.note_preview(c, F.lit(False)), " a\nb ") == "a b" and ask(lambda c: text.note_preview(c, F.lit(True)), "abc") == ""
    assert sorted(["a-b/x", "a/b"], key=lambda p: p.replace("/", "\x01")) == ["a/b", "a-b/x"] and ask(text.path_key, "a/b") == "a\x01b"


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>one</p><SCRIPT>two</SCRIPT>", "one\n\ntwo"),
        ("<head>no</head><body class=x><h1>Title</h1>ok<br>a &amp;lt; b</body>tail", "Title\n\na < b"),
        ("<script>x</p></script>text&nbsp;here", "text here"),
        ("<param>pre<pre>fix</pre> text", "pre\n\nfix\n\ntext"),
        ("<b>in</b>line  \t text", "in line text"),
        ("", ""),
    ],
)
def test_html_text(ask, html, want):
    assert ask(text.html_text, html) == want


@pytest.mark.parametrize("line, value", [('k: "a b"  # c', "a b"), ("k: 'x'", "x"), ("k: a#b", "a"), ("k: ~/v ", "~/v"), ("k: \"'q'\"", "q"), ('k: "half', "half")])
def test_config_value(ask, line, value):
    assert ask(lambda c: text.config_value(c, "k"), line) == value


@pytest.mark.parametrize(
    "fm, wide, narrow",
    [
        ({}, True, False),
        ({"status": "classified"}, False, False),
        ({"status": "keep"}, False, False),
        ({"status": "unclassified", "value": "3"}, True, True),
        ({"status": "maybe"}, True, False),
        ({"value": ""}, False, False),
        ({"title": "x"}, True, False),
    ],
)
def test_needs_classification(spark, fm, wide, narrow):
    df = spark.createDataFrame([(fm,)], "fm map<string,string>")
    assert tuple(df.select(selection.needs_classification(F.col("fm"), True), selection.needs_classification(F.col("fm"), False)).first()) == (wide, narrow)


def test_names_and_places(ask):
    assert [ask(selection.is_item, p) for p in ("a/README.md", "a/My Import Log 2.md", "a/playbook.md", "a/_meta/x.md")] == [False, False, True, True]
    assert ask(lambda c: selection.is_item(c, playbook=False), "a/Playbook.md") is False and ask(lambda c: selection.is_item(c, meta=False), "_attachments/x.md") is False
    assert ask(selection.is_extracted, "x\nstatus: extracted-ish") is True and ask(selection.is_extracted, " status: extracted") is False
    assert ask(lambda c: selection.open_tab(c, F.lit(0), F.lit(None)), "HTTP://x") is True and ask(selection.web_address, "HTTP://x") is False
    assert ask(status.title_line, 'a\ntitle:  "T" x\ntitle: y') == "T x" and ask(status.title_line, None) == "untitled" and ask(status.title_line, "title:") == ""


def test_extract_bodies(spark):
    body = "### Key Ideas\n- **One** #a/b-c — short claim\n- **Two** #Bad — " + "w " * 17 + "\n- no idea\n### Connections\n- [[x]] — why\n[[y z]]\n### Raw Quotes\n> \"q\" — A\n> not\n### Key Ideas\nagain"
    df = spark.createDataFrame([(1, body, "idea"), (2, "", "article"), (3, body, "odd")], "id long, body string, kind string")
    ideas = extracts.key_ideas(df.filter("id = 1"), "body", "id").collect()
    assert [(r["title"], r["domain"], r["words"], r["domain_ok"], r["claim_ok"]) for r in ideas] == [("One", "a/b-c", 2, True, True), ("Two", "Bad", 17, False, False)]
    assert [(r["topic"], r["why"]) for r in extracts.connections(df.filter("id = 1"), "body", "id").collect()] == [("x", "why"), ("y z", "")]
    assert [(r["quote"], r["author"]) for r in extracts.quotes(df.filter("id = 1"), "body", "id").collect()] == [("q", "A")]
    assert df.filter("id = 1").select(extracts.sections(F.col("body")).alias("s")).first()["s"]["Key Ideas"] == "again"
    checks = {r["id"]: r for r in df.select("id", *extracts.conformance(F.col("body"), F.col("kind"))).collect()}
    assert (checks[1]["n_ideas"], checks[1]["ideas_ok"], checks[1]["connections_ok"], checks[1]["quotes_ok"]) == (2, True, True, False)
    assert checks[2]["ideas_ok"] is False and checks[3]["ideas_ok"] is None
    assert spark.createDataFrame([("- [ ] do\n- [x] done\n- plain",)], "s string").select(extracts.list_items(F.col("s")).alias("v")).first()["v"] == ["do", "done", "plain"]
