"""Operators that look at one text or page at a time."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import bpe, html_blocks, langid, media, pii, quality
from tessella.llm.common import utf8

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = "doc_id long, text string, lang string, source string, n_chars long, ids string, score string, x string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns with clashing names."""
    long = "The house of the night and the day. " * 4000
    rows = [(1, None, None, None, None), (None, "of the and", "en", None, 3), (2, "", "en", "a", 0), (3, long, "en", "a", 5), (3, long, "en", "a", 5), (4, "12 +- ", "de", "b", 6), (5, "der und die nicht", "de", "b", 7)]
    return spark.createDataFrame([(*r, "i", "s", "x") for r in rows], ODD)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder(RANKS, public_tokenizers.PATTERN)


def test_bpe_equals_the_library(reference, encoder):
    random.seed(5)
    parts = [" ", "  ", "a", "the", "ing", "'s", "\n", "\t", "é", "日本", "1", "٣", "!!", "\x1c", "\x85", " ", "😀", "é", "Ⅷ", "_", "İ"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 25))) for _ in range(1500)]
    texts += ["ab" * 3000 + "é" * 700, "x" * 5000, "", " ", "word " * 3]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_all(texts)] == [reference.encode_ordinary(x) for x in texts]


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60))
def test_bpe_round_trip(text):
    own = bpe.encoder(RANKS, public_tokenizers.PATTERN)
    assert own.decode(own.encode(text)) == text.encode("utf-8", "replace")


@settings(max_examples=80, deadline=None)
@given(st.binary(min_size=1, max_size=70))
def test_bpe_two_ways_of_merging_agree(piece):
    own = bpe.encoder(RANKS, public_tokenizers.PATTERN)
    assert np.frombuffer(own.merges([piece])[0], "<u4").tolist() == bpe.merge(piece, own.ranks)


def test_bpe_columns(odd, reference):
    got = bpe.with_decoded(bpe.with_tokens(odd, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == odd.count()
    for r in got:
        assert r["ids"] == reference.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    digests = bpe.round_trip_digests(odd, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(r["n_tokens"] for r in digests) == sorted(len(r["ids"]) for r in got)
    assert bpe.round_trip_digests(odd.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def brute_spans(text):
    import re

    out = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        total = sum(int(c) if k % 2 == 0 else (int(c) * 2 - 9 * (int(c) > 4)) for k, c in enumerate(reversed(digits)))
        if 16 <= len(digits) <= 19 and total % 10 == 0:
            out.append(f"card:{m.start()}:{m.end()}")
    return ",".join(out + [f"phone:{m.start()}:{m.end()}" for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15])


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab.@-_+ 0123456789()é\n", max_size=60))
def test_pii_base_equals_the_patterns(text):
    assert pii.written(pii.detect(text)) == brute_spans(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab.@-[]+ 01239()é​４аt", max_size=40))
def test_pii_keeps_base_spans_and_maps_offsets(text):
    base, added = pii.find(text)
    assert pii.written(base) == brute_spans(text)
    assert all(0 <= a < b <= len(text) for _, a, b in added)


@pytest.mark.parametrize(
    "text, kind, span",
    [
        ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
        ("reach jane at mail dot example dot org today", "email", "jane at mail dot example dot org"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("j​oe@ex­ample.com", "email", "j​oe@ex­ample.com"),
        ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("call plus one two three four five six seven eight nine zero", "phone", "plus one two three four five six seven eight nine zero"),
        ("it is one nine two dot one six eight dot one dot one, yes", "ip", "one nine two dot one six eight dot one dot one"),
    ],
)
def test_pii_deobfuscation(text, kind, span):
    base, added = pii.find(text)
    assert not base and [(k, text[a:b]) for k, a, b in added] == [(kind, span)]
    assert span not in pii.redacted(text)


def test_pii_leaves_prose_alone():
    for text in ("We meet at noon. They dot the i at home.", "Un un un un deux. Eins zwei drei vier.", "version 1.2.3 of (at) least", "привет мир"):
        assert pii.find(text) == ([], [])


@pytest.mark.parametrize(
    "text, kind, span",
    [
        ("write to john.doe at example.com today", "email", "john.doe at example.com"),
        ("joe@mail dot example.org it is", "email", "joe@mail dot example.org"),
        ("call plus one twо thr\u200bee four five six seven eight nine zero", "phone", "plus one twо thr\u200bee four five six seven eight nine zero"),
        ("it is оne nine twо dot оne six eight dot оne dot оne, yes", "ip", "оne nine twо dot оne six eight dot оne dot оne"),
        ("call plus \u017feven \u017fix five four three two one nine now", "phone", "plus \u017feven \u017fix five four three two one nine"),
        ("jane а\u200bt mail dоt example dot org", "email", "jane а\u200bt mail dоt example dot org"),
    ],
)
def test_pii_disguises_that_combine(text, kind, span):
    base, added = pii.find(text)
    assert not base and [(k, text[a:b]) for k, a, b in added] == [(kind, span)]


def test_pii_leaves_numbers_after_at_alone():
    for text in ("It starts at 10.30 today.", "sold at 3.50, not (at all) less", "from 9 at 10.30pm", "runs at 2.5.1 (always)"):
        assert pii.find(text) == ([], [])


_PIECES = ["john", ".", " ", "  ", " at ", "at", "@", " dot ", "dot", "[at]", " (dot) ", "{ät}", "<punkt>", "example", "com", "а", "\u200b", "ｏ", "one", "two ", "three, ", "four", "plus ", "\u017feven ", "s\u0130x ", "s\u0131x ", "nine", "-", "．", "［", "］", "\u212a", "pun\u212at", "7"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(_PIECES), max_size=24).map("".join))
def test_pii_gates_refuse_nothing(text):
    """Equal to the path that runs every transducer on every text."""
    gated = pii.find(text)
    with pytest.MonkeyPatch.context() as patch:
        for gate in ("_may_bracket", "_may_spell", "_may_speak"):
            patch.setattr(pii, gate, lambda _: True)
        assert pii.find(text) == gated


def test_pii_columns(spark, odd):
    got = odd.select(pii.spans(utf8("text")).alias("p")).select("p.*").collect()
    assert len(got) == odd.count() and all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in got)
    df = spark.createDataFrame([("a@b.co and 1.2.3.4",), (None,), ("",)], "text string")
    assert [r["text"] for r in pii.redact(df).collect()] == ["<EMAIL> and <IP>", None, ""]


def test_media_round_trip():
    for text in (b"", b"x" * 192, b"y" * 193, "é".encode() * 5000):
        padded = media.payload(text)
        assert len(padded) % 192 == 0 and padded and padded.startswith(text) and set(padded[len(text) :]) <= {32}
        stored = media.encode(padded)
        assert media.decode(stored) == padded and len(stored) == len(padded) + 44
    assert not len(media.landmarks(media.peaks(b"\x80" * 4096)))


def test_media_fingerprint_finds_a_tone():
    t = np.arange(8 * media.FRAME)
    tone = (128 + 100 * np.sin(2 * np.pi * 40 * t / media.FRAME)).astype(np.uint8).tobytes()
    found = media.peaks(tone)
    assert (found[:, 1] == 40).all()
    marks = media.landmarks(found)
    assert (np.diff(marks) >= 0).all() and (marks >> 32).max() == 6
    assert np.array_equal(media.landmarks(media.peaks(tone)), marks)


def test_media_short_texts_and_frame_edges_count():
    rng = np.random.default_rng(5)
    words = ["river", "lamp", "of", "the", "seven", "cold", "orchard", "under", "glass", "tune"]
    features = lambda x: media.landmarks(media.peaks(media.payload(x)))
    # texts of one frame
    texts = {" ".join(rng.choice(words, 30)).encode()[:180] for _ in range(40)}
    marks = [features(x).tobytes() for x in texts]
    assert all(marks) and len(set(marks)) > 0.9 * len(texts)
    # a passage at another offset modulo the frame keeps some of its pairs
    passage = rng.integers(0, 2, 8 * media.FRAME, dtype=np.uint8) * 60 + 40
    pairs = lambda x: set((features(x.tobytes()) & (1 << 22) - 1).tolist())
    moved = pairs(np.concatenate([passage[-media.FRAME // 2 :], passage]))
    assert len(pairs(passage) & moved) > 0.5 * len(pairs(passage))
    # a burst around a boundary of frames is seen
    t = np.arange(8 * media.FRAME)
    burst = 128 + 100 * np.sin(2 * np.pi * 40 * t / media.FRAME) * (np.abs(t - 4 * media.FRAME) < 40)
    assert (media.peaks(burst.astype(np.uint8).tobytes())[:, 1] >= 0).any() and len(features(burst.astype(np.uint8).tobytes()))


def test_media_columns(odd):
    rows = odd.select("text", media.described(utf8("text")).alias("m"), media.wav(utf8("text")).alias("w")).withColumn("f", media.fingerprint(F.col("w"))).collect()
    assert len(rows) == odd.count()
    for r in rows:
        padded = media.payload((r["text"] or "").encode())
        assert r["m"]["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["m"]["tail_crc32"] == zlib.crc32(padded[-16:])
        assert r["m"]["media_sha256"] == hashlib.sha256(r["w"]).hexdigest() and r["m"]["n_landmarks"] == len(r["f"])


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="no-sidebar">
<nav><ul><li><a href="/a">Menu</a></ul></nav><!-- ad --><div class="ad">Buy &amp; go</div><div id="cookie-notice">We use cookies</div>
<article><h1>The &lt;Title&gt;</h1><p><b>One<br><p>Two\n  &nbsp; three &eacute;</p><ul><li>Item</ul><form>Name <input></form><div class="comments">First!</div></article>
<aside>Other</aside><footer>&copy; us</footer></body></html>"""


def test_html_article():
    assert html_blocks.main_text(PAGE) == "The <Title>\nOne\nTwo three é\nItem"


def test_html_without_article():
    long = "This is the long text of a page and it has the words that are in every text of the language. "
    page = f"<div><a href=x>Home</a> <a href=y>News</a></div><h2>Heading</h2><div>{long}</div><p>Short one.</p><div>{long}</div><div><a href=z>More of the same and the other to read on and on in the list</a></div><p>(c) 2020</p><div>© All rights</div>"
    assert html_blocks.main_text(page) == f"Heading\n{long.strip()}\nShort one.\n{long.strip()}"


@pytest.mark.parametrize("page, text", [("", ""), ("plain", "plain"), ("<p>cut &am", "cut &am"), ("<article><p>a</p><p", "a"), ("<!-- open", ""), ("<p>a<br><br>b", "a\nb"), ("<script>x", ""), ("a < b <c>d", "a < b d")])
def test_html_odd_pages(page, text):
    assert html_blocks.main_text(page) == text


def test_html_is_linear():
    assert html_blocks.main_text("<div " * 20000) == "" and html_blocks.main_text('<a href="' * 5000) == ""
    assert len(html_blocks.main_text("<p>x</p>" * 20000)) == 39999


def test_html_column(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, PAGE)], "page_id long, html string")
    assert [r[0] for r in df.select(html_blocks.extracted(utf8("html"))).collect()][:2] == ["", ""]


TRAIN = [("en", "the house of the night and the day was in the wind"), ("de", "das haus der nacht und der tag war in dem sturm"), ("ru", "дом и ночь была на ветру")]


@pytest.fixture(scope="module")
def languages(spark):
    df = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(TRAIN * 20)], "doc_id long, text string, lang string")
    return langid.fit(df)


def test_language_spans(languages):
    labeller = langid.Labeller(languages)
    english, german, russian = (t + " " for _, t in TRAIN)
    text = english * 6 + german * 6 + russian * 6
    assert [(text[a:b].split()[0], lang) for a, b, lang in labeller.spans(text)] == [("the", "en"), ("das", "de"), ("дом", "ru")]
    words = labeller.words(text)
    labeller.learn(set(words))
    scores = labeller.scores[[labeller.place[w] for w in words]]

    def worth(path):
        return scores[np.arange(len(path)), path].sum() - langid.SWITCH * (np.diff(path) != 0).sum()

    best = worth(labeller.path(scores))
    assert all(best >= worth(np.full(len(words), k)) for k in range(3))


def test_language_path_is_the_best(languages):
    import itertools

    labeller = langid.Labeller(languages)
    rng = np.random.default_rng(3)
    for _ in range(60):
        scores = rng.normal(0, 14, (6, 3))
        path = labeller.path(scores)
        value = lambda p: scores[np.arange(6), list(p)].sum() - langid.SWITCH * sum(a != b for a, b in zip(p, p[1:]))
        assert value(path.tolist()) >= max(map(value, itertools.product(range(3), repeat=6))) - 1e-9


def test_language_columns(spark, odd, languages):
    rows = odd.select("text", langid.predicted(spark, languages, utf8("text")).alias("p")).collect()
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["p"]["lang_pred"] == "und") == (not letters) and 0 <= r["p"]["score"] <= 1
    nothing = langid.fit(odd.limit(0))
    assert {r[0]["lang_pred"] for r in odd.select(langid.predicted(spark, nothing, utf8("text"))).collect()} == {"und"}
    strange = spark.createDataFrame([("καλημέρα κόσμε",)], "text string")
    found = strange.select(langid.predicted(spark, languages, utf8("text")).alias("p")).first()["p"]
    assert found["lang_pred"] in {"en", "de", "ru"} and found["score"] == 0


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    from tessella.llm.common import held_out

    model = langid.fit(docs.filter(~held_out("doc_id")))
    rows = docs.filter(held_out("doc_id")).select("lang", langid.predicted(spark, model, utf8("text")).alias("p")).collect()
    assert np.mean([r["lang"] == r["p"]["lang_pred"] for r in rows]) > 0.95


def test_quality_model():
    rng = np.random.default_rng(0)
    model = quality.Model(0.5, np.array([[0.0, 0.0], [3.0, 0.0]]), np.array([np.eye(2), np.eye(2)]), np.zeros(2))
    scores = model.scores(np.array([[0.0, 0.0], [1.5, 9.0], [3.0, 0.0]]))
    assert scores[0] < 0.5 < scores[2] and abs(scores[1] - 0.5) < 1e-9
    assert (quality.Model(0.25).scores(rng.normal(size=(4, 18))) == 0.25).all()


def test_quality_sums(spark):
    rng = np.random.default_rng(1)
    size = len(quality.NAMES)
    x = np.concatenate([rng.normal(0, 1, (80, size)), rng.normal(1.5, 2, (120, size))])
    y = [0] * 80 + [1] * 120
    df = spark.createDataFrame([(r.tolist(), k) for r, k in zip(x, y)], "x array<double>, y int").repartition(5)
    model = quality.fit(df)
    assert np.allclose(model.means[0], x[:80].mean(axis=0)) and abs(model.prior - 0.6) < 1e-9
    assert ((model.scores(x) > 0.5) == np.array(y)).mean() > 0.95
    assert quality.fit(df.filter("y = 1")).means is None and quality.fit(df.limit(0)).prior == 0.5


def test_quality_columns(spark, odd):
    rows = odd.select(quality.stated(utf8("text")).alias("x")).collect()
    assert all(len(r["x"]) == len(quality.NAMES) and np.isfinite(r["x"]).all() for r in rows)
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, None), (None, 1), (4, 7)], "doc_id long, quality int")
    assert [tuple(r) for r in quality.one_label(labels).collect()] == [(1, 1)]


def test_quality_held_out(spark):
    from tessella.llm.queries import op3_quality

    got = op3_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.95


@pytest.mark.parametrize("pattern", [r"\w+ \w+|\s|\S", r"(\w)+|\s+|[^\w\s]", r"[^ ]+| +", r"\p{L}+"])
def test_bpe_of_any_pattern(pattern):
    """Patterns whose pieces cross spaces, have groups, or leave text out."""
    encoder = bpe.Encoder(RANKS, pattern)
    reference = tiktoken.Encoding("any", pat_str=pattern, mergeable_ranks=encoder.ranks, special_tokens={})
    for text in ("the house of the night", "a  b c, d e", " x y z ", "one two three four five six"):
        assert encoder.encode(text) == reference.encode_ordinary(text)
