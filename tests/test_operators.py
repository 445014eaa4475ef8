"""Operators, sources and sinks on small fixtures."""

import json
import plistlib
import sqlite3
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tessella.functions import frontmatter as fmt
from tessella.operators import capture, gateway, numbering, routing, scoring, search, selection, sinks, status
from tessella.plans.fixtures import PROFILES
from tessella.sources import bookmarks, media, notes
from tessella.streaming import dump

DAY = date(2026, 1, 15)


def test_numbers_are_consecutive(spark):
    df = spark.createDataFrame([(f"k{(i * 7919) % 5000:05d}",) for i in range(5000)], "k string").repartition(6)
    got = [(r["k"], r["n"]) for r in numbering.numbered(df, F.col("k"), ranges=9).orderBy("k").collect()]
    assert got == [(f"k{i:05d}", i + 1) for i in range(5000)]
    assert numbering.numbered(df.limit(0), F.col("k")).count() == 0
    batches = numbering.batched(spark.range(1, 121).withColumnRenamed("id", "n"), "n", 50).collect()
    assert [(r["batch"], r["item_id"]) for r in batches if r["n"] in (1, 50, 51, 120)] == [(1, "item-0001"), (1, "item-0050"), (2, "item-0001"), (3, "item-0020")]


def test_collisions(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "c")], "id int, name string")
    got = {r["id"]: r["out"] for r in numbering.collision_names(df, "name", F.col("id"), "out").collect()}
    assert got == {1: "a", 2: "a-2", 3: "a-3", 4: "b", 5: "c"}
    taken = spark.createDataFrame([("b.md",), ("c.md",), ("c-2.md",)], "name string")
    got = {r["id"]: r["out"] for r in numbering.collision_names(df, "name", F.col("id"), "out", taken=taken, ext=".md").collect()}
    assert got == {1: "a.md", 2: "a-2.md", 3: "a-3.md", 4: "b-2.md", 5: "c-3.md"}


def test_collision_names_over_ranges(spark):
    """A frequent name, null names, null and repeated order keys; a column _before of the input stays."""
    rows = [(k, "untitled" if k % 3 else None if k % 2 else f"n{k % 5}", None if k == 7 else k // 2, k) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, name string, ord long, _before long").repartition(5)
    for ranges in (1, 4, 50):
        got = numbering.collision_names(df, "name", F.col("ord"), "out", ranges=ranges)
        assert got.columns == [*df.columns, "out"]
        seen = {}
        for r in sorted(got.collect(), key=lambda r: (r["ord"] is not None, r["ord"], int((r["out"] or "").rpartition("-")[2]) if "-" in (r["out"] or "") else 1)):
            k = seen[r["name"]] = seen.get(r["name"], 0) + 1
            assert r["out"] == (None if r["name"] is None else r["name"] + (f"-{k}" if k > 1 else "")) and r["_before"] == r["id"]
        assert sum(seen.values()) == 400
    assert numbering.collision_names(df.limit(0), "name", F.col("ord"), "out").count() == 0


def test_answers(spark):
    said = 'Sure:\n```\n{"id": "item-0001", "category": "ai", "value": 5}\n  {"id": "item-0002", "value": "4"}\n{"id": broken\n{"id": "item-0001", "category": "late"}\n{"id": "item-9999"}\n[1]\n'
    df = spark.createDataFrame([(1, said), (2, None), (3, "")], "batch long, answer string")
    found = scoring.answers(df, scoring.ANSWERS["classify"])
    assert [(r["id"], r["category"], r["value"]) for r in found.orderBy("line_no").collect()] == [("item-0001", "ai", "5"), ("item-0002", None, "4"), ("item-0001", "late", None), ("item-9999", None, None)]
    items = spark.createDataFrame([(b, f"item-000{k}") for b in (1, 2) for k in (1, 2, 3)], "batch long, item_id string")
    joined = {r["item_id"]: r["category"] for r in scoring.joined_back(items, found).collect()}
    assert joined == {"item-0001": "late", "item-0002": None}
    assert {r["batch"]: (r["size"], r["applied"], r["missing"]) for r in scoring.accounts(items, found).collect()} == {1: (3, 2, 1), 2: (3, 0, 3)}


def test_scorer_failures_are_rows(spark):
    class Half:
        def __call__(self, request):
            if "2" in request:
                raise RuntimeError("no answer")
            return "ok " + request

    asked = spark.createDataFrame([(1, 1, "r1"), (2, 1, "r2")], "batch long, size long, request string")
    got = {r["batch"]: (r["answer"], r["error"]) for r in scoring.answered(asked, Half).collect()}
    assert got == {1: ("ok r1", None), 2: (None, "no answer")}


def test_classified_note(spark):
    df = spark.createDataFrame([("x/2024-01-02 Raw.md", "text"), ("y.md", "---\nvalue: 1\ntitle: T\n---\nb")], "path string, content string")
    pairs = scoring.classified(F.col("pairs"), F.col("path"), F.lit(None).cast("string"), F.lit("d"), F.lit(None).cast("string"), F.lit("a: b"))
    got = [r["v"] for r in capture.notes(df).select(fmt.serialized_pairs(pairs, F.col("body")).alias("v")).collect()]
    assert got[0] == '---\ntype: dump-item\nsource: apple-notes\ntitle: Raw\ncategory: other\ndomain: d\nvalue: 1\nreason: "a: b"\nstatus: classified\n---\ntext'
    assert got[1] == '---\nvalue: 1\ntitle: T\ncategory: other\ndomain: d\nreason: "a: b"\nstatus: classified\n---\nb'
    routed = capture.notes(df).select(fmt.serialized_pairs(scoring.routed(F.col("pairs"), F.lit(None).cast("string"), F.lit(None).cast("string")), F.col("body")).alias("v")).collect()
    assert routed[1]["v"].endswith("destination: skip\ndestination_reason: \n---\nb")


def test_auto_skip(spark):
    df = spark.createDataFrame([("a", "---\nvalue: 2\nreason: mine\n---\n"), ("b", "---\nvalue: 4\n---\n"), ("c", "---\nvalue: 1\ndestination_reason: kept\n---\n")], "path string, content string")
    rows = capture.notes(df).withColumn("low", routing.low_value(F.col("fm"), 4)).withColumn("new", F.map_from_entries(routing.auto_skipped(F.col("pairs"), F.col("fm"), 4)))
    got = {r["path"]: (r["low"], r["new"]) for r in rows.collect()}
    assert got["a"] == (True, {"value": "2", "reason": "mine", "destination": "skip", "destination_reason": "auto-skip: value 2 < 4"}) and got["b"][0] is False
    assert got["c"][1] == {"value": "1", "destination_reason": "kept", "destination": "skip", "reason": "below min_value threshold"}


def test_routing_round(spark):
    rows = [("d/a.md", "work"), ("e/a.md", "work"), ("f.md", "skip"), ("g.md", "knowledge"), ("h.md", "later"), ("i.md", "odd")]
    df = spark.createDataFrame([(p, f"---\nsource: web/x\nstatus: classified\ndestination: {d}\ncategory: reference\nurl:  https://u \n---\nB") for p, d in rows], "path string, content string")
    targets = routing.targets_table(spark, {"work": "/w", "later": None, "knowledge_manifest": "/m.json"})
    items = capture.notes(df).withColumn("destination", fmt.value(F.col("fm"), "destination"))
    assert items.filter(selection.executable(F.col("fm"))).count() == 6
    planned = routing.plan(items, targets)
    assert {r["path"]: r["kind"] for r in planned.collect()} == {"d/a.md": "copy", "e/a.md": "copy", "f.md": "skip", "g.md": "knowledge", "h.md": "unconfigured", "i.md": "unconfigured"}
    taken = spark.createDataFrame([("/w", "web-x-a.md")], "target string, name string")
    made = {r["path"]: (r["routed_to"], dict(map(tuple, r["copy_pairs"]))["routed_from_dump"]) for r in routing.copies(planned, F.lit(DAY), taken).collect()}
    assert made == {"d/a.md": ("/w/web-x-a-2.md", "d/a.md"), "e/a.md": ("/w/web-x-a-3.md", "e/a.md")}
    assert [tuple(r) for r in routing.statistics(planned).collect()] == [("knowledge_queued", 1), ("skip_marked", 1), ("work_copied", 2)]
    assert [(r["destination"], r["n"], r["known"]) for r in routing.breakdown(items, targets).collect()] == [("knowledge", 1, True), ("skip", 1, True), ("work", 2, True), ("later", 1, True), ("odd", 1, False)]
    assert [tuple(r) for r in routing.manifest(planned.filter("kind = 'knowledge'")).collect()] == [("url", "https://u", None, "", "document")]
    original = planned.filter("path = 'f.md'").select(F.map_from_entries(routing.original(F.col("pairs"), F.lit(None).cast("string"))).alias("m")).first()["m"]
    assert original["status"] == "routed" and "routed_to" not in original


def test_destinations_and_distribution(spark):
    found = routing.destinations(spark.createDataFrame([(PROFILES,)], "value string"))
    assert [r["destination"] for r in found.collect()] == ["work", "knowledge", "skip", "empty-one"]
    items = spark.createDataFrame([("work",), ("zoo",), ("",), ("work",), ("attic",)], "destination string")
    got = [(r["destination"], r["n"], r["known"]) for r in routing.distribution(items, found).collect()]
    assert got == [("work", 2, True), ("knowledge", 0, True), ("skip", 0, True), ("empty-one", 0, True), ("attic", 1, False), ("zoo", 1, False), ("TOTAL", 4, True)]


def test_gateway(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"url": "https://a.example/x.pdf", "title": "A"}, {"content": "hello", "origin": "text", "title": False}, {"ref_path": "n.md"}, {"ref_source": "s", "ref_id": 7}]))
    rows = gateway.batch_items(notes.read_manifest(spark, str(tmp_path / "m.json")), {"context": "personal"}).orderBy("position").collect()
    assert [(r["origin"], r["source_type"], r["label"], r["context"]) for r in rows] == [
        ("pdf", "paper", "A", "personal"), ("text", "article", "item 2", "personal"), ("ref:vault", "document", "item 3", "personal"), ("ref:mcp", "document", "item 4", "personal")
    ]
    (tmp_path / "bad.json").write_text("not valid json")
    with pytest.raises(Exception):
        notes.read_manifest(spark, str(tmp_path / "bad.json")).collect()
    with pytest.raises(Exception):
        notes.read_manifest(spark, str(tmp_path / "none.json")).collect()
    (tmp_path / "empty.json").write_text("[]")
    assert notes.read_manifest(spark, str(tmp_path / "empty.json")).count() == 0
    results = spark.createDataFrame([(0, "a", True), (2, "c", False), (1, "b", False)], "position int, label string, ok boolean")
    assert tuple(gateway.batch_summary(results).first()) == (3, 1, 2, False)
    assert sorted(map(tuple, gateway.batch_failures(results).collect())) == [(1, "[2] b: gateway failed"), (2, "[3] c: gateway failed")]


def test_requests(spark):
    df = spark.createDataFrame([("youtube", "video", "https://youtu.be/x", "a===b", "me", "h", "b1")], "origin string, source_type string, url string, title string, author string, import_source string, import_batch string")
    df = gateway.template(df, spark.createDataFrame([("paper", "P")], "source_type string, template string"))
    got = df.select(gateway.request(df, reader=F.lit("I read."), template=F.col("template"), instructions="Do.").alias("r")).first()["r"]
    for part in ("Origin: youtube", "Source type: video", "Title: ab", "Author: me", "Content format: transcript", "Import source: h", "Import batch: b1", "I read.", "No template for source type: video", "Do."):
        assert part in got
    lines = spark.createDataFrame([("done",), ("RESULT:path=a=b",)], "line string")
    pairs, rest = gateway.results(lines)
    assert [tuple(r) for r in pairs.collect()] == [("path", "a=b")] and rest.count() == 1
    failed = spark.createDataFrame([("source-add", 'u"\n', datetime(2026, 1, 2, 3, 4, 5))], "action string, url string, ts timestamp")
    letter = json.loads(gateway.dead_letters(failed, F.col("ts")).first()["letter"])
    assert letter["url"] == 'u" ' and letter["timestamp"] == "2026-01-02T03:04:05Z" and set(letter) == {"timestamp", "action", "origin", "url", "file", "context", "session", "error"}


def test_plist(spark, tmp_path):
    leaf = lambda url, **more: {"WebBookmarkType": "WebBookmarkTypeLeaf", "URLString": url} | more
    tree = {"Children": [
        {"Title": "com.apple.ReadingList", "Children": [leaf("https://r", ReadingList={"DateAdded": datetime(2024, 5, 6), "PreviewText": "p"}, URIDictionary={"title": "R"})]},
        {"Title": "Menu", "Children": [{"Children": [leaf("https://m", WebBookmarkUUID="U")]}, {"Title": "Deep", "Children": [leaf("https://d"), leaf("")]}]},
    ]}
    (tmp_path / "b.plist").write_bytes(plistlib.dumps(tree))
    got = capture.bookmarks(bookmarks.read_plist(spark, str(tmp_path / "b.plist"))).collect()
    assert [(r["kind"], r["url"], r["title"], r["uuid"], r["preview"], r["date_added"], r["folder"]) for r in got] == [
        ("reading-list", "https://r", "R", "", "p", "2024-05-06", "com.apple.ReadingList"), ("bookmarks", "https://m", "https://m", "U", "", "", "Menu"), ("bookmarks", "https://d", "https://d", "", "", "", "Menu / Deep")
    ]


def test_tab_databases(spark, tmp_path):
    path = str(tmp_path / "t.db")
    con = sqlite3.connect(path)
    con.executescript("""CREATE TABLE bookmarks(title, url, last_modified, deleted, date_closed, order_index);
      INSERT INTO bookmarks VALUES ('T','HTTP://u',86400.0,0,NULL,2),(NULL,'https://v',NULL,0,NULL,1),('x','https://w',0,1,NULL,3),('y','https://c',0,0,5.0,4),('z','about:x',0,0,NULL,5);
      CREATE TABLE cloud_tabs(title, url, last_viewed_time, device_uuid); CREATE TABLE cloud_tab_devices(device_uuid, device_name);
      INSERT INTO cloud_tabs VALUES ('A','https://a',86400.0,'1'),('','https://b',NULL,'2'),('C','HTTP://c',1,'1'),('D',NULL,1,'1'),('E','https://e',1,'9'); INSERT INTO cloud_tab_devices VALUES ('1','Mac'),('2',NULL);""")
    con.commit()
    con.close()
    tabs = capture.open_tabs(bookmarks.read_tabs(spark, path)).orderBy("seq").collect()
    assert [(r["url"], r["title"], r["date_added"], r["folder"]) for r in tabs] == [("https://v", "https://v", "", "open-tabs"), ("HTTP://u", "T", "2001-01-02", "open-tabs")]
    cloud = sorted((r["url"], r["title"], r["folder"]) for r in capture.cloud_tabs(*bookmarks.read_cloud_tabs(spark, path)).collect())
    assert cloud == [("https://a", "A", "cloud-tabs / Mac"), ("https://b", "https://b", "cloud-tabs / unknown-device"), ("https://e", "E", "cloud-tabs / unknown-device")]


def test_first_notes_and_sinks(spark, tmp_path):
    items = spark.createDataFrame([(1, "bookmarks", "https://u", "A b"), (2, "bookmarks", "https://u", "A b"), (3, "bookmarks", "https://u", "Other"), (4, "open-tabs", "https://u", "A b")], "seq int, kind string, url string, title string")
    kept = capture.first_notes(items, F.col("seq"))
    assert sorted(r["seq"] for r in kept.collect()) == [1, 3, 4]
    assert sorted(r["seq"] for r in capture.first_notes(items, F.col("seq"), kept.filter("seq = 1")).collect()) == [3, 4]
    path = str(tmp_path / "t")
    kept.write.parquet(path)
    sinks.append_new(kept, spark.read.parquet(path), path, ["kind", "name"])
    assert spark.read.parquet(path).count() == 3
    assert sorted(r["title"] for r in sinks.upserted(kept, kept.filter("seq = 1").withColumn("title", F.lit("new")), ["kind", "name"]).collect()) == ["A b", "Other", "new"]
    sinks.export_notes(spark.createDataFrame([("work", "a.md", "---\nx: 1\n---\nB")], "destination string, name string, content string"), str(tmp_path / "out"))
    assert notes.read_one(spark, str(tmp_path / "out/destination=work/name=a.md/part-*")).first()["content"] == "---\nx: 1\n---\nB\n"
    sinks.write_manifest(spark.createDataFrame([("url", "https://u", None)], "origin string, url string, ref_path string"), str(tmp_path / "m"))
    assert [(r["origin"], r["url"], r["ref_path"]) for r in notes.read_manifest_parts(spark, str(tmp_path / "m")).collect()] == [("url", "https://u", "")]


def test_notes_library_and_stream(spark, tmp_path):
    for name, content in (("a/x.md", "raw"), ("a/README.md", "r"), ("a/done.md", "---\nstatus: classified\n---\n"), ("a/n.txt", "no")):
        (tmp_path / "dump" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "dump" / name).write_text(content)
    assert notes.read_notes(spark, str(tmp_path / "dump")).count() == 3
    seen = []
    query = dump.run(dump.pending(dump.note_stream(spark, str(tmp_path / "dump"))), lambda df, k: seen.extend(r["path"].rsplit("/", 1)[1] for r in df.collect()), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert seen == ["x.md"]
    for folder, extract in (("2026-04-04_abc12345", '---\nstatus: extracted\ntitle: "My T"\n---\n'), ("2026-04-05_x", None), ("old", "title: no")):
        (tmp_path / "lib" / folder).mkdir(parents=True)
        (tmp_path / "lib" / folder / "source.md").write_text("s")
        if extract:
            (tmp_path / "lib" / folder / "extract.md").write_text(extract)
    library = notes.read_library(spark, str(tmp_path / "lib"))
    assert tuple(status.totals(library).first()) == (3, 1)
    assert [tuple(r) for r in status.recent(library).collect()] == [("2026-04-05_x", "untitled"), ("2026-04-04_abc12345", "My T")]


def test_configuration(spark, tmp_path):
    path = tmp_path / "tessella.yaml"
    path.write_text('vault_path: "~/v"  # here\nsearch_provider: own\nsearch_provider: late\nwhisper_model: \n')
    found = notes.load_config(spark, str(path), home="/home/me")
    assert found["vault_path"] == "/home/me/v" and found["reader_context_path"] == "/home/me/v/reader-context.md" and found["search_provider"] == "own"
    assert found["whisper_model"] == "large-v3" and found["default_model"] == "sonnet"
    assert notes.find_config(None, {}, str(tmp_path)) == str(path) and notes.find_config(str(path), {}) == str(path)
    with pytest.raises(FileNotFoundError):
        notes.find_config("/none", {})
    path.write_text("x: 1\n")
    with pytest.raises(ValueError):
        notes.load_config(spark, str(path))
    path.write_text("# c\nwork: ~/in\nlater:\nknowledge_manifest: '/m.json'\n")
    assert notes.load_targets(str(path), "/h") == {"work": "/h/in", "later": None, "knowledge_manifest": "/m.json"}


def test_originals(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    (tmp_path / "b.mp3").write_bytes(b"yy")
    got = {r["ext"]: (r["length"], r["origin"]) for r in notes.read_originals(spark, str(tmp_path)).collect()}
    assert got == {"pdf": (1, "pdf"), "mp3": (2, "audio")}


def test_media(spark):
    lines = [("v", "en", False, 0, 1, "b"), ("v", "en", False, 0, 0, "a"), ("v", "ru", True, 1, 0, "r"), ("w", "fr", False, 0, 0, "f"), ("w", "de", True, 1, 0, "d"), ("x", "en", True, 3, 0, "e"), ("x", "ru", True, 0, 0, "r")]
    df = spark.createDataFrame(lines, "video_id string, lang string, is_manual boolean, list_pos int, pos int, text string")
    assert sorted(map(tuple, media.transcripts(df).collect())) == [("v", "ru", "r"), ("w", "fr", "f"), ("x", "en", "e")]
    assert sorted(map(tuple, media.transcripts(df.filter("lang = 'en'")).collect())) == [("v", "en", "a\nb"), ("x", "en", "e")]
    meta = media.metadata(spark.createDataFrame([('{"title": "T", "uploader": "C", "duration": 61, "description": "' + "d" * 600 + '"}',)], "json string")).first()
    assert (meta["title"], meta["channel"], meta["seconds"], len(meta["description"])) == ("T", "C", 61.0, 500)
    row = spark.createDataFrame([("T", "a/b.mp3", 61.0, "", "hello")], "title string, file string, seconds double, language string, transcript string")
    assert row.select(media.document(row).alias("d")).first()["d"] == "Title: T\nFile: b.mp3\nDuration: 0:01:01\n\n--- TRANSCRIPT ---\n\nhello"
    found = spark.createDataFrame([(None, "spoken")], "c string, r string").select(*media.with_fallback(F.col("c"), F.col("r")), *media.with_fallback(F.col("c"), F.col("r"), True)).first()
    assert tuple(found) == ("spoken", "recognised", None, None)
    assert row.select(media.audio_title(F.lit(""), F.col("file"))).first()[0] == "b"


def test_search(spark):
    df = spark.createDataFrame([(1, "Alpha beta beta"), (2, "alpha"), (3, None), (4, "alphabet soup")], "doc_id long, text string")
    assert [r["doc_id"] for r in search.keyword(df, "ALPHA").orderBy("doc_id").collect()] == [1, 2, 4]
    assert [r["doc_id"] for r in search.bm25(df, ["beta", "alpha"]).collect()] == [1, 2]
    a = spark.createDataFrame([(1, 0.9), (2, 0.5)], "doc_id long, score double")
    b = spark.createDataFrame([(2, 3.0), (3, 1.0)], "doc_id long, score double")
    assert [r["doc_id"] for r in search.hybrid(a, b, "doc_id").collect()] == [2, 1, 3]
    assert search.new_contents(df.filter("doc_id < 3"), df.filter("doc_id = 2").select(F.sha2("text", 256).alias("hash"))).count() == 1


def test_lifecycle(spark):
    rows = spark.createDataFrame([("keep", True, True), ("", False, False), ("x", True, False), (None, True, True)], "s string, v boolean, r boolean")
    assert [r[0] for r in rows.select(status.dump_status(F.col("s"), F.col("v"), F.col("r"))).collect()] == ["keep", "unclassified", "classified", "routed"]
    assert [r[0] for r in rows.select(status.vault_status(F.col("v"), F.col("r"))).collect()] == ["integrated", "captured", "extracted", "integrated"]


def test_targets_as_yaml_reads_them(tmp_path):
    path = tmp_path / "t.yaml"
    path.write_text("""# targets
work: "/Vault #1/in"   # comment
a: /a#b/c
b: /x y # comment
c: '/it''s here'
d: ~
e: "~/in"
f:
g: null
h: "quote \\" # no"
i: http://x:8/#y
j:/not a pair
""")
    found = notes.load_targets(str(path), "/h")
    assert found == {"work": "/Vault #1/in", "a": "/a#b/c", "b": "/x y", "c": "/it's here", "d": None, "e": "/h/in", "f": None, "g": None, "h": 'quote " # no', "i": "http://x:8/#y"}


def test_media_formats_in_any_case(spark):
    from tessella.functions import origins

    rows = spark.createDataFrame([("x.MP3", "MP3"), ("y.bin", "Data"), ("z.pdf", None), ("w.opus", "ogg, Opus")], "path string, format string")
    assert [r[0] for r in rows.select(origins.file_origin(F.col("path"), F.col("format"))).collect()] == ["audio", "file", "pdf", "audio"]


def test_deep_and_broken_trees(spark):
    rows = [(0, None, "L", "R")] + [(k, k - 1, "L", f"f{k}" if k % 2 else "") for k in range(1, 300)]
    rows += [(1000, 299, "WebBookmarkTypeLeaf", "x"), (1001, 0, "WebBookmarkTypeLeaf", "x"), (1002, 1003, "L", "c"), (1003, 1002, "L", "c"), (1004, 1002, "WebBookmarkTypeLeaf", "x"), (1005, 7777, "WebBookmarkTypeLeaf", "x")]
    df = spark.createDataFrame(rows, "id long, parent_id long, type string, title string")
    found = {r["id"]: r["folders"] for r in bookmarks.flatten(df).collect()}
    assert set(found) == {1000, 1001} and found[1001] == ["R"] and found[1000] == ["R", *(f"f{k}" for k in range(1, 300, 2))]
    assert bookmarks.flatten(df.limit(0)).count() == 0


def test_archive_texts(spark, tmp_path):
    df = spark.createDataFrame([("a.txt", "one"), ("b.txt", "two")], "archive string, content string")
    sinks.archive_texts(df, None)
    sinks.archive_texts(df, str(tmp_path / "x"))
    sinks.archive_texts(df.limit(1).withColumn("content", F.lit("new")), str(tmp_path / "x"))
    assert sorted((r["archive"], r["value"]) for r in spark.read.text(str(tmp_path / "x")).collect()) == [("a.txt", "new"), ("b.txt", "two")]
