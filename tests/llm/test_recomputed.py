"""Results of whole queries against plain recomputation."""

import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessella.llm import langid, media, pii, quality, queries

SF = "/root/testdata/sf0.001"


def learnt(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 != 2


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()


def test_quality_scores(spark, docs):
    """Densities from the covariances of the statistics, by their inverses and determinants."""
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    x = np.array([quality.statistics((r["text"] or "").encode()) for r in docs])
    y = np.array([label.get(r["doc_id"], -1) if learnt(r["doc_id"]) else -1 for r in docs])
    pooled = sum(np.cov(x[y == k].T, bias=True) * (y == k).sum() for k in (0, 1)) / (y >= 0).sum()
    density = []
    for k in (0, 1):
        cov = np.cov(x[y == k].T, bias=True)
        cov = cov * (1 - quality.SHRINK) + np.diag(np.diag(cov)) * quality.SHRINK + quality.RIDGE * np.diag(np.maximum(np.diag(pooled), 1e-6))
        away = x - x[y == k].mean(axis=0)
        density.append(math.log((y == k).sum()) - 0.5 * (np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away) + np.linalg.slogdet(cov)[1]))
    want = 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / quality.TEMPERATURE, -500, 500)))
    got = {r["doc_id"]: r for r in queries.op3_quality(spark, SF).collect()}
    assert len(got) == len(docs)
    for r, score in zip(docs, want):
        row = got[r["doc_id"]]
        assert row["held_out"] != learnt(r["doc_id"]) and abs(row["score"] - score) < 1e-6 and row["predicted"] == (row["score"] >= 0.7)


def test_languages(spark, docs):
    """Trigram log-probabilities from plain counts, the candidates of each script, and the best path through all words."""
    cut = lambda text: re.findall(r"[^\W\d_]+", (text or "").lower())
    counts, letters = defaultdict(Counter), defaultdict(Counter)
    for r in docs:
        if learnt(r["doc_id"]) and r["lang"] is not None:
            for w in cut(r["text"]):
                letters[r["lang"]][langid.script(w)] += len(w)
                counts[r["lang"]].update(f"\x02{w}\x03"[k : k + 3] for k in range(len(w)))
    names = sorted(counts)
    kinds = set().union(*counts.values())
    assert len(kinds) <= langid.TRIGRAMS and len(docs) <= langid.FIT_ROWS
    total = {n: counts[n].total() + 0.5 * (len(kinds) + 1) for n in names}

    def scores(word):
        sums = [sum(math.log((counts[n][f"\x02{word}\x03"[k : k + 3]] + 0.5) / total[n]) for k in range(len(word))) for n in names]
        use = [letters[n][langid.script(word)] >= langid.OWN_SCRIPT * letters[n].total() and letters[n][langid.script(word)] > 0 for n in names]
        if not any(use):
            return None
        return [s if u else min([*sums, 0]) - 10 for s, u in zip(sums, use)]

    ready = {}
    got = {r["doc_id"]: r for r in queries.op7_language_id(spark, SF).collect()}
    assert len(got) == len(docs)
    for r in docs:
        words = cut(r["text"])
        row = got[r["doc_id"]]
        if not words:
            assert (row["lang_pred"], row["score"]) == ("und", 0)
            continue
        for w in set(words) - set(ready):
            ready[w] = scores(w)
        path, now = [], np.zeros(len(names))
        for w in words:
            came = np.where(now >= now.max() - langid.SWITCH, np.arange(len(names)), now.argmax())
            path.append(came)
            now = now[came] - langid.SWITCH * (came != np.arange(len(names))) + (0 if ready[w] is None else np.array(ready[w]))
        at, share = int(now.argmax()), Counter()
        for w, came in zip(reversed(words), reversed(path)):
            share[names[at]] += len(w) * (ready[w] is not None)
            at = int(came[at])
        assert row["lang_pred"] == max(sorted(share), key=share.get)
        assert abs(row["score"] - max(share.values()) / sum(map(len, words))) < 1e-9


def brute_landmarks(samples):
    """Sums of cosines and sines instead of a fast transform, and every pair in turn."""
    frame, hop, raw = 512, 256, np.frombuffer(samples, np.uint8).astype(float)
    n = max(1, math.ceil((len(raw) - frame) / hop) + 1)
    padded = np.full((n - 1) * hop + frame, float(round(raw.mean())))
    padded[max(0, frame - len(raw)) // 2 :][: len(raw)] = raw
    t, bins = np.arange(frame), np.arange(257)
    wave = np.exp(-2j * np.pi * np.outer(t, bins) / frame)
    peaks = []
    for k in range(n):
        part = padded[k * hop : k * hop + frame]
        power = np.abs(((part - part.mean()) * np.hanning(frame)) @ wave) ** 2
        usual = 2 * power[2:].mean()
        best = [a + int(power[a:b].argmax()) for a, b in ((2, 24), (24, 64), (64, 128), (128, 257))]
        loudest = max(best, key=lambda b: power[b])
        peaks.append([b if power[b] > usual or b == loudest and power[b] > 0 else None for b in best])
    marks = []
    for i, one in enumerate(peaks):
        time_code = (i * hop // frame) << 32 | (i * hop % frame // hop) << 22
        for ahead in range(5):
            for x, a in enumerate(one):
                for z, b in enumerate(peaks[i + ahead] if i + ahead < n else []):
                    if a is not None and b is not None and (ahead or z < x):
                        marks.append(time_code | a << 13 | b << 4 | ahead)
    if not marks:
        marks = [(i * hop // frame) << 32 | (i * hop % frame // hop) << 22 | a << 13 | a << 4 for i, one in enumerate(peaks) for a in one if a is not None]
    return sorted(marks)


def test_media_landmarks(docs):
    texts = sorted((r["text"] or "" for r in docs), key=len)
    for text in texts[::12] + ["", "a"]:
        samples = media.payload(text.encode())
        assert media.landmarks(media.peaks(samples)).tolist() == brute_landmarks(samples)


DISGUISED = [
    ("email", "jane dot doe at mail dot example dot org"), ("email", "bob [at] example [dot] com"), ("email", "jоhn@exаmple.com"),
    ("email", "ann      at      host      dot      example"), ("email", "x" * 70 + " at example dot org"),
    ("email", "eve [    at    ] " + " dot ".join("abcdefghijkl")), ("email", "y" * 300 + "@" + "z" * 90 + " dot " + "w" * 90),
    ("card", "４１１１ １１１１ １１１１ １１１１"), ("card", "four one one one one one one one one one one one one one one one"),
    ("phone", "plus one two three four five six seven eight nine"), ("ip", "one nine two dot one six eight dot one dot one"),
]


def test_disguises_planted_in_a_whole_table(spark, docs, tmp_path):
    rows, want = [], {}
    for k, r in enumerate(docs):
        head, (kind, disguise) = (r["text"] or "") + "\nX. ", DISGUISED[k % len(DISGUISED)]
        if k % 2:
            rows.append((r["doc_id"], r["text"]))
        else:
            rows.append((r["doc_id"], f"{head}({disguise}) Y."))
            want[r["doc_id"]] = kind, len(head) + 1, len(head) + 1 + len(disguise)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op9_pii_spans(spark, str(tmp_path)).collect()}
    before = {r["doc_id"]: r for r in queries.op9_pii_spans(spark, SF).collect()}
    assert len(got) == len(docs) and list(got.values())[0].__fields__ == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
    for doc, row in got.items():
        if doc in want:
            kind, a, b = want[doc]
            assert row["n_added"] == before[doc]["n_added"] + 1 and f"{kind}:{a}:{b}" in row["spans"].split(",")
        assert doc in want or row == before[doc]
    clean = [r["text"] or "" for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert not any("example" in t or "w" * 90 in t or "dot l" in t for t in clean)


def test_transducers_are_linear():
    for piece in ("[ ", "  ", "at ", "a at b ", "one ", "plus ", "a.", "x at 9.", ", ", " dot", "a at b dot ", "a dot ", "a dot b at c dot d ", "@a", "one, dot ", "<   at", "\t\n"):
        took = []
        for n in (20_000, 80_000):
            text = piece * (n // len(piece))
            began = time.perf_counter()
            pii.find(text)
            took.append(time.perf_counter() - began)
        assert took[1] < 12 * took[0] + 0.2, piece
