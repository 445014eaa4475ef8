"""The steps of suffix-array dedup in one process, with names that collide and batches of any size."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import dedup

from .test_corpus_operators import brute_dedup, planted_texts


def cut(rows, size):
    return [rows[k : k + size] for k in range(0, len(rows), size)]


def dealt(batches, order, kind, size):
    """What a shuffle and a sort by key do."""
    schema = pa.schema([(name, pa.int64() if t == "long" else pa.binary()) for name, t in (x.split() for x in kind.split(", "))])
    rows = [r for b in batches for r in b.to_pylist()]
    rows.sort(key=lambda r: [r[x] for x in order])
    return [pa.RecordBatch.from_pylist(x, schema) for x in cut(rows, size)]


def run(rows, length, gram, hot, size):
    """Removed bytes of every (id, text) row, through all steps, `size` rows a batch."""
    docs = [(d, hash(t), t) for d, t in rows]
    kinds = [pa.int64(), pa.int64(), pa.binary()]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part), kinds)], names=["doc", "th", "raw"]) for part in cut(docs, size)]
    sampled = [x for batch in batches for x in dedup._sampled([batch], length, gram)]
    named = [r for b in dedup._repeated(dealt(sampled, ["d", "c", "doc", "th", "an"], dedup._DEALT, size), hot) for r in b.to_pylist()]
    hot_grams = {r["k"] for r in named if r["an"] & 3 == dedup.TOKEN}
    gone = [(r["doc"], r["an"] >> 32, r["c"]) for r in named if r["an"] & 3 == dedup.GONE]
    wanted, fetched = {}, []
    for r in named:
        if r["an"] & 3 <= dedup.SURE:
            wanted.setdefault((r["doc"], r["th"]), []).append({"k": r["k"], "c": r["c"], "an": r["an"], "hot": r["k"] in hot_grams})
    kinds += [pa.bool_(), pa.list_(pa.struct([("k", pa.int64()), ("c", pa.int64()), ("an", pa.int64()), ("hot", pa.bool_())]))]
    for part in cut([(d, t, raw, False, wanted[d, t]) for d, t, raw in docs if (d, t) in wanted], size):
        d, t, raw, nul, own = (pa.array(x, kind) for x, kind in zip(zip(*part), kinds))
        fetched += dedup._fetched([pa.RecordBatch.from_arrays([d, t, nul, raw, own], names=["doc", "th", "nul", "raw", "wanted"])], length)
    for x in dedup._settled(dealt(fetched, ["k", "c", "doc", "th", "an"], dedup._FETCHED, size), length):
        gone += [(r["doc"], r["a"], r["b"]) for r in x.to_pylist()]
    return gone, hot_grams


def check(rows, length, gone):
    covered = {d: np.zeros(len(t), bool) for d, t in rows}
    for d, a, b in gone:
        covered[d][a:b] = True
    for (d, text), want in zip(rows, brute_dedup(rows, length)):
        assert int(covered[d].sum()) == want[1], d


@pytest.mark.parametrize("bits", [64, 6, 1])
@pytest.mark.parametrize("hot, size", [(4096, 7), (2, 5), (20, 1000)])
def test_colliding_names_remove_nothing_more(monkeypatch, bits, hot, size):
    """Names of few bits: most runs of one name differ, and are told apart by their bytes."""
    monkeypatch.setattr(dedup, "ROWS", 4 * size)
    real = dedup._stirred
    monkeypatch.setattr(dedup, "_stirred", lambda h: real(h) & np.uint64((1 << bits) - 1) if bits < 64 else real(h))
    rows = [(k, t.encode()) for k, t in enumerate(planted_texts(bits + hot, 50))]
    gone, _ = run(rows, 40, 12, hot, size)
    check(rows, 40, gone)
    if bits < 64:
        assert gone


@pytest.mark.parametrize("size", [3, 50, 1000])
def test_hot_grams(size):
    """One line in a third of many texts, with other words around it: its grams are hot, and the result is the same."""
    rng = random.Random(size)
    line = "A line that very many of the documents hold"
    rows = [(k, "".join(rng.choice("abcdefgh ") for _ in range(60)).encode() + (line.encode() if k % 3 == 0 else b"") + "".join(rng.choice("abcdefgh ") for _ in range(60)).encode()) for k in range(150)]
    rows += [(1000 + k, rows[3 * k][1]) for k in range(20)]
    results = {}
    for hot in (4096, 30, 10, 0):
        gone, hot_grams = run(rows, 42, 12, hot, size)
        check(rows, 42, gone)
        results[hot] = len(hot_grams)
    assert results[4096] == 0 < results[30] <= results[10] <= results[0]


def test_number_of_names_is_estimated(monkeypatch):
    """The number of different runs around a gram is estimated within a factor of two or so."""
    rng = np.random.default_rng(3)
    marked = []
    monkeypatch.setattr(dedup, "ROWS", 9)
    for count in (500, 2000, 8000, 40_000):
        c = rng.integers(-(1 << 31), 1 << 31, count)
        least = np.sort(np.concatenate([np.sort(x)[: dedup.TOKENS] for x in np.array_split(c, 20)]))
        rows = [dedup._batch(dedup._DEALT, np.full(len(x), 5), x, 0, 0, dedup.TOKEN) for x in cut(least, 9)]
        found = [r for b in dedup._repeated(rows, 4096) for r in b.to_pylist()]
        marked.append([(r["k"], r["an"]) for r in found] == [(5, dedup.TOKEN)])
    assert marked == [False, False, True, True]
