"""Suffix-array dedup: bytes that a string of `length` bytes covers which also starts earlier.

Documents are in order of id, null last, and of a hash of the text among rows of one id; a string is removed wherever it
starts later than its first start, judged on the input.

1. Sampling. Each string of `length` bytes has one anchor, the gram of GRAM bytes with the least hash in it, the leftmost of
   equals; so equal strings have equal anchors at equal places, and consecutive starts with one anchor form a run. A run is
   a row: the names (64-bit hashes) of its gram and of all its bytes, and where it is. A document has about one run for 35 bytes.
2. Choice. A run whose gram is nowhere else repeats nothing. Names only choose: they are dealt by gram, and where a gram occurs
   in several runs, these go on. A batch of documents deals a few rows for a gram, however often it occurs there.
3. Suffixes. The bytes of these runs are fetched from the documents and dealt by gram. Runs of one name are compared byte
   by byte with the first, and removed if they are alike. The suffixes of a batch of the runs that remain, different ones around one gram, are
   sorted by the difference-cover algorithm: sampled triples, recursion on names, merge of the rest. Adjacent suffixes
   are compared over `length` bytes, and of those alike all but the first are removed.
4. A gram in about HOT different runs or more isn't sorted in one task: its strings are dealt one by one instead, each by its own
   name, and compared in the same way. So HOT decides where bytes are compared and changes no result.

No byte is removed by a hash alone: two strings that collide in their names are told apart where they meet. Before each shuffle runs that are
alike within a batch are folded, again by their bytes.

Null and empty texts, and texts shorter than `length`, lose nothing. Of rows that repeat both id and text (by a 64-bit hash), the first stays as it is judged,
and the others lose all if they have `length` bytes. Other columns, whatever their names, aren't looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.common import bound_batches, utf8, written
from tessella.llm.suffixes import repeats

LENGTH = 100
GRAM = 32
HOT = 4096
#: Bytes that are hashed together in one task, that are sorted together, and that are folded together before a shuffle.
CHUNK, SORTED, FOLDED = 1 << 20, 1 << 20, 1 << 24
#: Rows that a batch deals for a gram: its least names, from which the number of different ones is estimated.
TOKENS = 16
#: Hot grams up to which a table of them is broadcast, at 8 bytes each; a larger one is joined by shuffles.
BROADCAST = 100_000

_BITS = 21
_LAST = np.iinfo(np.int64).max


class _Hash:
    """Polynomial hashes of all substrings of a chunk, modulo 2^64."""

    def __init__(self, seed: int, base: int):
        self.letters = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        power = np.full(CHUNK + 1, base, np.uint64)
        power[0] = 1
        self.up = np.cumprod(power)
        power[1:] = pow(base, -1, 1 << 64)
        self.down = np.cumprod(power)

    def prefix(self, raw: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.letters[raw] * self.up[: len(raw)], out=sums[1:])
        return sums

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _stirred((sums[end] - sums[start]) * self.down[start])


def _stirred(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_HASHES: list[_Hash] = []


def _hashes() -> list[_Hash]:
    if not _HASHES:
        _HASHES.extend([_Hash(1, 0x9E3779B97F4A7C15), _Hash(2, 0xC2B2AE3D27D4EB4F)])
    return _HASHES


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if n < width else x


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (document, offset, bytes) of up to CHUNK bytes; a longer text is cut so that every string is in one piece."""
    held, size, step = [], 0, CHUNK - length
    for k, text in enumerate(texts):
        if len(text) < length:
            continue
        for offset in range(0, len(text) - length + 1, step):
            piece = text[offset : offset + step + length - 1]
            if size + len(piece) > CHUNK:
                yield held
                held, size = [], 0
            held.append((k, offset, piece))
            size += len(piece)
    if held:
        yield held


def runs(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(document, first start, starts, gram's name, run's name) of all runs."""
    one, two = _hashes()
    out = []
    for held in _pieces(texts, length):
        raw = np.frombuffer(b"".join([x for _, _, x in held]), np.uint8)
        sizes = np.array([len(x) for _, _, x in held])
        base = np.cumsum(sizes) - sizes
        piece = np.repeat(np.arange(len(held)), sizes)
        first, second = one.prefix(raw), two.prefix(raw)
        places = np.arange(len(raw) - gram + 1)
        grams = one.of(first, places, places + gram)
        low = np.uint64((1 << _BITS) - 1)
        least = _sliding_least((grams & ~low) | places.astype(np.uint64), length - gram + 1)
        anchor = (least & low).astype(np.int64)
        starts = np.arange(len(anchor))
        valid = starts + length <= (base + sizes)[piece[: len(anchor)]]
        starts, anchor = starts[valid], anchor[valid]
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)]))
        begin, count = starts[new], np.diff(np.concatenate([new, [len(starts)]]))
        own = piece[begin]
        document, offset = np.array([k for k, _, _ in held])[own], np.array([x for _, x, _ in held])[own]
        named = two.of(second, begin, begin + count + length - 1) + (anchor[new] - begin).astype(np.uint64)
        out.append((document, begin - base[own] + offset, count, grams[anchor[new]].view(np.int64), named.view(np.int64)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*out))


def _first_of(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For rows taken in `order`: True where any key differs from the row before."""
    if not len(order):
        return np.zeros(0, bool)
    return np.concatenate([[True], np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)])


def _merged(doc: np.ndarray, th: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals that touch within a document become one."""
    if not len(doc):
        return doc, th, start, end
    order = np.lexsort((start, th, doc))
    doc, th, start, end = doc[order], th[order], start[order], end[order]
    # ends are compared within a document only: shift each document beyond the one before
    row = np.cumsum(np.concatenate([[False], (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])]))
    shift = row * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    new = np.flatnonzero(np.concatenate([[True], start[1:] + shift[1:] > reach[:-1]]))
    return doc[new], th[new], start[new], (np.concatenate([reach[new[1:] - 1], reach[-1:]]) - shift[new])


#: Rows that are dealt: a run whose gram must be met elsewhere, a run whose gram is repeated for sure, a name that only tells
#: of such a gram, and removed bytes.
RUN, SURE, TOKEN, GONE = range(4)
#: d deals a row: the name of its gram, with SALT bits changed in rows that needn't meet others. an holds a, these bits, n and the kind.
#: GONE rows have their end in c, the others half of their run's name.
_DEALT = "d long, c long, doc long, th long, an long"
_NAMED = "k long, c long, doc long, th long, an long"
_FETCHED = "k long, c long, doc long, th long, an long, part binary"
_REMOVED = "doc long, th long, a long, b long"
SALT = (1 << 14) - 1
#: Rows that are judged together.
ROWS = 1 << 16


def _an(a, n, kind, salt=0) -> np.ndarray:
    return np.asarray(a) << 32 | np.asarray(salt) << 18 | np.asarray(n) << 2 | kind


def _parts(an: np.ndarray) -> tuple[np.ndarray, ...]:
    """a, n, kind."""
    return an >> 32, an >> 2 & 0xFFFF, an & 3


def _batch(kind: str, *columns) -> pa.RecordBatch:
    """A batch of long columns, the first of which has all rows, and perhaps one of bytes."""
    fields = [x.split() for x in kind.split(", ")]
    size = len(columns[0])
    arrays = [pa.array(np.ascontiguousarray(np.broadcast_to(np.asarray(x, np.int64), size))) if t == "long" else pa.nulls(size, pa.binary()) if x is None else pa.array(x, pa.binary()) for (_, t), x in zip(fields, columns)]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.Table, bool]]:
    """Batches joined to about `rows` rows, and whether no row follows."""
    held, size, ready = [], 0, None
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            if ready is not None:
                yield ready, False
            ready, held, size = pa.Table.from_batches(held), [], 0
    if held:
        if ready is not None:
            yield ready, False
        ready = pa.Table.from_batches(held)
    if ready is not None:
        yield ready, True


def _longs(table: pa.Table) -> list[np.ndarray]:
    return [x.to_numpy() for x in table.columns if pa.types.is_int64(x.type)]


def _folded(k, c, doc, th, a, bytes_of) -> tuple[np.ndarray, np.ndarray]:
    """(rows that stay, in order of names and places; later rows with the bytes of the first of their names). A row that repeats id and text
    has the same runs and is dropped."""
    order = np.lexsort((a, th, doc, c, k))
    order = order[_first_of(order, k, c, doc, th, a)]
    first = _first_of(order, k, c)
    lead = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    gone = ~first
    at = np.flatnonzero(gone)
    gone[at] = [bytes_of(i) == bytes_of(j) for i, j in zip(order[at].tolist(), lead[at].tolist())]
    return order[~gone], order[gone]


def _gone(kind: str, doc, th, a, end) -> pa.RecordBatch:
    """Rows of removed bytes; where they are dealt to doesn't matter."""
    doc, th, a, end = _merged(doc, th, a, end)
    spread = _stirred((doc ^ a << 40).astype(np.uint64)).view(np.int64)
    return _batch(kind, spread, end, doc, th, _an(a, 0, GONE), None)


def _sampled(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """batches: doc, th, raw."""

    def flushed(texts: list[bytes], docs: np.ndarray, ths: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, a, n, k, c = runs(texts, length, gram)
        doc, th, c = docs[at], ths[at], c >> 32
        where, start, end = at.tolist(), a.tolist(), (a + n + length - 1).tolist()
        kept, gone = _folded(k, c, doc, th, a, lambda i: texts[where[i]][start[i] : end[i]])
        if len(gone):
            yield _gone(_DEALT, doc[gone], th[gone], a[gone], a[gone] + n[gone] + length - 1)
        if len(kept):
            k, c, doc, th, a, n = (x[kept] for x in (k, c, doc, th, a, n))
            begin = np.flatnonzero(_first_of(np.arange(len(k)), k))
            size = np.diff(np.concatenate([begin, [len(k)]]))
            several = np.repeat(size, size) > 1
            token = several & (np.arange(len(k)) - np.repeat(begin, size) < TOKENS)
            salt = np.where(several, _stirred((doc ^ a << 40).astype(np.uint64)).view(np.int64) & SALT, 0)
            yield _batch(_DEALT, k ^ salt, c, doc, th, _an(a, n, np.where(several, SURE, RUN), salt))
            if token.any():
                yield _batch(_DEALT, k[token], c[token], 0, 0, TOKEN)

    texts, rows, size = [], [], 0
    for batch in batches:
        found = batch.column(2).to_pylist()
        texts += found
        rows.append([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        size += sum(map(len, found))
        if size > FOLDED:
            yield from flushed(texts, *map(np.concatenate, zip(*rows)))
            texts, rows, size = [], [], 0
    if texts:
        yield from flushed(texts, *map(np.concatenate, zip(*rows)))


class _Grams:
    """Decides the grams of one task, sorted by d, c and place: runs of repeated grams and sure ones go on, and a TOKEN row names each
    gram that is hot. Of a gram that goes on in the next batch only its numbers and at most one row wait."""

    def __init__(self, hot: int):
        self.hot = hot
        self.k, self.c, self.rows, self.names, self.held = None, None, 0, 0, None

    def batch(self, columns: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
        kind = columns[4] & 3
        through = (kind == SURE) | (kind == GONE)
        if through.any():
            d, *rest = (x[through] for x in columns)
            yield _batch(_NAMED, d ^ (rest[3] >> 18 & SALT), *rest)
            columns, kind = [x[~through] for x in columns], kind[~through]
        k, c = columns[:2]
        if not len(k):
            return
        begin = np.flatnonzero(_first_of(np.arange(len(k)), k))
        size = np.diff(np.concatenate([begin, [len(k)]]))
        on = self.k is not None and k[0] == self.k
        new = _first_of(np.arange(len(k)), k, c).astype(np.int64)
        new[0] -= on and c[0] == self.c
        names = np.cumsum(new)
        before = np.concatenate([[0], names[begin[1:] - 1]])
        before[0] -= self.names if on else 0
        names -= np.repeat(before, size)  # different names of the gram up to each row
        rows = size.copy()
        rows[0] += self.rows if on else 0
        if self.held is not None:
            if on and rows[0] > 1:
                yield _batch(_NAMED, *self.held)
            if not on or rows[0] > 1:
                self.held = None
        some = (kind == RUN) & np.repeat(rows > 1, size)
        if some.any():
            yield _batch(_NAMED, *(x[some] for x in columns))
        # the TOKENS-th least name, as a share of all, tells how many there are
        full = (new == 1) & (names == TOKENS)
        share = (c[full] + 2.0**31 + 1) / 2.0**32
        hot = k[full][(TOKENS - 1) / share > self.hot].tolist()
        whole = names[begin + size - 1]
        few = (whole < TOKENS) & (whole > self.hot)
        if not last:
            few[-1] = False
        hot += k[begin[few]].tolist()
        if not on and self.k is not None and self.hot < self.names < TOKENS:
            hot.append(self.k)
        if hot:
            yield _batch(_NAMED, hot, 0, 0, 0, TOKEN)
        self.k, self.c, self.rows, self.names = int(k[-1]), int(c[-1]), int(rows[-1]), int(whole[-1])
        if not last and rows[-1] == 1:
            self.held = [x[-1:] for x in columns]


def _repeated(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """batches: sorted by d, c, doc, th, an."""
    grams = _Grams(hot)
    for table, last in _gathered(batches, ROWS):
        yield from grams.batch(_longs(table), last)


def _fetched(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Bytes of runs; of hot grams, of their strings one by one. batches: doc, th, nul, raw, wanted."""
    one, two = _hashes()

    def flushed(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        k, c, doc, th, a, n = (np.concatenate([x[i] for x in held]) for i in range(6))
        parts = [part for x in held for part in x[6]]
        kept, gone = _folded(k, c, doc, th, a, parts.__getitem__)
        if len(gone):
            yield _gone(_FETCHED, doc[gone], th[gone], a[gone], a[gone] + n[gone] + length - 1)
        for at in range(0, len(kept), ROWS):
            own = kept[at : at + ROWS]
            yield _batch(_FETCHED, k[own], c[own], doc[own], th[own], _an(a[own], n[own], RUN), [parts[i] for i in own.tolist()])

    held, size = [], 0
    for batch in batches:
        doc, th, wanted = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(4)
        own = np.repeat(np.arange(len(doc)), wanted.value_lengths().to_numpy())
        flat = wanted.flatten()
        k, c, an, hot = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
        a, n, _ = _parts(an)
        texts = batch.column(3).to_pylist()
        cold = np.flatnonzero(~hot)
        found = [texts[i][x:y] for i, x, y in zip(own[cold].tolist(), a[cold].tolist(), (a + n + length - 1)[cold].tolist())]
        held.append((k[cold], c[cold], doc[own[cold]], th[own[cold]], a[cold], n[cold], found))
        size += sum(map(len, found))
        for i in np.flatnonzero(hot):
            at = np.arange(n[i])
            part = texts[own[i]][a[i] : a[i] + n[i] + length - 1]
            letters = np.frombuffer(part, np.uint8)
            names = [h.of(h.prefix(letters), at, at + length).view(np.int64) for h in (one, two)]
            held.append((names[0], names[1] >> 32, np.full(n[i], doc[own[i]]), np.full(n[i], th[own[i]]), a[i] + at, np.ones(n[i], np.int64), [part[j : j + length] for j in range(n[i])]))
            size += length * int(n[i])
            if size > FOLDED:
                yield from flushed(held)
                held, size = [], 0
        if size > FOLDED:
            yield from flushed(held)
            held, size = [], 0
    if held:
        yield from flushed(held)


class _Runs:
    """Different runs of one task, by gram, until their strings are sorted."""

    def __init__(self, length: int):
        self.length, self.held, self.size = length, [], 0

    def add(self, k, doc, th, a, n, parts: list[bytes]) -> None:
        self.held.append((k, doc, th, a, n, parts))
        self.size += sum(map(len, parts))

    def sorted(self, last: bool) -> Iterator[pa.RecordBatch]:
        """Removed bytes of the grams that are whole: all but the last one, unless it is the last of all."""
        k, *rows = (np.concatenate([x[i] for x in self.held]) for i in range(5))
        parts = [part for x in self.held for part in x[5]]
        done = len(k) if last else int(np.searchsorted(k, k[-1]))
        first = np.flatnonzero(_first_of(np.arange(done), k[:done]))
        chosen, size = [], 0
        for begin, end in zip(first.tolist(), [*first[1:].tolist(), done]):
            if end - begin > 1:
                chosen += range(begin, end)
                size += sum(map(len, parts[begin:end]))
                if size > SORTED:
                    yield self._sort(chosen, rows, parts)
                    chosen, size = [], 0
        if chosen:
            yield self._sort(chosen, rows, parts)
        self.held, self.size = [], 0
        if done < len(k):
            self.add(k[done:], *(x[done:] for x in rows), parts[done:])

    def _sort(self, chosen: list[int], rows: list[np.ndarray], parts: list[bytes]) -> pa.RecordBatch:
        """The strings that start earlier in another run, or in the same."""
        chosen = np.array(chosen)
        chosen = chosen[np.lexsort([x[chosen] for x in (rows[2], rows[1], rows[0])])]
        doc, th, a, n = (x[chosen] for x in rows)
        text = np.frombuffer(b"".join([parts[i] for i in chosen.tolist()]), np.uint8)
        base = np.concatenate([[0], np.cumsum(n + self.length - 1)[:-1]])
        row = np.repeat(np.arange(len(n)), n)
        starts = base[row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]
        found = repeats(text, starts, self.length)
        own = np.searchsorted(base, found, side="right") - 1
        at = a[own] + found - base[own]
        return _batch(_REMOVED, *_merged(doc[own], th[own], at, at + self.length))


def _settled(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """batches: _FETCHED, sorted by k, c, doc, th, an. Returns removed bytes."""
    lead, before = b"", []  # the first run of the last row's names, and that row
    different = _Runs(length)
    for table, last in _gathered(batches, ROWS // 4):
        columns = _longs(table)
        gone = columns[4] & 3 == GONE
        if gone.any():
            _, end, doc, th, an = (x[gone] for x in columns)
            yield _batch(_REMOVED, *_merged(doc, th, an >> 32, end))
        columns = [x[~gone] for x in columns]
        parts = table.column(5).filter(pa.array(~gone)).to_pylist()
        if len(parts):
            k, c, doc, th, an = columns
            a, n, _ = _parts(an)
            after = [np.concatenate([[y], x]) for x, y in zip(columns, before)] if before else columns
            every = np.arange(len(after[0]))
            first, other = _first_of(every, *after[:2])[len(every) - len(k) :], _first_of(every, *after)[len(every) - len(k) :]
            stays, again = first.copy(), []
            for i in np.flatnonzero(~first | np.append(~first[1:], True)).tolist():  # rows of names that several rows have, and the last
                if first[i]:
                    lead = parts[i]
                elif other[i]:  # a row that repeats id and text has the same runs and is dropped
                    stays[i] = parts[i] != lead
                    if not stays[i]:
                        again.append(i)
            if again:
                yield _batch(_REMOVED, *_merged(doc[again], th[again], a[again], a[again] + n[again] + length - 1))
            own = np.flatnonzero(stays)
            different.add(k[own], doc[own], th[own], a[own], n[own], [parts[i] for i in own.tolist()])
            before = [int(x[-1]) for x in columns]
        if different.held and (last or different.size > 4 * SORTED):
            yield from different.sorted(last)


def _result(batches: Iterator[pd.DataFrame], length: int, keep: bool) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for raw, spans, copy in zip(batch["raw"], batch["spans"], batch["copy"]):
            kept, at, end, removed, count = [], 0, -1, 0, 0
            found = sorted((x["a"], x["b"]) for x in spans) if spans is not None else []
            if copy > 1 and len(raw) >= length:
                found = [(0, len(raw))]
            for a, b in found:
                if a > end:
                    count += 1
                    kept.append(raw[at:a])
                    removed += b - a
                    at = end = b
                elif b > end:
                    removed += b - end
                    at = end = b
            kept.append(raw[at:])
            kept = b"".join(kept)
            out.append((len(raw), removed, count, hashlib.sha256(kept).hexdigest(), kept if keep else None))
        pdf = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]).assign(doc=batch["doc"].to_numpy(), nul=batch["nul"].to_numpy())
        yield pdf if keep else pdf.drop(columns="kept")


def _documents(df: DataFrame, key: str, text: str) -> DataFrame:
    """doc, th: the order of documents, those without an id (nul) last; raw: the bytes."""
    raw, own = utf8(text), F.col(key).cast("long")
    return df.select(F.coalesce(own, F.lit(_LAST)).alias("doc"), F.xxhash64(raw).alias("th"), own.isNull().alias("nul"), raw.alias("raw"))


def removed(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(documents: doc, th, nul, raw; removed bytes: doc, th, a, b, which may touch and overlap)."""
    if length - gram >= 1 << 16 or not 0 < gram <= length:
        raise ValueError("gram must be from 1 to length, and at most 65,535 bytes below it")
    bound_batches(df.sparkSession)
    docs = _documents(df, key, text)
    sampled = docs.select("doc", "th", "raw").mapInArrow(lambda x: _sampled(x, length, gram), _DEALT)
    ordered = sampled.repartition("d").sortWithinPartitions("d", "c", "doc", "th", "an")
    named = written(ordered.mapInArrow(lambda x: _repeated(x, hot), _NAMED))
    kind = F.col("an").bitwiseAND(3)
    chosen = named.filter(kind.isin(RUN, SURE))
    grams = named.filter(kind == TOKEN).select(F.col("k").alias("_k")).distinct()
    if count := grams.count():
        grams = F.broadcast(grams) if count <= BROADCAST else grams
        chosen = chosen.join(grams, F.col("k") == F.col("_k"), "left").withColumn("hot", F.col("_k").isNotNull())
    else:
        chosen = chosen.withColumn("hot", F.lit(False))
    wanted = chosen.groupBy("doc", "th").agg(F.collect_list(F.struct("k", "c", "an", "hot")).alias("wanted"))
    # the same columns as the last join takes, so that both read one exchange of the texts
    fetched = docs.join(wanted, ["doc", "th"]).select("doc", "th", "nul", "raw", "wanted").mapInArrow(lambda x: _fetched(x, length), _FETCHED)
    dealt = fetched.repartition("k").sortWithinPartitions("k", "c", "doc", "th", "an")
    late = dealt.mapInArrow(lambda x: _settled(x, length), _REMOVED)
    early = named.filter(kind == GONE).select("doc", "th", F.shiftright("an", 32).alias("a"), F.col("c").alias("b"))
    return docs, early.unionByName(late)


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", kept: bool = True, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes."""
    docs, gone = removed(df, key, text, length, gram, hot)
    spans = gone.groupBy("doc", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    copy = F.row_number().over(W.partitionBy("doc", "th").orderBy("nul")).alias("copy")
    joined = docs.join(spans, ["doc", "th"], "left").select("doc", "nul", "raw", "spans", copy)
    kind = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, doc long, nul boolean" + ", kept binary" * kept
    out = joined.mapInPandas(lambda x: _result(x, length, kept), kind)
    return out.select(F.when(~F.col("nul"), F.col("doc")).alias(key), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if kept else []))
