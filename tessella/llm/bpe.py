"""Byte-level BPE encoding and decoding.

Text is split by a pattern; each piece is merged alone. A segment tree over the piece's byte positions holds, for every
live position, the rank of the pair (token that starts there, next token); its root is the leftmost position of least
rank. A merge takes the root and makes three point updates: the merged position, its right neighbour, which dies, and its
left neighbour, whose pair has changed. A piece of n bytes takes O(n log n).

Null and empty texts have no tokens. A piece of any length is merged whole. What no match of the pattern covers has no tokens, as in the
public library. Rows that repeat have the same ids, and other columns, whatever their names, aren't looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import utf8

#: Words and pieces kept ready by one worker; a store is emptied when it is full, so memory is bounded and results are the same.
CACHE_ENTRIES = 300_000
#: Characters of the texts that are encoded together.
GROUP_CHARS = 500_000

#: A text where a single space is the only white space between two words can be split at spaces: no piece of the public pattern
#: crosses such a space, which always opens the next piece. Other patterns are applied to whole texts.
_IRREGULAR_SPACE = re.compile(r"\s\s|\A\s|\s\Z|[\x1c-\x1f\x85]")


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines `base64 rank`."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class LeastPair:
    """Segment tree of pair ranks over positions; the root is the leftmost least rank."""

    def __init__(self, ranks: list[int | None]):
        self.width = 1 << max(0, len(ranks) - 1).bit_length()
        # rank and position in one integer: the least integer is the leftmost of the least rank
        self.none = 1 << 62
        self.nodes = [self.none] * (2 * self.width)
        for at, rank in enumerate(ranks):
            if rank is not None:
                self.nodes[self.width + at] = rank << 32 | at
        for node in range(self.width - 1, 0, -1):
            self.nodes[node] = min(self.nodes[2 * node], self.nodes[2 * node + 1])

    def least(self) -> int | None:
        """The position to merge next."""
        return None if self.nodes[1] == self.none else self.nodes[1] & 0xFFFFFFFF

    def put(self, at: int, rank: int | None) -> None:
        nodes, node = self.nodes, self.width + at
        nodes[node] = self.none if rank is None else rank << 32 | at
        while node > 1:
            node >>= 1
            left, right = nodes[2 * node], nodes[2 * node + 1]
            nodes[node] = left if left < right else right


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    after = list(range(1, n + 1))  # start of the next live token; n: none
    before = list(range(-1, n - 1))
    tree = LeastPair([ranks.get(piece[i : i + 2]) for i in range(n - 1)])
    while (at := tree.least()) is not None:
        gone = after[at]
        end = after[at] = after[gone]
        if end < n:
            before[end] = at
        if gone < n - 1:
            tree.put(gone, None)
        tree.put(at, ranks.get(piece[at : after[end]]) if end < n else None)
        if (left := before[at]) >= 0:
            tree.put(left, ranks.get(piece[left:end]))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : after[at]]])
        at = after[at]
    return ids


class ManyMerges:
    """merge() for many short pieces at once: one segment tree to a row, all rows stepped together with numpy."""

    #: Longer pieces go to merge().
    WIDEST = 64
    #: Cells of all trees of one step, so memory is bounded.
    CELLS = 1 << 18

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.of_byte = np.array([ranks[bytes([k])] for k in range(256)], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens; -1: no token."""
        if not self.keys.size:
            return np.full(left.shape, -1)
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.values[at], -1)

    def __call__(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of every piece."""
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            if piece in self.ranks:
                out[k] = self.ranks[piece].to_bytes(4, "little")
            elif len(piece) > self.WIDEST:
                out[k] = np.array(merge(piece, self.ranks), "<u4").tobytes()
            else:
                by_width.setdefault(max(8, 1 << (len(piece) - 1).bit_length()), []).append(k)
        for width, members in by_width.items():
            step = self.CELLS // width
            for start in range(0, len(members), step):
                part = members[start : start + step]
                for k, packed in zip(part, self._rows([pieces[k] for k in part], width)):
                    out[k] = packed
        return out

    def _rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        count, none = len(pieces), np.int64(1 << 62)
        raw = np.frombuffer(b"".join([x.ljust(width, b"\0") for x in pieces]), np.uint8).reshape(count, width)
        size = np.array([len(x) for x in pieces])
        token = np.zeros((count, width + 1), np.int64)
        token[:, :width] = self.of_byte[raw]
        place = np.arange(width)
        live = place < size[:, None]
        after = np.broadcast_to(place + 1, (count, width)).copy()
        before = np.broadcast_to(place - 1, (count, width)).copy()
        tree = np.full((count, 2 * width), none)
        first = self.rank(token[:, : width - 1], token[:, 1:width])
        tree[:, width : 2 * width - 1] = np.where((first >= 0) & live[:, 1:], first * width + place[:-1], none)
        level = width
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        rows = np.arange(count)
        while True:
            least = tree[rows, 1]
            rows, least = rows[least != none], least[least != none]
            if not rows.size:
                break
            at = least % width
            gone = after[rows, at]
            end = after[rows, gone]
            token[rows, at] = least // width
            live[rows, gone] = False
            after[rows, at] = end
            more = end < size[rows]
            before[rows[more], end[more]] = at[more]
            rank = self.rank(token[rows, at], token[rows, end])
            tree[rows, width + gone] = none
            tree[rows, width + at] = np.where(more & (rank >= 0), rank * width + at, none)
            left = before[rows, at]
            inner = np.flatnonzero(left >= 0)
            own, left = rows[inner], left[inner]
            rank = self.rank(token[own, left], token[own, at[inner]])
            tree[own, width + left] = np.where(rank >= 0, rank * width + left, none)
            for who, node in ((rows, width + gone), (rows, width + at), (own, width + left)):
                node = node >> 1
                while node.size and node[0] > 0:
                    tree[who, node] = np.minimum(tree[who, 2 * node], tree[who, 2 * node + 1])
                    node = node >> 1
        packed = token[:, :width][live].astype("<u4").tobytes()
        ends = (4 * live.sum(axis=1).cumsum()).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]


class Encoder:
    """Encodes and decodes with one rank file and one pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        found = regex.compile(pattern)
        self.find = lambda text: [m[0] for m in found.finditer(text)]
        self.at_spaces = pattern == public_tokenizers.PATTERN
        self.merges = ManyMerges(self.ranks)
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> None:
        """Makes pieces ready."""
        new = [x for x in pieces if x not in self.pieces]
        self.pieces.update(zip(new, self.merges([x.encode() for x in new])))

    def _trim(self) -> None:
        for kept in (self.pieces, self.words):
            if len(kept) > CACHE_ENTRIES:
                kept.clear()

    def encode_all(self, texts: Iterable[str | bytes]) -> Iterator[bytes]:
        """Packed ids (little-endian unsigned 32-bit integers) of every text, worked out about a megabyte at a time."""
        held, chars = [], 0
        for text in texts:
            text = text if isinstance(text, str) else text.decode("utf-8", "replace")
            held.append(text)
            chars += len(text)
            if chars > GROUP_CHARS:
                yield from self._group(held)
                held, chars = [], 0
        yield from self._group(held)

    def _group(self, texts: list[str]) -> list[bytes]:
        cut: list[tuple] = []  # pieces at the head of a text, then words that a space precedes, and what is ready of them
        pieces: set[str] = set()
        unknown: set[str] = set()
        known, words = self.words.get, self.words
        for text in texts:
            if not self.at_spaces or " " not in text or _IRREGULAR_SPACE.search(text):
                head, rest, got = self.find(text), [], []
            else:
                first, *rest = text.split(" ")
                head, got = self.find(first), list(map(known, rest))
                if None in got:
                    unknown.update([word for word, packed in zip(rest, got) if packed is None])
            pieces.update(head)
            cut.append((head, rest, got))
        split = {word: self.find(" " + word) for word in unknown}
        for found in split.values():
            pieces.update(found)
        self._learn(pieces)
        ready = self.pieces.__getitem__
        for word, found in split.items():
            words[word] = b"".join(map(ready, found))
        packed = [b"".join(map(ready, head)) + b"".join(map(words.__getitem__, rest) if None in got else got) for head, rest, got in cut]
        self._trim()
        return packed

    def forget(self) -> None:
        """Empties the stores, so that a worker that goes on to other tasks doesn't hold them."""
        self.pieces.clear()
        self.words.clear()

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(next(self.encode_all([text])), "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each worker process; its stores last for a task."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def with_tokens(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", rows: int = 256) -> DataFrame:
    """Adds the token ids of a text column as array<int>. Ids fit 31 bits. An existing column of that name is replaced.
    A worker takes `rows` texts of a batch at a time and packs their ids without making Python numbers of them."""
    names = [c for c in df.columns if c != ids]
    schema = T.StructType([*[df.schema[c] for c in names], T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                packed = list(own.encode_all(part.column(len(names)).to_pylist()))
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])]).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], found], names=[*names, ids])
        own.forget()

    raw = df.select(*[F.col(c) for c in names], utf8(text).alias("_utf8_of_text"))
    return raw.mapInArrow(tokens, schema)


def with_decoded(df: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the bytes that an array of ids stands for."""

    @F.pandas_udf("binary")
    def back(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(path, pattern)
        for batch in batches:
            yield pd.Series([None if x is None else own.decode(x.tolist()) for x in batch], dtype=object)

    return df.withColumn(decoded, back(F.col(ids)))


def round_trip_digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of every row: each text is encoded, and the ids are decoded, in one pass
    over the scan; only digests leave the worker, and nothing is shuffled."""

    @F.pandas_udf("struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = encoder(path, pattern)
        for batch in batches:
            rows = []
            for packed in own.encode_all(batch):
                ids = np.frombuffer(packed, "<u4").tolist()
                rows.append((len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        own.forget()

    return df.select(F.col(key), digests(utf8(text)).alias("_d")).select(key, "_d.*")
