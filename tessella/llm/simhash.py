"""SimHash near-dedup.

Fingerprint: bit b is set if more than half of the text's shingle hashes have it. Fingerprints at most `radius` bits apart
are linked, and a component is all that links reach.

Rows are first folded to distinct fingerprints, so exact copies cost one row. The 64 bits are cut into radius + 3 bands;
two fingerprints at most `radius` apart agree in at least three whole bands, so equality on every choice of three bands
finds every link (20 tables for a radius of 3, keys of about 32 bits). Within a key the fingerprints are stored as vertical
bit planes, 64 fingerprints to a machine word; a carry-save counter adds the differing bits of 64 distances at once, plane
by plane, and a block is abandoned once all its distances exceed the radius. A key with many fingerprints is cut into
blocks and each pair of blocks is a group of its own, so no group is unbounded. A group returns a forest of its links, never all
pairs. Components then come from hooking each root to its least neighbour, and pointer jumping, until nothing changes.

keep_one_similar() links texts by the Jaccard similarity of their sets of shingles, of five words: a fingerprint of WIDE bits, more than
64 tell apart, is compared in the same way. There bands would be too short to be keys, so texts are compared that share a rare shingle:
of the LOW shingles of least hash of a text, the KEYS that the fewest other texts have among theirs. Two texts at an angle (similarity s of
sets of like size: cosine 2s / (1 + s)) differ in a number of bits with a mean and a spread; the radius is the mean at the wanted
similarity and SLACK times the spread, so that pairs at it are not missed. What such loose links connect is compared again within its
loose component, and there a pair of fingerprints within the radius is a link only if the sets themselves are alike. Only texts in loose components have
their sets made and shuffled, once for each block of their component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.common import checkpointed, small, utf8

SEED = 42
WORDS = 3
RADIUS = 3
#: Fingerprints in a block of one key.
BLOCK = 2048
#: Rows of two hashes up to which a table is broadcast.
BROADCAST = 200_000
#: Bits of a wide fingerprint, words of its shingles, the similarity from which texts are linked, and how far beyond its mean distance
#: (texts of four and five shingles, which are furthest apart for their similarity, are within it).
WIDE, SIMILAR_WORDS, SIMILARITY, SLACK = 512, 5, 0.8, 6.0
#: Shingles of least hash of a text, and those of them that are keys.
LOW, KEYS = 16, 6
#: Texts in a block of one loose component, which come with their sets.
SET_BLOCK = 512


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> bytes:
    """Eight bytes, highest bit first; zero where there is no word."""
    found = text.lower().split()  # bytes: only A-Z change, and only \x20 and \x09-\x0d split
    if not found:
        return bytes(8)
    shingles = [b" ".join(x) for x in zip(*(found[k:] for k in range(words)))] if len(found) >= words else [b" ".join(found)]
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, np.int64)
    for start in range(0, len(shingles), 65_000):
        part = b"".join([digest(x, seed) for x in shingles[start : start + 65_000]])
        bits = np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > len(shingles)).tobytes()


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series(np.frombuffer(b"".join(map(fingerprint, batch)), ">i8").astype(np.int64))


def fingerprints(text: Column) -> Column:
    """Fingerprints of a column of bytes, as long."""
    return F.pandas_udf(_fingerprints, "bigint")(text)


def hex16(col: Column) -> Column:
    return F.lpad(F.lower(F.hex(col)), 16, "0")


def band_masks(radius: int = RADIUS) -> list[int]:
    """64-bit masks of every choice of three from radius + 3 bands."""
    edges = [round(k * 64 / (radius + 3)) for k in range(radius + 4)]
    bands = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]
    return [sum(x) for x in combinations(bands, 3)]


def bits_of(prints: np.ndarray | list[bytes]) -> np.ndarray:
    """A row of bits for each fingerprint, given as unsigned integers or as bytes; the order of bits is the same for all."""
    raw = np.frombuffer(b"".join(prints), np.uint8) if isinstance(prints, list) else prints.astype("<u8").view(np.uint8)
    return np.unpackbits(raw.reshape(len(prints), -1), axis=1, bitorder="little")


def planes(bits: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of every fingerprint, 64 to a word."""
    padded = np.zeros((bits.shape[1], -(-len(bits) // 64) * 64), np.uint8)
    padded[:, : len(bits)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def near(queries: np.ndarray, stored: np.ndarray, order: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each query, a row of bits: words whose set bits are the fingerprints at most `radius` from it.

    Each lane has a carry-save counter of as many bits as hold the radius; `over` keeps the lanes in which it has run over. Planes are
    taken in `order`, those that vary first, and words of a query in which all lanes have run over are left out of later planes.
    """
    n = stored.shape[1]
    result = np.zeros((len(queries), n), np.uint64)
    flips = np.where(queries[:, order], _FULL, np.uint64(0))
    live = None  # (query, word) of the words that are left; None: all
    counter = [np.zeros(result.shape, np.uint64) for _ in range(max(1, radius.bit_length()))]
    over = np.zeros(result.shape, np.uint64)
    most = (1 << len(counter)) - 1
    for step, bit in enumerate(order.tolist()):
        carry = stored[bit] ^ flips[:, step, None] if live is None else stored[bit, live[1]] ^ flips[live[0], step]
        for k, digit in enumerate(counter):
            if step >= (1 << k) - 1:  # no lane has counted so far before
                counter[k], carry = digit ^ carry, digit & carry
        if step >= most:
            over |= carry
        if step >= radius and step % 8 == 7:
            gone = over if most == radius else over | _above(counter, radius)
            keep = gone != _FULL
            left = np.count_nonzero(keep)
            if not left:
                return result
            if left <= 0.75 * keep.size:
                live = np.nonzero(keep) if live is None else tuple(x[keep] for x in live)
                over, counter = over[keep], [digit[keep] for digit in counter]
    within = ~(over | _above(counter, radius))
    if live is None:
        return within
    result[live] = within
    return result


def _above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes in which the counter is above the radius: from the highest digit, it first differs by a one against a zero."""
    above, level = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            level &= counter[k]
        else:
            above |= level & counter[k]
            level &= ~counter[k]
    return above


class _Union:
    """Union-find that reports the links that joined something."""

    def __init__(self, size: int):
        self.parent = list(range(size))
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def link(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((i, j))

    def link_all(self, rows: np.ndarray, others: np.ndarray, sets: Alike | None) -> None:
        """Links rows[k] to others[k], with `sets` only where these are alike; pairs that are connected are not looked at."""
        if sets is None:
            for i, j in zip(rows.tolist(), others.tolist()):
                self.link(i, j)
            return
        for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(rows)) + 1):
            if len(part):
                i = int(rows[part[0]])
                apart = [j for j in others[part].tolist() if self.root(j) != self.root(i)]
                for j in sets.alike(i, apart) if apart else []:
                    self.link(i, j)


class Alike:
    """Whether sets of 32-bit hashes, sorted, have a Jaccard similarity of `least` or more.

    One set is marked in a table by the low bits of its hashes. What another has in marked places is no less than what they share, so most
    pairs are refused by that count, many at a time; the others are compared as they are.
    """

    def __init__(self, sets: list[np.ndarray], least: float):
        self.sets, self.least = sets, least
        self.marked = np.zeros(1 << 20, bool)

    def _enough(self, shared: int, a: int, b: int) -> bool:
        return shared >= self.least * (a + b - shared)

    def alike(self, i: int, others: list[int]) -> list[int]:
        one, low = self.sets[i], np.uint32(len(self.marked) - 1)
        others = [j for j in others if self._enough(min(one.size, self.sets[j].size), one.size, self.sets[j].size)]
        if not others:
            return []
        self.marked[one & low] = True
        most = []
        for start in range(0, len(others), TILE):
            part = [self.sets[j] for j in others[start : start + TILE]]
            most += np.add.reduceat(self.marked[np.concatenate(part) & low], np.cumsum([0, *map(len, part[:-1])]), dtype=np.int64).tolist()
        self.marked[one & low] = False
        maybe = [j for j, n in zip(others, most) if self._enough(min(n, one.size, self.sets[j].size), one.size, self.sets[j].size)]
        return [j for j in maybe if self._enough(np.intersect1d(one, self.sets[j], assume_unique=True).size, one.size, self.sets[j].size)]


def forest(bits: np.ndarray, first: int = 0, radius: int = RADIUS, sets: Alike | None = None) -> list[tuple[int, int]]:
    """Links, as pairs of rows, that connect what all links connect: fewer than there are rows. With `first`, only links
    between the rows before it and those from it on; with `sets`, only those between sets that are alike."""
    stored = planes(bits[first:])
    # planes in which nearly all agree come last: they rarely decide
    order = np.argsort(np.abs(bits[first:].mean(axis=0) - 0.5), kind="stable")
    union, count = _Union(len(bits)), len(bits) - first
    for start in range(0, first or len(bits), TILE):
        word = 0 if first else start // 64  # within one block, links go to later rows
        hits = near(bits[start : min(start + TILE, first or len(bits))], stored[:, word:], order, radius)
        hits = np.unpackbits(hits.view(np.uint8), axis=1, bitorder="little")[:, : count - 64 * word]
        rows, others = np.nonzero(hits)
        rows, others = rows + start, others + first + 64 * word
        later = others > rows  # a row is within the radius of itself
        union.link_all(rows[later], others[later], sets)
    return union.links


def small_forests(bits: np.ndarray, group: np.ndarray, radius: int = RADIUS, sets: Alike | None = None) -> list[tuple[int, int]]:
    """As forest(), for many small groups that lie side by side: 64 lanes of a word hold the distances of neighbours at one
    offset, whichever group they are of, and offsets grow until no group is that long."""
    union, width = _Union(len(bits)), bits.shape[1]
    for offset in range(1, len(bits)):
        at = np.flatnonzero(group[offset:] == group[:-offset])
        if not at.size:
            break
        for start in range(0, len(at), LANES):
            i = at[start : start + LANES]
            lanes = planes(bits[i] ^ bits[i + offset])
            hits = np.unpackbits(near(np.zeros((1, width), np.uint8), lanes, np.arange(width), radius).view(np.uint8), bitorder="little")[: i.size]
            rows = i[np.flatnonzero(hits)]
            union.link_all(rows, rows + offset, sets)
    return union.links


#: Distances of neighbours, and rows of a group, that are worked out together.
LANES, TILE = 1 << 14, 64
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Larger groups are compared row by row against their planes.
SMALL = 32


def _links_of(batches: Iterator[pd.DataFrame], radius: int, least: float) -> Iterator[pd.DataFrame]:
    """batches: t, k, i, j, o, fp and perhaps node, which stands for fp in links, and set, to be alike by `least`; sorted by t, k, i, j. The rows
    of a group that may go on in the next batch wait for it."""

    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf[["t", "k", "i", "j"]].to_numpy()
        fps = pdf["fp"]
        bits = bits_of(fps.tolist() if fps.dtype == object else fps.to_numpy().astype(np.int64).view(np.uint64))
        nodes = pdf["node" if "node" in pdf else "fp"].to_numpy()
        sets = [np.frombuffer(x, "<u4") for x in pdf["set"]] if "set" in pdf else None
        alike = lambda rows: sets and Alike([sets[k] for k in rows], least)
        starts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1]
        sizes = np.diff(np.r_[starts, len(fps)])
        group = np.repeat(np.arange(len(starts)), sizes)
        whole = keys[:, 2] == keys[:, 3]
        small = np.flatnonzero(whole & (sizes[group] <= SMALL))
        ends = [small[np.array(small_forests(bits[small], group[small], radius, alike(small)), np.int64).reshape(-1, 2)]]
        for at, n in zip(starts, sizes):
            if n <= SMALL and whole[at]:
                continue
            rows = np.arange(at, at + n)
            first = 0
            if not whole[at]:  # only what is between the two blocks
                left = pdf["o"].to_numpy()[rows] == keys[at, 2]
                rows, first = np.r_[rows[left], rows[~left]], int(left.sum())
                if first in (0, n):
                    continue
            ends.append(rows[np.array(forest(bits[rows], first, radius, alike(rows)), np.int64).reshape(-1, 2)])
        ends = nodes[np.concatenate(ends)]
        return pd.DataFrame({"a": ends.min(axis=1), "b": ends.max(axis=1)})

    waiting = None
    for batch in batches:
        if waiting is not None:
            batch = pd.concat([waiting, batch], ignore_index=True)
        last = (batch[["t", "k", "i", "j"]] == batch[["t", "k", "i", "j"]].iloc[-1]).all(axis=1).to_numpy()
        waiting, batch = batch[last], batch[~last]
        if len(batch):
            yield found(batch.reset_index(drop=True))
    if waiting is not None and len(waiting):
        yield found(waiting.reset_index(drop=True))


def links(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """prints: column fp, distinct. Returns links a, b (a < b as signed numbers), enough to connect every component."""
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in band_masks(radius)])
    keyed = prints.select("fp", F.posexplode(masks).alias("t", "m")).select("fp", "t", F.col("fp").bitwiseAND(F.col("m")).alias("k"))
    return _linked(keyed, "fp", radius, block)


def _linked(keyed: DataFrame, node: str, radius: int, block: int, least: float = 0.0) -> DataFrame:
    """keyed: t, k, fp, the column `node` and perhaps set. Links of what has a key t, k in common; sets must be alike by `least`."""
    counts = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).filter("n > 1")
    # a key of n fingerprints has ceil(n / block) blocks; a fingerprint of block i goes to the pairs (i, j) and (j, i)
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64(node, "t"), F.col("nb")).cast("int")
    dealt = (
        keyed.join(counts, ["t", "k"])
        .withColumn("nb", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .select("t", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own").alias("o"), *dict.fromkeys(["fp", node, *({"set"} & {*keyed.columns})]))
    )

    # a number of tasks, for few bytes can be much work
    tasks = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(tasks, "t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j")
    return ordered.mapInPandas(lambda batches: _links_of(batches, radius, least), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges a, b. Returns node, root for every node of an edge; the root is one node of its component.

    Alternates large-star and small-star steps, each of which links nodes to the least node they see, until the edges are
    stars; the number of rounds grows with the logarithm of the longest path. Each round is cut off by a checkpoint, and
    only the number of edges and a checksum come back to the driver.
    """
    now = checkpointed(edges.select("a", "b").filter("a <> b").distinct())
    seen = None
    while True:
        # large star: every larger neighbour goes to the least of the node's neighbourhood, itself included
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        # small star: every smaller neighbour, and the node, go to the least of them
        down = large.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"))
        floor = down.groupBy("x").agg(F.min("y").alias("m"))
        small = down.join(floor, "x").select(F.col("m").alias("a"), F.col("y").alias("b")).unionByName(floor.select(F.col("m").alias("a"), F.col("x").alias("b")))
        now = checkpointed(small.filter("a <> b").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()


def _rooted(docs: DataFrame, radius: int, block: int) -> DataFrame:
    """docs: columns doc, fp and any others, checkpointed. Adds root, which names the component, and component_id."""
    prints = docs.groupBy("fp").agg(F.min("doc").alias("least"))
    roots = components(links(prints.select("fp"), radius, block))
    joined = prints.join(roots, prints.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return docs.join(joined.select("fp", "root").join(named, "root"), "fp")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """key, fp (long), component_id (the least key of the component) for every row.

    A null or wordless text has fingerprint zero and is linked like any other. Repeated rows are in one component. A null
    key never is a component's id unless it holds nothing else.
    """
    docs = checkpointed(df.select(F.col(key).alias("doc"), fingerprints(utf8(text)).alias("fp")))
    return _rooted(docs, radius, block).select(F.col("doc").alias(key), "fp", "component_id")


def _identified(df: DataFrame) -> DataFrame:
    """Adds _h1 and _h2, 128 bits that stand for a row. Nulls are left out of Spark's hashes, so which columns are null is hashed too."""
    whole = [*df.columns, *[F.col(c).isNull() for c in df.columns]]
    return df.withColumns({"_h1": F.xxhash64(*whole), "_h2": F.xxhash64(F.lit(1), *whole)})


def _one_of_each_root(df: DataFrame, rows: DataFrame) -> DataFrame:
    """rows: root, least (whether the row has the least key of the root), _h1, _h2, of every row of df. Of the rows with the least key of a root,
    that of least hash stays; of rows alike in all columns one. Rows to be dropped are broadcast if they are few; if not, texts are shuffled once."""
    chosen = rows.filter("least").groupBy("root").agg(F.min(F.struct("_h1", "_h2")).alias("_k")).select("_k.*")
    counts = checkpointed(rows.groupBy("_h1", "_h2").agg(F.count("*").alias("_n")).join(chosen.withColumn("_kept", F.lit(True)), ["_h1", "_h2"], "left"))
    kept, dropped = counts.filter("_kept"), counts.filter("_kept is null").select("_h1", "_h2")
    packed = _identified(df).select(F.struct(*df.columns).alias("_row"), "_h1", "_h2")
    if dropped.count() <= BROADCAST:
        found = packed.join(F.broadcast(dropped), ["_h1", "_h2"], "left_anti")
    else:
        found = packed.join(kept.select("_h1", "_h2"), ["_h1", "_h2"], "left_semi")
    twins = kept.filter("_n > 1").select("_h1", "_h2")
    if not twins.isEmpty():  # of rows alike in all columns
        again = found.join(small(twins, BROADCAST), ["_h1", "_h2"], "left_semi").dropDuplicates(["_h1", "_h2"])
        found = found.join(small(twins, BROADCAST), ["_h1", "_h2"], "left_anti").unionByName(again)
    return found.select("_row.*")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of df for each component: of the rows with its least key, that of least row hash. A row without a key stays
    only if its component holds no key. Components are told apart by what links them, not by their id: two texts of one key
    (or of none) that no links join both stay. Rows alike in all columns are one."""
    docs = checkpointed(_identified(df).select(F.col(key).alias("doc"), "_h1", "_h2", fingerprints(utf8(text)).alias("fp")))
    return _one_of_each_root(df, _rooted(docs, radius, BLOCK).withColumn("least", F.col("doc").eqNullSafe(F.col("component_id"))))


def shingle_hashes(text: bytes, words: int = SIMILAR_WORDS, seed: int = SEED) -> np.ndarray:
    """The hashes of the set of shingles, ascending; a wordless text has one shingle, hash zero."""
    found = text.lower().split()
    digest = xxhash.xxh64_digest
    if len(found) >= words:
        raw = b"".join([digest(b" ".join(x), seed) for x in zip(*(found[k:] for k in range(words)))])
    else:
        raw = digest(b" ".join(found), seed) if found else bytes(8)
    return np.unique(np.frombuffer(raw, ">u8").astype(np.uint64))


def sketch(text: bytes, words: int = SIMILAR_WORDS, seed: int = SEED) -> tuple[int, bytes, list[int]]:
    """(a hash of the set of shingles, its wide fingerprint, its LOW least hashes), signed."""
    hashes = shingle_hashes(text, words, seed)
    ones = np.zeros(WIDE, np.int64)
    for start in range(0, len(hashes), 255 * 64):
        mixed = hashes[start : start + 255 * 64, None] * _ODD
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        bits = np.unpackbits((mixed ^ (mixed >> np.uint64(29))).view(np.uint8), axis=1)
        for at in range(0, len(bits), 255):  # sums that fit a byte are fast
            ones += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return xxhash.xxh64_intdigest(hashes.tobytes(), seed) - (1 << 63), np.packbits(2 * ones > len(hashes)).tobytes(), hashes[:LOW].view(np.int64).tolist()


#: Odd multipliers that make WIDE bits of a hash's 64.
_ODD = np.random.default_rng(7).integers(1, 1 << 63, WIDE // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def radius_of(similarity: float, bits: int = WIDE, slack: float = SLACK) -> int:
    """Bits within which pairs of a similarity differ."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * share + slack * np.sqrt(bits * share * (1 - share)))


def keep_one_similar(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = SIMILAR_WORDS, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """As keep_one(), with texts linked whose sets of shingles (as hashes of 32 bits) have a Jaccard similarity of `similarity` or more, and those
    with equal sets (by a hash of 64 bits). A null text has no words; wordless texts are alike."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([sketch(x, words) for x in batch], columns=["node", "fp", "low"])

    sketched = F.pandas_udf(run, "struct<node: bigint, fp: binary, low: array<bigint>>").asNondeterministic()(utf8(text))
    docs = checkpointed(_identified(df).select(F.col(key).alias("doc"), "_h1", "_h2", sketched.alias("s")).select("doc", "_h1", "_h2", "s.*"))
    one = F.min(F.struct("_h1", "_h2")).alias("row")  # one that has the text of a class
    classes = checkpointed(docs.groupBy("node").agg(F.min("doc").alias("least"), F.first("fp").alias("fp"), F.first("low").alias("low"), one))
    low = classes.select("node", F.explode("low").alias("k"))
    shared = low.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
    rarest = F.row_number().over(W.partitionBy("node").orderBy("n", "k"))
    keys = low.join(shared, "k").withColumn("place", rarest).filter(F.col("place") <= KEYS).select("node", "k", F.lit(0).alias("t"))
    keyed = checkpointed(keys.join(classes.select("node", "fp"), "node"))
    radius = radius_of(similarity)
    loose = components(_linked(keyed, "node", radius, block))
    rows = checkpointed(classes.join(loose, "node").select("node", F.col("root").alias("k"), F.lit(0).alias("t"), "fp", "row.*"))

    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([np.unique((shingle_hashes(x, words) >> np.uint64(32)).astype("<u4")).tobytes() for x in batch])

    texts = _identified(df).select("_h1", "_h2", utf8(text).alias("text")).join(small(rows.select("_h1", "_h2"), BROADCAST), ["_h1", "_h2"], "left_semi")
    made = checkpointed(texts.select("_h1", "_h2", F.pandas_udf(sets, "binary").asNondeterministic()("text").alias("set")).dropDuplicates(["_h1", "_h2"]))
    again = rows.join(made, ["_h1", "_h2"]).drop("_h1", "_h2")
    roots = components(_linked(again, "node", radius, min(block, SET_BLOCK), similarity)).withColumnRenamed("node", "_node")
    rooted = classes.join(roots, F.col("node") == F.col("_node"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    rows = docs.select("doc", "_h1", "_h2", "node").join(rooted.select("node", "root").join(named, "root"), "node")
    return _one_of_each_root(df, rows.withColumn("least", F.col("doc").eqNullSafe(F.col("component_id"))))
