"""Nearest neighbours by cosine with vantage-point trees.

Vectors are scaled to length one, where the Euclidean distance, which obeys the triangle inequality, orders pairs as the
cosine does. A small tree over a bounded sample cuts the space into regions; a region of more than SHARD vectors is dealt to
several shards by a hash of the id. Each shard has a vantage-point tree over its own vectors, which one task builds once; queries
stream past it in batches. A subtree, or a region, is left out for a query if (lower bound of its distances) x factor is above the distance of
the query's k-th neighbour so far. Factor 1 leaves out only what can't matter, so the search is exact; a larger factor is
faster and may miss.

A query is first asked in its own region. The distance of its k-th neighbour there decides which other regions it is sent to.
So a vector is shuffled once for each of the two rounds, and a query once for each shard that its bounds don't exclude; of each
shard only the query's k best come back. The sample shapes regions only: every vector is in a tree, and results don't depend on it.

Vectors that are null, of length zero, or with null or non-finite components take no part, nor do rows without an id. Of
rows that repeat an id one counts, the least by its components in order. Only vectors of one length are compared. Ties go to the smaller id. Components of any
finite size are compared: vectors are scaled by a power of two first, which changes no cosine. Other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.common import checkpointed, small

#: Vectors of a shard, and of a leaf of its tree.
SHARD, LEAF = 16_384, 128
#: Vectors that shape the regions, those of least hash, and the least of them in a region.
SAMPLE, REGION = 4096, 16
#: Production search is exact.
FACTOR = 1.0
#: Distances come from rounded products; what is within this of a bound is searched.
MARGIN = 1e-6


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that squares neither overflow nor vanish."""
    _, power = np.frexp(np.abs(vectors).max(axis=1, initial=0))
    return np.ldexp(vectors, -power[:, None])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of all pairs of rows; a pair's value doesn't depend on the other rows, unlike that of a matrix product."""
    return np.einsum("id,jd->ij", a, b)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the same row of b; sums run from the first component to the last."""
    a, b = scaled(a), scaled(b)
    dot, one, two = (np.cumsum(x, axis=1)[:, -1] for x in (a * b, a * a, b * b))
    return np.clip(dot / np.sqrt(one * two), -1.0, 1.0)


def units(vectors: np.ndarray) -> np.ndarray:
    vectors = scaled(vectors)
    return vectors / np.sqrt(np.einsum("id,id->i", vectors, vectors))[:, None]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of all pairs of rows of unit length."""
    return np.sqrt(2 - 2 * np.clip(products(a, b), -1.0, 1.0))


class Tree:
    """Arrays of nodes: a vantage, the greatest distance inside, the least outside, and the children; or a leaf's members."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.vectors, self.ids, self.leaf = units(vectors), ids, leaf
        self.root = self._build(np.arange(len(ids)))

    def _build(self, members: np.ndarray):
        if len(members) <= self.leaf:
            return members
        vantage, rest = members[:1], members[1:]
        away = distances(self.vectors[vantage], self.vectors[rest])[0]
        order = np.argsort(away, kind="stable")
        half = len(rest) // 2
        inner, outer = order[:half], order[half:]
        return vantage, away[inner[-1]], away[outer[0]], self._build(rest[inner]), self._build(rest[outer])

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float = FACTOR, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids), best first, of the k nearest of each query but the one of its own id; missing ones score -inf.
        limit: distances beyond which neighbours aren't wanted."""
        queries = units(queries)
        best = np.full((len(queries), k), -np.inf)
        names = np.full((len(queries), k), np.iinfo(np.int64).max)
        limit = np.full(len(queries), 2.0) if limit is None else limit

        def offer(rows: np.ndarray, members: np.ndarray) -> np.ndarray:
            scores = np.clip(products(queries[rows], self.vectors[members]), -1.0, 1.0)
            kept = np.where(self.ids[members] == own[rows, None], -np.inf, scores)
            hopeful = np.flatnonzero(kept.max(axis=1) >= best[rows, -1])
            if hopeful.size:
                at = rows[hopeful]
                score = np.concatenate([best[at], kept[hopeful]], axis=1)
                name = np.concatenate([names[at], np.broadcast_to(self.ids[members], (len(at), len(members)))], axis=1)
                name = np.where(score == -np.inf, np.iinfo(np.int64).max, name)
                order = np.lexsort((name, -score), axis=1)[:, :k]
                best[at], names[at] = np.take_along_axis(score, order, 1), np.take_along_axis(name, order, 1)
            return scores

        def reach(rows: np.ndarray) -> np.ndarray:
            return np.minimum(np.sqrt(2 - 2 * np.maximum(best[rows, -1], -1.0)), limit[rows]) + MARGIN

        def visit(node, rows: np.ndarray) -> None:
            if not rows.size:
                return
            if isinstance(node, np.ndarray):
                if node.size:
                    offer(rows, node)
                return
            vantage, inside, outside, inner, outer = node
            away = np.sqrt(2 - 2 * offer(rows, vantage)[:, 0])
            near = away <= (inside + outside) / 2
            visit(inner, rows[near])
            visit(outer, rows[~near])
            late = near & ((outside - away) * factor <= reach(rows))
            early = ~near & ((away - inside) * factor <= reach(rows))
            visit(outer, rows[late])
            visit(inner, rows[early])

        visit(self.root, np.arange(len(queries)))
        return best, names


@dataclass
class Regions:
    """A tree over a sample whose leaves are numbered; inner children hold what is at most `border` from the vantage."""

    root: object  # a number, or (vantage, border, inner, outer)
    count: int

    def home(self, vectors: np.ndarray) -> np.ndarray:
        vectors, out = units(vectors), np.zeros(len(vectors), np.int64)

        def visit(node, rows: np.ndarray) -> None:
            if isinstance(node, int):
                out[rows] = node
            elif rows.size:
                vantage, border, inner, outer = node
                near = distances(vectors[rows], vantage[None])[:, 0] <= border
                visit(inner, rows[near])
                visit(outer, rows[~near])

        visit(self.root, np.arange(len(vectors)))
        return out

    def bounds(self, vectors: np.ndarray) -> np.ndarray:
        """The least distance that a member of each region can have from each vector."""
        vectors, out = units(vectors), np.zeros((len(vectors), self.count))

        def visit(node, least: np.ndarray) -> None:
            if isinstance(node, int):
                out[:, node] = least
            else:
                vantage, border, inner, outer = node
                away = distances(vectors, vantage[None])[:, 0]
                visit(inner, np.maximum(least, away - border))
                visit(outer, np.maximum(least, border - away))

        visit(self.root, np.zeros(len(vectors)))
        return out


def regions(sample: np.ndarray, count: int) -> Regions:
    """About `count` regions, with REGION sampled vectors in each at least."""
    vectors, found = units(sample), 0

    def build(members: np.ndarray, parts: int):
        nonlocal found
        if parts < 2 or len(members) < 2 * REGION + 1:
            found += 1
            return found - 1
        rest = members[1:]
        away = distances(vectors[members[:1]], vectors[rest])[0]
        border = float(np.median(away))
        near = away <= border
        if near.all():
            found += 1
            return found - 1
        return vectors[members[0]], border, build(rest[near], parts // 2), build(rest[~near], parts - parts // 2)

    root = build(np.arange(len(vectors)), count)
    return Regions(root, found)


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v (array<double>): rows that take part."""
    v = F.col(vector).cast("array<double>")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & sound & F.exists("v", lambda x: x != 0)
    )


def one_of_each(rows: DataFrame) -> DataFrame:
    """rows: id, v. Of rows with one id, the least v; vectors are shuffled only if there are such rows."""
    again = rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    return rows.groupBy("id").agg(F.min("v").alias("v")) if not again.isEmpty() else rows


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float)


def _by_length(pdf: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
    return ((int(d), part) for d, part in pdf.groupby(pdf["v"].str.len()))


def search(vectors: DataFrame, queries: DataFrame, k: int, factor: float = FACTOR, shard: int = SHARD) -> DataFrame:
    """vectors and queries: id, v; ids are unique. Returns query_id, rank, vec_id, score."""
    n = vectors.count()
    sampled: dict[int, list] = {}
    for r in vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect():  # SAMPLE rows at most
        sampled.setdefault(len(r["v"]), []).append(r["v"])
    trees = {d: regions(np.array(rows), -(-n // shard)) for d, rows in sampled.items()}
    whole = Regions(0, 1)  # of lengths that aren't in the sample

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, part in _by_length(batch):
                yield part.assign(d=d, r=trees.get(d, whole).home(_matrix(part["v"])))

    placed = checkpointed(vectors.mapInPandas(homes, "id long, v array<double>, d int, r int"))
    sizes = placed.groupBy("d", "r").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    sizes = small(checkpointed(sizes), 100_000)  # a row for each length and region
    stored = placed.join(sizes, ["d", "r"]).select("d", "r", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int").alias("s"), F.lit(0).alias("asks"), "id", "v", F.lit(2.0).alias("reach"))

    def answered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """batches: sorted by d, r, s, asks. A shard's vectors come first, then what is asked of it."""
        now, tree, held = None, None, []
        for batch in batches:
            for name, part in batch.groupby(["d", "r", "s"], sort=False):
                if name != now:
                    now, tree, held = name, None, []
                held.append(part[part["asks"] == 0])
                part = part[part["asks"] == 1]
                if not len(part):
                    continue
                if tree is None:
                    members = pd.concat(held).sort_values("id")
                    if not len(members):
                        continue
                    ids, own = members["id"].to_numpy(), _matrix(members["v"])
                    tree, held = Tree(own, ids), []
                asked, wanted = part["id"].to_numpy(), _matrix(part["v"])
                best, names = tree.search(wanted, asked, k, factor, part["reach"].to_numpy())
                row, at = np.nonzero(best > -np.inf)
                vec = names[row, at]
                yield pd.DataFrame({"query_id": asked[row], "vec_id": vec, "score": cosines(wanted[row], own[np.searchsorted(ids, vec)])})

    def round_of(asked: DataFrame) -> DataFrame:
        """asked: d, r, id, v, reach. The k best of every shard of the region."""
        each = asked.join(sizes, ["d", "r"]).select("d", "r", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("s"), F.lit(1).alias("asks"), "id", "v", "reach")
        dealt = stored.unionByName(each).repartition("d", "r", "s").sortWithinPartitions("d", "r", "s", "asks")
        found = dealt.mapInPandas(answered, "query_id long, vec_id long, score double")
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)

    asked = queries.mapInPandas(homes, "id long, v array<double>, d int, r int").withColumn("reach", F.lit(2.0))
    near = round_of(asked)
    if all(tree.count < 2 for tree in trees.values()):
        return near.select("query_id", "rank", "vec_id", "score")
    near = checkpointed(near)
    last = near.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("worst"))

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, part in _by_length(batch):
                tree, reach = trees.get(d, whole), part["reach"].to_numpy()
                row, r = np.nonzero(tree.bounds(_matrix(part["v"])) * factor <= reach[:, None] + MARGIN)
                away = r != part["r"].to_numpy()[row]
                yield part.iloc[row[away]].assign(r=r[away])

    reach = F.coalesce(F.sqrt(2 - 2 * F.greatest("worst", F.lit(-1.0))), F.lit(2.0))
    sent = asked.drop("reach").join(last, "id", "left").select("id", "v", "d", "r", reach.alias("reach")).mapInPandas(others, "id long, v array<double>, d int, r int, reach double")
    both = near.drop("rank").unionByName(round_of(sent).drop("rank"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return both.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def self_search(df: DataFrame, every: int = 50, k: int = 5, key: str = "vec_id", vector: str = "embedding", factor: float = FACTOR, shard: int = SHARD) -> DataFrame:
    """The k nearest of every row whose id is divisible by `every`, among all other rows."""
    vectors = one_of_each(usable(df, key, vector))
    return search(vectors, vectors.filter(F.col("id") % every == 0), k, factor, shard)
