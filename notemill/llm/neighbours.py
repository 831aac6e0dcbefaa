"""Nearest neighbours by cosine, with a vantage-point tree for each shard.

Vectors are dealt to shards of bounded size by a hash of their row number, so that copies of one vector spread over all of them. A
shard's tree splits its vectors by their distance to a vantage vector at the median; distances are those of the unit vectors,
which obey the triangle inequality. A query first looks into the leaf it would be in itself, which gives it a k-th
distance; then it visits every subtree whose lower bound, times `factor`, is not above that distance. With factor 1 nothing
nearer can be missed; a larger factor prunes more and may miss some.

A task holds one shard; the queries of the whole table stream past it in Arrow batches. Neither side is collected, and a shard's vectors are
sent again only for each QUERY_BLOCK of queries. Each shard gives a query k rows; the best k of all shards are its answer.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notemill.llm import common as C

#: Vectors of a shard on average, queries that stream past one copy of a shard, vectors of a leaf.
SHARD_ROWS, QUERY_BLOCK, LEAF = 32_768, 1 << 18, 256
#: Rounding of a cosine, and of a distance that is its square root.
COSINE_SLACK, DISTANCE_SLACK = 1e-12, 1e-6


def distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


class Tree:
    """A vantage-point tree over unit vectors. order: the vectors by leaf; a leaf is a slice of it."""

    def __init__(self, unit: np.ndarray, leaf: int = LEAF, seed: int = 11):
        self.unit, self.leaf, self.nodes = unit, leaf, []
        self.order = np.arange(len(unit))
        self._rng = np.random.default_rng(seed)
        self._grow(0, len(unit))

    def _grow(self, low: int, high: int) -> int:
        at = len(self.nodes)
        self.nodes.append((low, high, None, None, None, None))
        part = self.order[low:high]
        if len(part) <= self.leaf:
            return at
        # the vantage vector with the widest spread of distances to a few others
        tries, some = (self._rng.choice(part, min(len(part), n), replace=False) for n in (8, 128))
        vantage = self.unit[tries[np.argmax(distance(self.unit[some] @ self.unit[tries].T).var(axis=0))]]
        d = distance(self.unit[part] @ vantage)
        by = np.argsort(d, kind="stable")
        self.order[low:high], d = part[by], d[by]
        middle = len(part) // 2
        bounds = (d[0], d[middle - 1], d[middle], d[-1])
        inner = self._grow(low, low + middle)
        outer = self._grow(low + middle, high)
        self.nodes[at] = (low, high, vantage, bounds, inner, outer)
        return at

    def homes(self, queries: np.ndarray):
        """(leaf's node, places in queries): each query's home leaf."""
        todo = [(0, np.arange(len(queries)))]
        while todo:
            at, some = todo.pop()
            _, _, vantage, bounds, inner, outer = self.nodes[at]
            if vantage is None:
                yield at, some
            elif len(some):
                near = distance(queries[some] @ vantage) <= (bounds[1] + bounds[2]) / 2
                todo += [(inner, some[near]), (outer, some[~near])]

    def visits(self, queries: np.ndarray, reach, factor: float):
        """(leaf's node, places in queries) of the leaves that can't be pruned; reach(places) are their distances at that moment."""
        todo = [(0, np.arange(len(queries)))]
        while todo:
            at, some = todo.pop()
            low, high, vantage, bounds, inner, outer = self.nodes[at]
            if not len(some):
                continue
            if vantage is None:
                yield at, some
                continue
            d, near = distance(queries[some] @ vantage), reach(some) + DISTANCE_SLACK
            for child, (a, b) in ((outer, bounds[2:]), (inner, bounds[:2])):
                least = np.maximum(np.maximum(a - d, d - b), 0.0)
                todo.append((child, some[factor * np.maximum(least - DISTANCE_SLACK, 0.0) <= near]))


class Shard:
    """Vectors of one length with their ids and row numbers. Equal vectors are one point of the tree; of its rows the k + 1 with the smallest ids can be an answer."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, none: np.ndarray, k: int, leaf: int = LEAF):
        self.k, self.compared = k, 0
        vectors = scaled(vectors)
        _, first, of = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
        self.points = vectors[first]
        self.norms = np.sqrt((self.points * self.points).sum(axis=1))
        by = np.lexsort((rows, ids, none, of.ravel()))
        start = np.searchsorted(of.ravel()[by], np.arange(len(first) + 1))
        self.start, self.length = start[:-1], np.minimum(np.diff(start), k + 1)
        self.ids, self.rows, self.none = ids[by], rows[by], none[by]
        self.tree = Tree(self.points / self.norms[:, None], leaf)

    def search(self, vectors: np.ndarray, own: np.ndarray, factor: float):
        """(query, row's place, score): for each query its k nearest rows but its own, nearest first, ties to the smaller id."""
        vectors = scaled(vectors)
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        unit, width = vectors / norms[:, None], min(self.k + 1, len(self.points))
        best = np.full((len(unit), width), -1)
        score = np.full((len(unit), width), -np.inf)
        seen = np.full(len(unit), -1)

        def look(node: int, some: np.ndarray) -> None:
            low, high = self.tree.nodes[node][:2]
            points = self.tree.order[low:high]
            self.compared += len(some) * len(points)
            close = unit[some] @ self.tree.unit[points].T
            w = min(width, len(points))
            least = np.maximum(score[some, -1], np.partition(close, len(points) - w, axis=1)[:, len(points) - w] if w == width else -np.inf)
            q, p = np.nonzero(close >= least[:, None] - COSINE_SLACK)
            if not len(q):
                return
            p = points[p]
            exact = self.scores(vectors, norms, some[q], p)
            touched = np.unique(q)
            back, old = np.nonzero(best[some[touched]] >= 0)
            kept = some[touched[back]]
            q = np.concatenate([q, touched[back]])
            p = np.concatenate([p, best[kept, old]])
            exact = np.concatenate([exact, score[kept, old]])
            by = np.lexsort((self.ids[self.start[p]], self.none[self.start[p]], -exact, q))
            q, p, exact = q[by], p[by], exact[by]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            top = rank < width
            best[some[q[top]], rank[top]], score[some[q[top]], rank[top]] = p[top], exact[top]

        for node, some in self.tree.homes(unit):
            if len(some):
                look(node, some)
                seen[some] = node
        for node, some in self.tree.visits(unit, lambda at: distance(score[at, -1]) if width == self.k + 1 else np.full(len(at), np.inf), factor):
            some = some[seen[some] != node]
            if len(some):
                look(node, some)
        q, w = np.nonzero(best >= 0)
        p, s = best[q, w], score[q, w]
        n = self.length[p]
        place = np.repeat(self.start[p] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(p) else np.zeros(0, np.int64)
        q, s = np.repeat(q, n), np.repeat(s, n)
        other = self.rows[place] != own[q]
        q, s, place = q[other], s[other], place[other]
        by = np.lexsort((self.rows[place], self.ids[place], self.none[place], -s, q))
        q, s, place = q[by], s[by], place[by]
        top = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        return q[top], place[top], s[top]

    def scores(self, vectors: np.ndarray, norms: np.ndarray, q: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Cosines of pairs, the same for the same two vectors wherever they stand."""
        out = np.empty(len(q))
        for low in range(0, len(q), 1 << 14):
            a, b = q[low : low + (1 << 14)], p[low : low + (1 << 14)]
            out[low : low + (1 << 14)] = (vectors[a] * self.points[b]).sum(axis=1) / (norms[a] * self.norms[b])
        return out


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors over a power of two, so that squares neither overflow nor vanish; cosines stay the same to the bit."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -exponent[:, None]) + 0.0


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _searched(k: int, factor: float):
    """Rows come in order of (shard, block, size, whether a query): a shard's vectors, then its queries."""
    schema = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.float64())])

    def run(batches):
        at, held, shard = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1).astype(np.int64)
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(marks)]):
                if low == high:
                    continue
                part, group, asks = batch.slice(low, high - low), tuple(marks[low, :3]), marks[low, 3]
                if group != at:
                    at, held, shard = group, [], None
                rows, ids = (part.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
                none = np.asarray(part.column(5).is_null())
                ids = np.where(none, 0, ids).astype(np.int64)
                if not asks:
                    held.append((_matrix(part.column(6)), ids, rows, none))
                elif held or shard:
                    if shard is None:
                        shard = Shard(*(np.concatenate(x) for x in zip(*held)), k)
                        held = []
                    q, place, score = shard.search(_matrix(part.column(6)), rows, factor)
                    found = pa.array(shard.ids[place], mask=shard.none[place])
                    yield pa.RecordBatch.from_arrays([pa.array(rows[q]), pa.array(ids[q]), found, pa.array(shard.rows[place]), pa.array(score)], schema=schema)

    return run


def nearest(vectors: DataFrame, queries: str = "vec_id % 50 = 0", k: int = 5, factor: float = 1.0, key: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Per row of vectors that `queries` (a condition on key) takes: query_id, rank (from 1), vec_id, score of its k nearest other rows by cosine.

    Nearest first, ties to the smaller key, null keys last. Vectors that are null, empty, zero or hold a null or a value that isn't finite take no part, neither as
    queries nor as candidates. Vectors of different lengths are never compared; their length may be any. Repeated rows are rows of their
    own: each finds the other. A query with fewer candidates gets all of them, one with none no row; an empty table gives no rows. Columns of other
    names are ignored. factor: 1 for exact search, more to prune more.
    """
    if factor < 1:
        raise ValueError("factor must be 1 or more")
    rows = vectors.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = C.written(C.with_row(rows.where(F.col("v").isNotNull()).where(fine)), "vectors")
    asked = rows.withColumnRenamed("vec_id", key).where(queries).withColumnRenamed(key, "vec_id")
    shards = max(1, math.ceil(rows.count() / shard_rows))
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    dealt = lambda n, salt: F.pmod(F.xxhash64("_row", F.lit(salt)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    size = F.size("v").alias("size")
    held = rows.select(dealt(shards, 1).alias("shard"), each(blocks).alias("block"), size, F.lit(0).alias("asks"), "_row", "vec_id", "v")
    asking = asked.select("*", dealt(blocks, 2).alias("block")).select(each(shards).alias("shard"), "block", size, F.lit(1).alias("asks"), "_row", "vec_id", "v")
    met = held.union(asking).repartition(shards * blocks, "shard", "block").sortWithinPartitions("shard", "block", "size", "asks")
    found = met.mapInArrow(_searched(k, factor), "query_row bigint, query_id bigint, vec_id bigint, row bigint, score double")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
