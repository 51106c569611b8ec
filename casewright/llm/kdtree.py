"""Exact top-k inner products with KD-trees, one for each shard.

Rows are numbered, and dealt to shards by a hash of the number. A shard's rows come to one task ahead of the queries sent
to it; the task builds one tree by median splits with tight boxes, and answers the queries as they stream by, best-first: nodes wait in
order of the greatest inner product their box allows, and the search ends when that falls below the k-th score known. A first pass over
one shard for each query gives k-th scores that the other shards start from, so far boxes are never opened. The answers of
the shards, k at most for each query and shard, are ranked at the end. How many boxes stay shut is up to the data: where vectors
spread alike over many dimensions, none does, and every row is scored.

Components x become floor(1024 * x); scores are integers and exact (floats are used only where all sums stay below
2**53). Vectors that are null or empty, or hold null or non-finite components, or differ in length from the query take no part; nor does a
row with a null id. A query's own row is no candidate, but other rows with its id are. Repeated ids: every query row has its own answer,
so a repeated query row gives its answer as often as it occurs, and a repeated candidate takes a place for each row. Components and
scores beyond a long are taken as the nearest long. Ties go to the smaller id. Other columns, whatever their names, are not read. An empty
table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm.tables import materialise

SCALE = 1024
#: Rows of a shard: 16 for each of the square root of all rows, so that queries go to few shards, within these limits.
SHARD_ROWS = (1024, 1 << 15)
#: Queries of a batch that are bounded against all boxes at once.
QUERY_BLOCK = 512
LEAF_ROWS = 128


def usable_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and the integer vector of every row that takes part."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    sound = rows.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(~bad)
    return sound.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double"))).alias("v"))


class Tree:
    """Median splits on the widest axis; every node has the tight box of its rows."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF_ROWS) -> None:
        self.nodes: list[tuple[int, int, int, int]] = []  # first row, last row, children or -1
        low, high = [], []
        order = np.arange(len(ids))
        todo = [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            part = vectors[order[a:b]]
            lo, hi = part.min(axis=0), part.max(axis=0)
            at = len(self.nodes)
            self.nodes.append((a, b, -1, -1))
            low.append(lo)
            high.append(hi)
            if parent >= 0:
                x = list(self.nodes[parent])
                x[2 + side] = at
                self.nodes[parent] = tuple(x)
            axis = int((hi - lo).argmax())
            if b - a > leaf and hi[axis] > lo[axis]:
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, axis], mid)]
                todo += [(a, a + mid, at, 0), (a + mid, b, at, 1)]
        self.rows, self.ids, self.vectors = rows[order], ids[order], vectors[order]
        self.low, self.high = np.array(low), np.array(high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(queries, nodes): the greatest inner product with any point of the node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query_row: int, query: np.ndarray, bound: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the best k whose score reaches floor, best first."""
        ids, scores = np.empty(0, np.int64), np.empty(0, self.vectors.dtype)
        waiting = [(-bound[0], 0)]
        while waiting:
            top, at = heapq.heappop(waiting)
            kth = max(floor, scores[-1]) if len(scores) == k else floor
            if -top < kth:
                break
            a, b, left, right = self.nodes[at]
            if left >= 0:
                for child in (left, right):
                    if bound[child] >= kth:
                        heapq.heappush(waiting, (-bound[child], child))
                continue
            s = self.vectors[a:b] @ query
            near = np.flatnonzero((s >= kth) & (self.rows[a:b] != query_row))
            ids, scores = np.concatenate([ids, self.ids[a:b][near]]), np.concatenate([scores, s[near]])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
        return ids, scores


def _matrix(rows: pd.Series, exact_float: bool) -> np.ndarray:
    return np.array(rows.tolist(), dtype=np.float64 if exact_float else object)


def _most(rows: pd.Series) -> int:
    return max(int(np.abs(np.asarray(v, dtype=np.float64)).max()) for v in rows)


class Shard:
    """The trees of a shard's rows, one for each length of vectors."""

    def __init__(self, data: pd.DataFrame) -> None:
        self.data = {size: own for size, own in data.groupby(data["v"].map(len))}
        self.most = {size: _most(own["v"]) for size, own in self.data.items()}
        self.trees: dict[tuple[int, bool], Tree] = {}

    def tree(self, size: int, exact_float: bool) -> Tree:
        if (size, exact_float) not in self.trees:
            own = self.data[size]
            self.trees[size, exact_float] = Tree(own["row"].to_numpy(np.int64), own["vec_id"].to_numpy(np.int64), _matrix(own["v"], exact_float))
        return self.trees[size, exact_float]

    def search(self, queries: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
        """queries: row, vec_id, v, floor. The best k rows for every query, with score at floor or above."""
        for size, asked in queries.groupby(queries["v"].map(len)):
            if size not in self.data:
                continue
            exact_float = self.most[size] * _most(asked["v"]) * int(size) < 1 << 52
            tree = self.tree(size, exact_float)
            for at in range(0, len(asked), QUERY_BLOCK):
                some = asked.iloc[at : at + QUERY_BLOCK]
                q = _matrix(some["v"], exact_float)
                bounds, out = tree.bounds(q), []
                for i, (row, floor) in enumerate(zip(some["row"], some["floor"])):
                    out.append(tree.search(int(row), q[i], bounds[i], k, -np.inf if pd.isna(floor) else int(floor)))
                n = [len(ids) for ids, _ in out]
                scores = [min(max(int(x), -(1 << 63)), (1 << 63) - 1) for _, found in out for x in found]
                yield pd.DataFrame(
                    {
                        "query_row": np.repeat(some["row"].to_numpy(np.int64), n),
                        "query_id": np.repeat(some["vec_id"].to_numpy(np.int64), n),
                        "vec_id": np.concatenate([ids for ids, _ in out]),
                        "score": np.array(scores, dtype=np.int64),
                    }
                )


def search_stream(parts: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """Rows (shard, asks, row, vec_id, v, floor), sorted by shard and asks: a shard's rows, then its queries."""
    at, held, shard = None, [], None
    for part in parts:
        for of, rows in part.groupby("shard", sort=True):
            if of != at:
                at, held, shard = of, [], None
            held.append(rows[~rows["asks"]])
            asked = rows[rows["asks"]]
            if len(asked):
                if shard is None:
                    data = pd.concat(held)
                    shard, held = Shard(data) if len(data) else False, []
                if shard:
                    yield from shard.search(asked, k)


def _answers(data: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """data: shard, row, vec_id, v. queries: the same with floor, a row for each shard that a query goes to."""
    named = ["shard", "asks", "row", "vec_id", "v", "floor"]
    both = data.withColumns({"asks": F.lit(False), "floor": F.lit(None).cast("long")}).select(*named).unionAll(queries.withColumn("asks", F.lit(True)).select(*named))
    dealt = both.repartition("shard").sortWithinPartitions("shard", "asks", "row")
    return dealt.mapInPandas(lambda parts: search_stream(parts, k), "query_row long, query_id long, vec_id long, score long")


def top_inner_products(vectors: DataFrame, is_query: Column, k: int, shard_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of vectors (vec_id, v) where is_query holds, against all other rows."""
    numbered = vectors.select("vec_id", "v", F.monotonically_increasing_id().alias("row"))
    vectors = materialise(numbered, "kd-vectors")  # written, so a row keeps its number
    n = vectors.count()
    low, high = SHARD_ROWS
    shards = max(1, math.ceil(n / (shard_rows or min(max(low, int(16 * math.sqrt(n))), high))))
    data = vectors.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    asked = vectors.where(is_query).withColumn("first", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(shards)).cast("int"))
    seed = materialise(_answers(data, asked.withColumn("shard", F.col("first")).withColumn("floor", F.lit(None).cast("long")), k), "kd-seed")
    floors = seed.groupBy(F.col("query_row").alias("row")).agg(F.min("score").alias("floor"), F.count("*").alias("found")).select("row", F.when(F.col("found") >= k, F.col("floor")).alias("floor"))
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    rest = asked.join(floors, "row", "left").withColumn("shard", every).where(F.col("shard") != F.col("first"))
    found = materialise(seed.unionAll(_answers(data, rest, k)), "kd-found")
    # a shard's k best are few; what all shards found for a query is ranked together
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_similar(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """The k greatest inner products for every row whose vec_id is divisible by `every`."""
    return top_inner_products(usable_vectors(embeddings), F.col("vec_id") % every == 0, k)
