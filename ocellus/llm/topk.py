"""Exact top-k search by inner product, by no-random-access aggregation of sorted lists.

Queries and candidates meet in a grid of blocks of bounded size. In a block each dimension has its candidates' values as a sorted
list, read from the end that gives a query's largest products. All lists are read to the same depth, in rounds. What has been
read of a candidate, plus the most that each unread entry can still add (the value at which reading stands), bounds its score from
above; with the list's far end instead, from below. No candidate can be ruled out before the sum of the values at which reading
stands falls below a query's floor, so rounds before that cost nothing but that sum. Reading ends when few candidates outside can
still qualify; their scores are then resolved exactly. One pivot block is searched first: its k-th best score is each query's floor in
all other blocks.

Scores are integers: every component x counts as floor(scale * x), kept as a whole double, so components of any size take part.
Bounds allow for the rounding of doubles; final scores are summed up in integers as wide as needed, and one outside the range of a
long is an error. Defined cases: vectors that are null, empty, or hold a null or non-finite component take no part, nor do rows
with a null id; only vectors of equal length are compared; a repeated row is a candidate each time, but one query (an id that stands
for several vectors is a query with each, ranked together); ties go to the smaller id; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ocellus.runtime import cut_lineage

SCALE = 1024
K = 10
#: Most candidates and queries in a block; blocks are made smaller to have this many at least.
MOST_CANDIDATES, MOST_QUERIES, LEAST_BLOCKS = 32_768, 16_384, 24
#: Queries whose bounds are held at once, and rounds from the ends of the lists to their other ends.
BATCH, ROUNDS = 128, 8


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v (array of whole doubles) of the rows that take part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    fine = F.col("vec_id").isNotNull() & (F.size(x) > 0) & F.coalesce(finite, F.lit(False))
    whole = lambda y: F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)  # noqa: E731  larger ones are whole already
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: whole(e.cast("double") * scale)).alias("v"))


class Lists:
    """A block's candidates with one sorted list per dimension."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, np.ascontiguousarray(values, np.float64)
        self.sorted = np.sort(self.values, axis=0)
        self.largest = float(np.abs(self.values).max())

    def search(self, queries: np.ndarray, own: np.ndarray, floors: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """For each query: (place, score) of the k best candidates whose id isn't in ``own`` and whose score reaches ``floors`` (minus
        infinity: none is known)."""
        out: list[list[tuple[int, int]]] = []
        for at in range(0, len(queries), BATCH):
            part = slice(at, at + BATCH)
            out += self._batch(np.ascontiguousarray(queries[part], np.float64), own[part], floors[part].astype(np.float64), k)
        return out

    def _batch(self, q: np.ndarray, own: np.ndarray, floors: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        n, d = self.values.shape
        out: list[list[tuple[int, int]]] = [[] for _ in q]
        up, down = np.maximum(q, 0).T, np.minimum(q, 0).T
        bound = d * self.largest * float(np.abs(q).max())
        if n <= 4 * k or not bound < 1e300:
            for i in range(len(q)):
                out[i] = self._resolve(q[i], np.flatnonzero(self.ids != own[i]), k, bound)
            return out
        if bound >= 2.0**53:  # sums of doubles round
            slack = (2 * d + 16) * 2.0**-52
            size = slack * (np.sqrt((self.values**2).sum(1)) + math.sqrt(d) * self.largest)[:, None] * np.sqrt((q**2).sum(1))
            floors = floors - np.abs(np.where(np.isfinite(floors), floors, 0)) * slack
        else:
            size = None
        mine = self.ids[:, None] == own
        open_ = np.arange(len(q))
        for depth in sorted({math.ceil(n * r / ROUNDS) for r in range(1, ROUNDS + 1)}):
            top, bottom = self.sorted[n - depth], self.sorted[depth - 1]
            unseen = top @ up[:, open_] + bottom @ down[:, open_]  # the most that a candidate can have that is in no list's read part
            now = open_[(unseen < floors[open_]) | (~np.isfinite(floors[open_]) & (2 * depth >= n)) | (depth == n)]
            if not len(now):
                continue
            most = np.maximum(self.values, top) @ up[:, now] + np.minimum(self.values, bottom) @ down[:, now]
            if size is not None:
                most += size[:, now]
            bare = ~np.isfinite(floors[now])
            if bare.any():  # the k-th best of the lower bounds is a floor
                some = now[bare]
                least = np.where(self.values >= top, self.values, self.sorted[0]) @ up[:, some] + np.where(self.values <= bottom, self.values, self.sorted[-1]) @ down[:, some]
                if size is not None:
                    least -= size[:, some]
                least[mine[:, some]] = -np.inf
                floors[some] = np.partition(least, n - k, axis=0)[n - k]
            most[mine[:, now]] = -np.inf
            alive = (most >= floors[now]) & ~mine[:, now]
            few = np.count_nonzero(alive, axis=0) <= max(4 * k, n // 16)
            if depth == n:
                few[:] = True
            for i, j in zip(now[few], np.flatnonzero(few), strict=True):
                out[i] = self._resolve(q[i], np.flatnonzero(alive[:, j]), k, bound)
            floors[now[bare & ~few]] = -np.inf  # the next round has better ones
            open_ = np.setdiff1d(open_, now[few])
        return out

    def _resolve(self, query: np.ndarray, alive: np.ndarray, k: int, bound: float) -> list[tuple[int, int]]:
        """Exact scores of ``alive``, the k best of them."""
        if bound < 2.0**53:
            exact = (self.values[alive] @ query).astype(np.int64)
        elif bound < 2.0**62:
            exact = self.values[alive].astype(np.int64) @ query.astype(np.int64)
        else:
            wide = [int(x) for x in query]
            exact = np.array([sum(int(a) * b for a, b in zip(row, wide, strict=True)) for row in self.values[alive]], object)
        best = sorted(range(len(alive)), key=lambda i: (-exact[i], self.ids[alive[i]]))[:k] if exact.dtype == object else np.lexsort((self.ids[alive], -exact))[:k]
        found = [(int(alive[i]), int(exact[i])) for i in best]
        if any(not -(2**63) <= s < 2**63 for _, s in found):
            raise OverflowError("a score outside the range of a long")
        return found


def _met(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """query_id, mark, d, vec_id, score and copies of the best of every block (r, c, d)."""

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple[int, ...]] = []
        if a.num_rows and b.num_rows:
            width = a["d"][0].as_py()
            table = lambda t: t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            ids, copies = a["vec_id"].to_numpy(), a["copies"].to_numpy()
            lists, own, marks = Lists(ids, table(a)), b["vec_id"].to_numpy(), b["mark"].to_pylist()
            floors = np.array([-np.inf if x is None else x for x in b["floor"].to_pylist()], np.float64)
            for i, mark, found in zip(own.tolist(), marks, lists.search(table(b), own, floors, k), strict=True):
                out += [(i, mark, width, int(ids[j]), score, int(copies[j])) for j, score in found]
        cols = list(zip(*out, strict=True)) or [[]] * 6
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "mark", "d", "vec_id", "score", "copies"])

    keys = ["r", "c", "d"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, mark long, d long, vec_id long, score long, copies long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best of ``vectors`` for each of ``queries`` (both: vec_id, v)."""
    n, m = vectors.count(), queries.count()
    rows = max(LEAST_BLOCKS, math.ceil(n / MOST_CANDIDATES))
    cols = max(1, math.ceil(m / MOST_QUERIES))
    mark = F.xxhash64("v")
    spread = lambda parts: F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)).cast("int")
    every = lambda first, parts: F.explode(F.sequence(F.lit(first), F.lit(parts - 1)))
    # Equal rows travel as one, so no block outgrows its share; only k of them can count.
    distinct = vectors.groupBy("vec_id", "v").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("copies"))
    left = distinct.select(spread(rows).alias("r"), every(0, cols).alias("c"), F.size("v").alias("d"), "vec_id", "v", "copies")
    own = queries.select(F.col("vec_id").alias("vec_id"), F.col("v").alias("v")).distinct()  # other columns than the candidates', even if it is the same table
    asked = own.select(spread(cols).alias("c"), F.size("v").alias("d"), "vec_id", mark.alias("mark"), "v")
    pivot = cut_lineage(_met(left.where("r = 0"), asked.withColumn("r", F.lit(0)).withColumn("floor", F.lit(None).cast("long")), k))
    # By hash of the query's vector: where two of an id share it, the lower floor holds for both.
    floors = pivot.groupBy("query_id", "mark", "d").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
    floors = floors.select(F.col("query_id").alias("vec_id"), "mark", F.col("d").cast("int").alias("d"), "floor")
    others = asked.join(floors, ["vec_id", "mark", "d"], "left").withColumn("r", every(1, rows))
    met = pivot.unionByName(_met(left.where("r > 0"), others, k)).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
