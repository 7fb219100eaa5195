"""Nearest visual patterns: exact content, then perceptual hash, then correlation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocellus.operators.change import dhash, hash_similarity

PERCEPTUAL, TEMPLATE, MOST = 0.90, 0.80, 8


def ncc(a: Column, b: Column) -> Column:
    """Correlation of two arrays of gray values about their means; if either is flat, 1 if they are equal, else 0. All sums are whole
    numbers, so the result does not depend on an order of adding."""
    n = F.size(a)
    total = lambda v: F.aggregate(v, F.lit(0).cast("long"), lambda s, x: s + x)
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x.cast("long") * y), F.lit(0).cast("long"), lambda s, x: s + x)
    sa, sb = total(a), total(b)
    va, vb, cov = n * dot(a, a) - sa * sa, n * dot(b, b) - sb * sb, n * dot(a, b) - sa * sb
    return F.when((va == 0) | (vb == 0), F.when(a == b, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(cov / F.sqrt(va.cast("double") * vb.cast("double")))


def fingerprinted(entries: DataFrame) -> DataFrame:
    """``entries`` (entry_id, px) with content (a digest) and dhash."""
    return entries.withColumn("content", F.xxhash64("px")).withColumn("dhash", dhash(F.col("px"), 8))


#: Entries and queries in a block of the correlation tier at most, and blocks of entries at least.
BLOCK_ENTRIES, BLOCK_QUERIES, LEAST_BLOCKS = 32_768, 2_048, 8


def _alike(q: DataFrame, e: DataFrame, perceptual: float, most: int) -> DataFrame:
    """Pairs of near hashes. Hashes that differ in at most 6 bits agree in two bytes of 8, so pairs of bytes are keys of an equi-join. Of the
    entries with one hash only the ``most`` smallest ids can count, so no hash is a hot key."""
    own = e.groupBy("dhash").agg(F.slice(F.array_sort(F.collect_set("entry_id")), 1, most).alias("ids"))
    byte = lambda i: F.call_function("shiftrightunsigned", F.col("dhash"), (8 * i).cast("int")).bitwiseAND(F.lit(255))
    pairs = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(8) for j in range(i + 1, 8)))
    bands = F.explode(F.transform(pairs, lambda p: F.struct(p["i"].alias("i"), p["j"].alias("j"), (byte(p["i"]) * 256 + byte(p["j"])).alias("b")))).alias("band")
    left, right = q.select(F.col("dhash").alias("qh"), "dhash").distinct().select("qh", bands), own.select(F.col("dhash").alias("eh"), "dhash").select("eh", bands)
    near = left.join(right, "band").where(hash_similarity(F.col("qh"), F.col("eh")) >= perceptual).select("qh", "eh").distinct()
    met = q.select("query_id", F.col("dhash").alias("qh")).join(near, "qh").join(own.withColumnRenamed("dhash", "eh"), "eh")
    return met.select("query_id", F.explode("ids").alias("entry_id"), F.lit(1).alias("tier"), hash_similarity(F.col("qh"), F.col("eh")).alias("similarity"))


def _correlated(q: DataFrame, e: DataFrame, template: float, most: int) -> DataFrame:
    """Each query's ``most`` best entries by correlation in every block of a grid of queries and entries, by products of whole numbers."""
    rows, cols = (max(least, -(-df.count() // size)) for df, size, least in ((e, BLOCK_ENTRIES, LEAST_BLOCKS), (q, BLOCK_QUERIES, 1)))
    spread = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select(every(rows).alias("r"), spread("query_id", cols).alias("c"), "query_id", F.col("px").alias("q_px"))
    right = e.select(spread("entry_id", rows).alias("r"), every(cols).alias("c"), "entry_id", F.col("px").alias("e_px"))

    def table(column: pa.ChunkedArray) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if a.num_rows and b.num_rows:
            ids, x, y = b["entry_id"].to_numpy(), table(a["q_px"]), table(b["e_px"])
            n, sx, sy = x.shape[1], x.sum(1), y.sum(1)
            vx, vy = n * (x * x).sum(1) - sx * sx, n * (y * y).sum(1) - sy * sy  # whole numbers below 2^53, so sums are exact
            for name, one, s, v in zip(a["query_id"].to_pylist(), x, sx, vx, strict=True):
                spread_ = np.sqrt(v * vy)
                told = np.where(spread_ > 0, (n * (y @ one) - s * sy) / np.where(spread_ > 0, spread_, 1), (y == one).all(1))
                good = np.flatnonzero(told >= template)
                best = good[np.lexsort((ids[good], -told[good]))[:most]]
                found += [(name, int(ids[i]), float(told[i])) for i in best]
        cols = list(zip(*found, strict=True)) or [[], [], []]
        return pa.Table.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array([2] * len(cols[0]), pa.int32()), pa.array(cols[2], pa.float64())], ["query_id", "entry_id", "tier", "similarity"])

    return left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInArrow(meet, "query_id long, entry_id long, tier int, similarity double")


def search(queries: DataFrame, entries: DataFrame, perceptual: float = PERCEPTUAL, template: float = TEMPLATE, most: int = MOST) -> DataFrame:
    """query_id, rank, entry_id, tier and similarity: for each query (query_id, px) its best entries, by tier, similarity and id.

    A threshold of 1 turns a tier off. The exact tier is a hash join, the perceptual one an equi-join on pairs of hash bytes; only the
    correlation tier looks at all entries, in blocks of queries and entries. All thumbnails are of one size."""
    if not 0.9 <= perceptual <= 1:
        raise ValueError("the perceptual threshold must be 0.9 at least, so that pairs of equal hash bytes find every match")
    q = fingerprinted(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("px").alias("px")))
    e = fingerprinted(entries.select(F.col("entry_id").cast("long").alias("entry_id"), F.col("px").alias("px")))
    # Of equal entries, too, only the smallest ids can count.
    same = e.groupBy("content", "px").agg(F.slice(F.array_sort(F.collect_list("entry_id")), 1, most).alias("ids")).withColumnRenamed("px", "e_px")
    exact = q.join(same, "content").where(F.col("px") == F.col("e_px")).select("query_id", F.explode("ids").alias("entry_id"), F.lit(0).alias("tier"), F.lit(1.0).alias("similarity"))
    found = exact
    if perceptual < 1:
        found = found.unionByName(_alike(q, e, perceptual, most))
    if template < 1:
        found = found.unionByName(_correlated(q, e, template, most))
    best = found.groupBy("query_id", "entry_id").agg(F.min(F.struct("tier", (-F.col("similarity")).alias("s"))).alias("m")).select("query_id", "entry_id", "m.tier", (-F.col("m.s")).alias("similarity"))
    order = Window.partitionBy("query_id").orderBy("tier", F.desc("similarity"), "entry_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
