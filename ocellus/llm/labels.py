"""A bounded sample of labelled documents, and fitting classifiers on it in a task of the cluster."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucket(doc_id, parts: int):
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def sample(docs: DataFrame, labels: DataFrame, label: str, keep, most_rows: int, most_bytes: int) -> DataFrame:
    """text and label of labelled documents for which ``keep`` (a condition on doc_id) holds: those whose id has the smallest hash, as
    many of either label where there are enough, ``most_rows`` rows at most. In that order a text is taken if it fits in what is
    left of ``most_bytes`` bytes; no other length limit holds. Rows without id, text or a label of 0 or 1 don't count, and equal
    rows count once."""
    spark = docs.sparkSession
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & keep(F.col("doc_id"))).distinct()
    counts = dict(told.groupBy("label").count().collect())
    few, many = sorted((0, 1), key=lambda x: (counts.get(x, 0), x))
    part = min(counts.get(few, 0), most_rows // 2)
    place = F.xxhash64("doc_id", F.lit(11))
    first = lambda x, n: told.where(F.col("label") == x).orderBy(place, "doc_id").limit(n)
    chosen = first(few, part).unionByName(first(many, most_rows - part))  # ``most_rows`` at most, so small enough to broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("mark")).where(F.length("text") > 0)
    sizes = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "mark", F.octet_length("text").alias("n")).distinct().orderBy(place, "doc_id", "label", "mark").limit(most_rows).collect()
    taken, left = [], most_bytes
    for r in sizes:
        if r.n <= left:
            taken.append((r.doc_id, r.label, r.mark))
            left -= r.n
    marked = spark.createDataFrame(taken, "doc_id long, label int, mark long")
    return texts.join(F.broadcast(marked), ["doc_id", "mark"]).groupBy("doc_id", "mark", "label").agg(F.first("text").alias("text")).select("text", "label")


def fitted(rows: DataFrame, fit: Callable[[list[tuple[str, int]]], bytes]) -> bytes:
    """``fit`` of all ``rows`` (text, label), in an order of their own, worked out by one task: the rows are a bounded sample, and the
    driver only gets the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(pair for b in batches for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([fit(found)], pa.binary())], ["model"])

    made = rows.select("text", "label").repartition(1).mapInArrow(run, "model binary").collect()
    return bytes(made[0].model) if made else fit([])
