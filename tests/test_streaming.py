"""Streams give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from ocellus.operators import continuous, ids, tracker
from ocellus.sources import fixtures as fx
from ocellus.streaming import processors


def run(spark, df, process, order, tmp_path, name):
    """``df`` as a stream of two files."""
    cut = df.approxQuantile(order, [0.5], 0.0)[0]
    for i, part in enumerate((df.where(F.col(order) <= cut), df.where(F.col(order) > cut))):
        part.coalesce(1).write.parquet(str(tmp_path / "all" / f"{i}"))
    source = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "all"))
    q = process(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


@pytest.mark.parametrize("which", ["events", "tracks", "ids"])
def test_stream_equals_batch(spark, sf_dir, tmp_path, which):
    if which == "events":
        df = fx.event_entities(spark, sf_dir).where("source_id < 20")
        batch, process = continuous.semantic_events(df), processors.semantic_events
    elif which == "tracks":
        rows = fx.event_entities(spark, sf_dir).where("source_id < 20")
        df = rows.select("source_id", F.col("stable_id").alias("track_id"), "seq", F.when(F.col("observed") == "present", "placeholder").otherwise("confirmed").alias("grade"))
        batch, process = tracker.commit(df), processors.track_states
    else:
        df = fx.evidence(spark, sf_dir).drop("source_id").join(fx.frames(spark, sf_dir), "frame_id").where("source_id < 20").select("source_id", "seq", F.col("evidence_id").alias("region_id"), "x", "y", "w", "h", "text")
        batch, process = ids.track(df), processors.stable_ids
    got = run(spark, df, process, "seq", tmp_path, f"stream_{which}")
    assert sorted(got.collect()) == sorted(batch.collect()) and batch.count()
