"""Reading frames, scene manifests and charsets; writing marks and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE = "source_id string, seq long, width int, height int, stride long, format string, rotation int, data binary"


def read_images(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """Encoded image files with their scene and frame number, from names like frame_00012.png."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    number = F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long")
    return files.select("path", F.regexp_extract("path", r"([^/]+)/(?:frames/)?[^/]+$", 1).alias("scene_id"), number.alias("seq"), "length", "content")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Scene manifests: one JSON document a file."""
    schema = "scene_id string, platform string, width int, height int, rotation int, frame_count int, fps_hint double, notes string"
    return spark.read.schema(schema).json(path, multiLine=True)


def read_charset(spark: SparkSession, path: str) -> DataFrame:
    """A recogniser's characters, one a line: index from 1 (0 is the blank) and symbol. A charset is one small file, read whole."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("i", "symbol"))
    return lines.select((F.col("i") + 1).alias("index"), "symbol")


def accessibility_regions(nodes: DataFrame) -> DataFrame:
    """Nodes of an accessibility tree as externally supplied regions."""
    words = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return nodes.select("frame_id", F.col("left").cast("double").alias("x"), F.col("top").cast("double").alias("y"), (F.col("right") - F.col("left")).cast("double").alias("w"), (F.col("bottom") - F.col("top")).cast("double").alias("h"), words("text").alias("text"), words("class_name").alias("role"), words("description").alias("description"), F.lit(1.0).alias("confidence"), F.col("clickable").alias("interactive"), "enabled")


def write_marks(marks: DataFrame, path: str) -> None:
    """Marks by frame."""
    marks.write.mode("errorifexists").parquet(path)


def write_events(events: DataFrame, path: str) -> None:
    """Appends confirmed events, partitioned by source."""
    events.write.mode("append").partitionBy("source_id").parquet(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """What a scene's frames show, as people have marked it: one JSON document a file, a row per box."""
    schema = "scene_id string, frames array<struct<seq: long, boxes: array<struct<x: double, y: double, w: double, h: double, label: string, text: string>>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select("scene_id", F.explode("frames").alias("f"))
    return rows.select("scene_id", F.col("f.seq").alias("seq"), F.posexplode("f.boxes").alias("pos", "b")).select("scene_id", "seq", "pos", "b.*")
