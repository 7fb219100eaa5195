"""Views of the test tables in the shapes the operators take.

Each view is one SQL text that Spark and the reference engine both run, so that oracles start from the same rows. All
coordinates are whole numbers held as doubles and every order is total, so results do not depend on rounding or luck.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ocellus.runtime import table

EVIDENCE = """
SELECT o_custkey AS source_id, l_orderkey AS frame_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS evidence_id,
  CAST((l_partkey % 16) * 2 AS DOUBLE) AS x, CAST((l_suppkey % 8) * 3 AS DOUBLE) AS y,
  CAST(16 + (CAST(l_quantity AS BIGINT) % 5) * 4 AS DOUBLE) AS w, CAST(12 + (l_partkey % 3) * 6 AS DOUBLE) AS h,
  CASE l_returnflag WHEN 'A' THEN 'external' WHEN 'R' THEN 'text' ELSE 'detection' END AS kind,
  CAST(l_partkey % 5 AS BIGINT) AS class_id, CAST(1 + l_partkey % 8 AS DOUBLE) / 8 AS confidence,
  CASE WHEN l_returnflag IN ('A', 'R') AND l_suppkey % 3 <> 0 THEN concat('t', CAST(l_partkey % 4 AS VARCHAR(9))) ELSE '' END AS text,
  CASE WHEN l_returnflag = 'R' THEN '' ELSE concat('c', CAST(l_partkey % 5 AS VARCHAR(9))) END AS label
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

#: Frames of a source in order.
FRAMES = """
SELECT o_custkey AS source_id, o_orderkey AS frame_id,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS seq
FROM orders"""

SEGMENTS = """
SELECT frame_id, segment_id, x0, y0, x0 + dx AS x1, y0 + dy AS y1, confidence FROM (
  SELECT l_orderkey AS frame_id,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS segment_id,
    CAST(l_partkey % 32 AS DOUBLE) AS x0, CAST(l_suppkey % 32 AS DOUBLE) AS y0,
    CAST((CAST(l_quantity AS BIGINT) % 5) * 4 AS DOUBLE) AS dx, CAST((l_linenumber % 4) * 4 AS DOUBLE) AS dy,
    CAST(1 + l_partkey % 8 AS DOUBLE) / 8 AS confidence
  FROM lineitem) t"""

#: 8x8 gray thumbnails, one per vector; 0 to 255.
THUMBS = """
SELECT label AS source_id, vec_id AS entry_id,
  CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS BIGINT) AS seq, embedding
FROM embeddings"""

EVENT_ENTITIES = """
SELECT user_id AS source_id, event_id % 4 AS stable_id, seq,
  CASE event_type WHEN 'error' THEN 'uncovered' WHEN 'signup' THEN 'absent' ELSE 'present' END AS observed, event_type AS text
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq FROM events) t"""

TOKENS = """
SELECT o_orderkey AS token_id, CASE WHEN o_custkey % 11 = 0 THEN 'other' ELSE 'cam' END AS source_id,
  CAST(o_custkey % 7 AS BIGINT) AS epoch, CAST(o_orderkey % 5 AS BIGINT) AS policy_revision,
  CAST(o_custkey % 4 AS BIGINT) AS generation, CAST(o_orderkey % 3 AS BIGINT) AS seq, o_custkey % 13 <> 0 AS in_flight
FROM orders"""


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """``sql`` over the named test tables."""
    return spark.sql(_named(sql), **{t: table(spark, sf_dir, t) for t in tables})


def _named(sql: str) -> str:
    """Table names as parameters, so that no temporary view is left behind."""
    sql = sql.replace("VARCHAR(9)", "STRING")
    return re.sub(r"\b(FROM|JOIN) (lineitem|orders|embeddings|events|documents|conversations|part|supplier|customer|pages)\b", r"\1 {\2}", sql)


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, EVIDENCE, "lineitem", "orders")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, FRAMES, "orders")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SEGMENTS, "lineitem")


def thumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, entry_id, seq and px (64 gray values as ints)."""
    return view(spark, sf_dir, THUMBS, "embeddings").selectExpr("source_id", "entry_id", "seq", "transform(embedding, e -> cast(greatest(0, least(255, floor(cast(e as double) * 256) + 128)) as int)) AS px")


THUMBS_PX = f"SELECT source_id, entry_id, seq, list_transform(embedding, lambda e: CAST(greatest(0, least(255, floor(CAST(e AS DOUBLE) * 256) + 128)) AS INTEGER)) AS px FROM ({THUMBS})"


def event_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, EVENT_ENTITIES, "events")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, TOKENS, "orders")
