"""Sharding by size-tiered compaction.

A :class:`ShardStore` is a folder of immutable Parquet shards and numbered manifests. ``append`` adds arrivals as small shards;
``compact`` merges runs of shards of similar size (a tier spans a factor of ``FANOUT``) into larger ones until they have the
target size; either ends by committing a manifest of the next number, which lists all shards that count. A manifest is
written under another name first and then takes its own in one step that fails if the name is taken (a hard link on a local file
system, a rename that never overwrites elsewhere, as HDFS has it): one writer of a number succeeds, readers see the old list or the
new one, and shards of a failed attempt are never listed. Old versions stay readable until ``vacuum`` deletes what no manifest
from a given one on lists, and what was written long ago and is listed nowhere.

Shards hold rows as they arrive, with all their columns, nulls included; repeated rows stay. Rows go to files as they are
partitioned, by no key, so no hot key matters; a partition is cut into pieces of a quarter of the target, and only a very long text
makes its shard larger than that. Columns may have any names. Appending nothing commits a manifest that lists the same shards, and a
store that only empty tables were appended to reads as an empty table. All arrivals need the columns of the first.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

FANOUT = 4
TARGET_BYTES = 32 << 20
#: Runs merged by one Spark job, each by a task of its own.
RUNS_A_JOB = 64
#: Most shards whose list is broadcast.
BROADCAST_SHARDS = 50_000
#: Files that no manifest lists are deleted after this long, when no attempt can still be about to list them.
ORPHAN_SECONDS = 7 * 24 * 3600


@dataclass(frozen=True)
class Shard:
    path: str
    tier: int
    rows: int
    n_bytes: int
    arrival: int


class CommitConflict(RuntimeError):
    """Another writer has committed the same manifest number."""


class ShardStore:
    """``row_bytes``: a column expression for what a row counts towards a shard's size."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, row_bytes: str = "coalesce(octet_length(text), 0) + 32"):
        self.spark, self.root, self.target, self.fanout, self.row_bytes = spark, root.rstrip("/"), target_bytes, fanout, row_bytes
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def versions(self) -> list[int]:
        """Numbers of all manifests."""
        found = self._fs.globStatus(self._path(f"{self.root}/manifest-*.json"))
        return sorted(int(x.getPath().getName()[9:-5]) for x in found or [])

    def _read(self, version: int | None) -> dict:
        known = self.versions()
        if not known:
            return {"shards": [], "schema": None}
        name = f"{self.root}/manifest-{known[-1] if version is None else version:08d}.json"
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> list[Shard]:
        """Shards of a version, by default the latest."""
        return [Shard(**x) for x in self._read(version)["shards"]]

    def schema(self) -> StructType:
        """Of the rows that were appended."""
        found = self._read(None)["schema"]
        if found is None:
            raise ValueError("nothing has been appended")
        return StructType.fromJson(found)

    def commit(self, shards: list[Shard], version: int, schema: StructType) -> int:
        """Make ``shards`` the list of ``version``, or raise if that is taken."""
        final = self._path(f"{self.root}/manifest-{version:08d}.json")
        draft = self._path(f"{self.root}/_draft-{uuid.uuid4().hex}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"version": version, "schema": schema.jsonValue(), "shards": [asdict(s) for s in shards]}).encode()))
        out.close()
        try:
            self._take_name(draft, final)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                raise CommitConflict(f"manifest {version} exists") from None
            raise
        finally:
            self._fs.delete(draft, False)
        return version

    def _take_name(self, draft, final) -> None:
        """Give the file ``draft`` the name ``final`` in one step, unless there is such a file."""
        if self._fs.getScheme() == "file":
            local = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
            self._jvm.java.nio.file.Files.createLink(local(final), local(draft))
            return
        options = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(draft, final, options)

    def tier_of(self, n_bytes: int) -> int:
        """0, 1 or 2: half the size that its tier is to reach, or more."""
        return sum(2 * n_bytes >= self.target / self.fanout**k for k in (0, 1))

    def _written(self, rows: DataFrame, arrival: int, *by: str) -> list[Shard]:
        """``rows`` as new shards, one for each partition that has any, or for each value of ``by`` in it; what they hold is read back from them."""
        folder = f"{self.root}/shards/{uuid.uuid4().hex}"
        rows.write.partitionBy(*by).parquet(folder)
        read = self.spark.read.schema(rows.schema).parquet(folder)
        told = read.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.expr(self.row_bytes)).alias("n"))
        return [Shard(r["path"], self.tier_of(int(r["n"])), r["rows"], int(r["n"]), arrival) for r in told.orderBy("path").collect()]

    def _cut(self, rows: DataFrame, piece: str) -> DataFrame:
        """``rows`` with a column ``piece``: a partition's rows up to a quarter of the target, then the next ones, and so on."""
        most = max(1, self.target // 4)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            before = 0
            for batch in batches:
                n = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64)
                upto = before + np.cumsum(n)
                number = (upto - n) // most
                before = int(upto[-1]) if len(upto) else before
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(number)], [*batch.schema.names[:-1], piece])

        sized = rows.select("*", F.expr(self.row_bytes).cast("long").alias(piece))
        return sized.mapInArrow(run, StructType([*rows.schema.fields]).add(piece, LongType()))

    def append(self, rows: DataFrame, arrival: int = 0) -> int:
        """Add ``rows`` as they are partitioned, without a shuffle, as small shards whatever the partitions' sizes; returns the new version."""
        known = self.versions()
        piece = "__piece"
        while piece in rows.columns:
            piece += "_"
        return self.commit(self.manifest() + self._written(self._cut(rows, piece), arrival, piece), (known[-1] if known else 0) + 1, rows.schema)

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """Runs to merge: of each tier below the last, neighbours in order of size, cut before they go over the next tier's size by more
        than a quarter. The last run of a tier waits for more unless it has ``fanout`` shards or half that size."""
        runs: list[list[Shard]] = []
        for tier in (0, 1):
            goal = self.target / self.fanout ** (1 - tier)
            run: list[Shard] = []
            for shard in sorted((s for s in shards if s.tier == tier), key=lambda s: (s.n_bytes, s.path)):
                if run and sum(s.n_bytes for s in run) + shard.n_bytes > goal * 1.25:
                    runs.append(run)
                    run = []
                run.append(shard)
            if len(run) >= self.fanout or 2 * sum(s.n_bytes for s in run) >= goal:
                runs.append(run)
        return [r for r in runs if len(r) > 1]

    def compact(self) -> int:
        """Merge until no tier has a run; each round is one commit. A run is one task that reads its shards and writes one file, at most 1.25
        times the target: no shuffle, whatever the rows' keys are."""
        version, schema = self.versions()[-1], self.schema()
        while runs := self.plan(shards := self.manifest()):
            done: list[Shard] = []
            for i in range(0, len(runs), RUNS_A_JOB):
                part = runs[i : i + RUNS_A_JOB]
                each = [self.spark.read.schema(schema).parquet(*[s.path for s in run]).coalesce(1) for run in part]
                done += self._merged(each, max(s.arrival for run in part for s in run))
            gone = {s.path for run in runs for s in run}
            version = self.commit([s for s in shards if s.path not in gone] + done, version + 1, schema)
        return version

    def _merged(self, each: list[DataFrame], arrival: int) -> list[Shard]:
        """Runs of one partition each, as one shard each: a union must not put single partitions together into one."""
        key, conf = "spark.sql.unionOutputPartitioning", self.spark.conf
        before = conf.get(key, None)
        conf.set(key, "false")
        try:
            return self._written(reduce(DataFrame.union, each), arrival)
        finally:
            conf.unset(key) if before is None else conf.set(key, before)

    def vacuum(self, keep_from: int, orphan_seconds: float = ORPHAN_SECONDS) -> None:
        """Delete manifests before ``keep_from``, files that only those list, and files that none lists and that are older than
        ``orphan_seconds``. No reader of an older version may be running."""
        kept = {s.path for v in self.versions() if v >= keep_from for s in self.manifest(v)}
        gone = {s.path for v in self.versions() if v < keep_from for s in self.manifest(v)} - kept
        for path in sorted(gone):
            self._fs.delete(self._path(path), False)
        for v in self.versions():
            if v < keep_from:
                self._fs.delete(self._path(f"{self.root}/manifest-{v:08d}.json"), False)
        listed = {self._path(p).toUri().getPath() for p in kept}
        oldest = (time.time() - orphan_seconds) * 1000
        folder = self._path(f"{self.root}/shards")
        files = self._fs.listFiles(folder, True) if self._fs.exists(folder) else None
        while files is not None and files.hasNext():
            found = files.next()
            if found.getModificationTime() < oldest and found.getPath().toUri().getPath() not in listed:
                self._fs.delete(found.getPath(), False)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version as: row (struct of all columns), path (its shard) and tier. Tiers are read one after the other, so no
        join is needed to tell a row's."""
        schema, shards = self.schema(), self.manifest(version)
        own, parts = F.struct(*(F.col(f"`{f.name}`") for f in schema.fields)), []
        for tier in sorted({s.tier for s in shards}):
            rows = self.spark.read.schema(schema).parquet(*[s.path for s in shards if s.tier == tier])
            parts.append(rows.select(own.alias("row"), F.col("_metadata.file_path").alias("path"), F.lit(tier).alias("tier")))
        if not parts:
            return self.spark.createDataFrame([], schema).select(own.alias("row"), F.lit("").alias("path"), F.lit(0).alias("tier"))
        return reduce(DataFrame.unionAll, parts)

    def sizes(self, version: int | None = None) -> DataFrame:
        """path, shard_rows and shard_bytes of a version's shards, for a join: broadcast if there are few enough. A shard's rows are
        bounded by its size, so no key is hot."""
        shards = self.manifest(version)
        told = self.spark.createDataFrame([(s.path, s.rows, s.n_bytes) for s in shards], "path string, shard_rows long, shard_bytes long")
        return F.broadcast(told) if len(shards) <= BROADCAST_SHARDS else told
