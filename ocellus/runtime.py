"""Session, table and scratch-folder helpers shared by every subpackage."""

from __future__ import annotations

import gc
import math
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "ocellus", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per application, so that it need not be installed there."""
    sc = spark.sparkContext
    if getattr(sc, "_ocellus_shipped", False):
        return
    root = Path(__file__).resolve().parent
    made = Path(tempfile.mkdtemp(prefix="ocellus-code-")) / "ocellus_code.zip"
    with zipfile.ZipFile(made, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, Path("ocellus") / path.relative_to(root))
    sc.addPyFile(str(made))  # Spark's own file server passes it on
    sc._ocellus_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` below ``sf_dir``, read by Spark so that any store Spark knows will do."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session, where one machine is the whole cluster, may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="ocellus-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` materialised once by ``checkpoint()`` in the shared folder; survives the loss of executors."""
    home = shared_dir(df.sparkSession)
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(home)
    return df.checkpoint(eager=True)


#: Rows of a table that is kept for each of its files.
ROWS_A_FILE = 10_000


def few(df: DataFrame, rows: float) -> DataFrame:
    """``df`` in no more partitions than so many rows need. Each partition of a table that is kept or returned is a file, and for each file
    on a store without Hadoop's native code an executor starts a process, which for a moment shows all the executor's memory as its own.
    ``rows`` is what the last step works on, so that partitions grow in number with it."""
    return df.coalesce(max(1, math.ceil(rows / ROWS_A_FILE)))


def sweep(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files and checkpoints of finished steps: it only learns that nothing refers to them when the
    driver collects its garbage. For jobs of many steps, between those that move much data."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: a compressed way to cut lineage."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
