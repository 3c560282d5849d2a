"""Session helpers shared by every operator: table reads, lineage cuts, input spreading, size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []  # the temporary folder of a local session


def build_session(app: str = "riskweave", cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the engine expects (AQE on, UTC, Arrow on)."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One parquet table, pruned to ``columns`` when given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from the session's ``spark.checkpoint.dir``.

    Only where that is unset and the master is local (tests, a laptop) is a temporary folder made, and removed when the
    process ends; on a cluster without the setting this raises.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="riskweave-tables-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder: its lineage ends there, and a lost executor costs a read.

    Unlike ``checkpoint()``, which runs the plan once for its count and again for its files, the plan runs once; the table is
    compressed, and its size is known to the planner. ``drop`` removes it.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop(df: DataFrame | None) -> None:
    """Removes the files of a table written by ``cut``, once nothing lazy reads it any more; other frames are left alone."""
    path = getattr(df, "_written", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Round-robin a scan with fewer partitions than cores (one small file) before Python-heavy work.

    A large input already has more splits than the cluster has cores, so nothing is shuffled there.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want * per_core)


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Broadcast hint only when a bounded count proves the side small; else leave the join to shuffle (AQE splits skew)."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
