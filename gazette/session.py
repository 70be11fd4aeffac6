"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Set by a local session: over how many partitions small one-file tables are dealt out.
SPREAD = "spark.gazette.spread"
#: Where a local session without ``spark.checkpoint.dir``, which cannot be set later, keeps its intermediate tables.
_OWN_FOLDER = "spark.gazette.folder"


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options that results depend on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gazette")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Recording the call site of every column makes large expressions slow to build.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config(SPREAD, str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder under the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of the machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN_FOLDER, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="gazette-")
        spark.conf.set(_OWN_FOLDER, root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """A one-file table dealt out to all cores where a local session asks for it; else as it is, without a shuffle."""
    parts = int(df.sparkSession.conf.get(SPREAD, "0"))
    return df.repartition(parts) if parts else df
