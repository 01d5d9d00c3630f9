"""Session construction and cluster-facing settings."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings every chirpflow job relies on. AQE re-plans joins and coalesces
# shuffle partitions at run time and splits skewed join partitions; UTC keeps
# day/month keys independent of the machine's zone.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    master: str | None = None,
    app: str = "chirpflow",
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Get or create a session with chirpflow's base settings.

    On a cluster leave ``master`` unset (spark-submit decides) and size
    ``shuffle_partitions`` to the data (~128-256 MB per partition); locally
    pass ``local[N]``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (conf or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting it from the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that is what
    iterative operators use to cut lineage (``DataFrame.checkpoint``), so a
    lost executor never forces a recompute from the start. Only a local-mode
    session without that setting (tests) gets a private temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master == "local" or sc.master.startswith("local["):
        path = tempfile.mkdtemp(prefix="chirpflow-ckpt-")
        sc.setCheckpointDir(path)
        return sc.getCheckpointDir()
    raise RuntimeError(
        "spark.checkpoint.dir is not set; iterative operators need a shared "
        "checkpoint folder on a cluster"
    )


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for an intermediate table under the shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def written(df, name: str):
    """``df`` written once to the shared folder and read back: cuts lineage, and is read as often as needed."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors (once per application), so that Python
    workers find its kernels whatever their working directory is."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="chirpflow-"), "chirpflow.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(top):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.join("chirpflow", os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str):
    """Read one driver table (one Parquet file or folder) by name."""
    ship_package(spark)
    return spark.read.parquet(table_path(sf_dir, name))


def local_frame(spark: SparkSession, rows: list, schema):
    """A small DataFrame from collected rows, shipped to the JVM as Arrow (no Python
    workers needed to decode it). Only for bounded, already-collected data."""
    import pandas as pd

    pdf = pd.DataFrame([tuple(r) for r in rows], columns=schema.fieldNames())
    return spark.createDataFrame(pdf, schema)
