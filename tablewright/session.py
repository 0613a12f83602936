"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings the library is tuned for. Everything that depends on the cluster
# (executors, memory, the checkpoint folder) stays with the caller.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Pages and texts can be megabytes each: bound Arrow batches by bytes, not only rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 * 1024 * 1024),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the library's runtime settings to a session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give every executor this package, so that its functions can be unpickled anywhere.

    Spark serves the archive to the executors itself; it is made once per application.
    """
    context = spark.sparkContext
    if getattr(context, "_tablewright_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tablewright-package-"), "tablewright.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in sorted(os.walk(package)):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    context._tablewright_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach.

    Local sessions (tests) get a temporary folder; on a cluster only the
    configured folder is ever used, and one has to be configured.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="tablewright-")
        spark.conf.set("spark.checkpoint.dir", folder)
        return folder
    raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")


def scratch_path(spark: SparkSession, name: str = "") -> str:
    """A new place in the shared folder; nothing is ever written twice."""
    return f"{shared_folder(spark).rstrip('/')}/tablewright-{name}{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Parquet rather than ``checkpoint()``: later statistics passes then read
    only the columns they need, and a lost executor costs no more than the
    tasks it ran.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
