"""Session and table helpers shared by queries, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str | None = None, app: str = "spinel") -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPINEL_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; Spark's reader opens any file system."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster's spark.checkpoint.dir names, or a temporary one where that is unset and the session local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"{(base or 'file://' + tempfile.mkdtemp(prefix='spinel-text-')).rstrip('/')}/spinel-text/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written once as Parquet in a scratch folder and read back, for what several passes read."""
    out = f"{scratch_folder(df.sparkSession, name)}/table"
    df.write.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_spinel_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="spinel-ship-"), "spinel.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("spinel", os.path.relpath(path, here)))
    context.addPyFile(target)
    context._spinel_shipped = True
