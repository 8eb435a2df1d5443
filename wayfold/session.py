"""Session builder and lineage control."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "wayfold", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; sizes are left to the cluster's own settings."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Only in local mode, where none may be set, a folder of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="wayfold-checkpoint-")
            atexit.register(shutil.rmtree, named, True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each context.

    Call it before making a UDF: a UDF carries the files known when it is made.
    """
    sc = spark.sparkContext
    if getattr(sc, "_wayfold_shipped", False):
        return
    home = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="wayfold-package-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/wayfold.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, Path(home.name) / f.relative_to(home))
    sc.addPyFile(f"{folder}/wayfold.zip")
    sc._wayfold_shipped = True


def release(spark: SparkSession) -> None:
    """Let the context cleaner drop shuffle and checkpoint files that nothing refers to any more.

    The cleaner acts when the driver's JVM collects garbage, which small iterative jobs
    seldom make it do.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, which survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """Cut lineage with Parquet files in the shared folder: fewer bytes than a checkpoint's, and only wanted columns are read again."""
    path = f"{shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path in whatever store holds it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
