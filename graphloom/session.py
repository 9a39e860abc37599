"""Session set-up and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("graphloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("GRAPHLOOM_DRIVER_MEMORY", "4g"))
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the master is local (tests on one machine) a temporary folder is made and set; on a
    cluster it is an error, since each executor would write to its own disk.
    """
    key = "spark.checkpoint.dir"
    folder = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set(key, folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone; so is whoever could read the table
        pass


class Cuts:
    """Written tables in the shared folder that cut a plan's lineage.

    They survive the loss of an executor, unlike a local checkpoint, and are columnar and
    compressed, unlike an RDD checkpoint. ``drop`` removes one as soon as nothing reads it;
    the rest go when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: list[str] = []
        atexit.register(self.clear)

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{len(self.paths)}"
        self.paths.append(path)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._graphloom_cut = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_graphloom_cut", None)
        if path:
            _delete(self.spark, path)

    def clear(self) -> None:
        _delete(self.spark, self.base)


def ship_package(spark: SparkSession) -> None:
    """Send the package to the Python workers, once per context, so that it need not be installed or on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_graphloom_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="graphloom-")
    path = os.path.join(folder, "graphloom.zip")
    root = Path(__file__).resolve().parent
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    sc._graphloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def repo_root() -> Path:
    return Path(__file__).resolve().parent.parent
