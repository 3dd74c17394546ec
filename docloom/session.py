"""Session defaults and small helpers shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "docloom", **conf: str) -> SparkSession:
    """A session with the settings the engine is tested with.

    UTC, ANSI mode, adaptive execution (coalescing and skew splitting) and
    Arrow transfer. ``conf`` overrides any of them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder (a Parquet file or a folder of them).

    Texts run to tens of thousands of characters, so Arrow batches are kept
    smaller than Spark's default of 10,000 rows unless the session says so."""
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable for Python workers, once per application.

    Workers do not see the driver's ``sys.path``; Spark hands the zipped package
    to every executor, also to ones that join later."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="docloom-")) / "docloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    spark.sparkContext.addPyFile(str(target))


def spread(df: DataFrame) -> DataFrame:
    """Give work that is heavy for its bytes one partition per core at least.

    A small file is read as fewer partitions than there are cores; only then
    are its rows redistributed. Inputs that already have enough partitions
    are returned unchanged, without a shuffle."""
    if df.isStreaming:
        return df
    ship(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


@lru_cache(maxsize=None)
def _own_folder(application: str) -> str:
    """A folder of this machine for one local session, removed when Python ends."""
    folder = tempfile.mkdtemp(prefix="docloom-checkpoints-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    Clusters name it in ``spark.checkpoint.dir``; only where that is unset and all
    runs on this machine (as in tests) a folder of this machine is used."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = _own_folder(spark.sparkContext.applicationId)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and read it from there."""
    ship(df.sparkSession)
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_to_files(df: DataFrame) -> DataFrame:
    """:func:`cut_lineage` as compressed Parquet: a checkpoint is written uncompressed
    unless the application was started otherwise. Removed when the application ends."""
    spark = df.sparkSession
    ship(spark)
    checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
