"""Session, table access and lineage cutting shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "scholion", cpus: str | int = "8", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once per context, by a zip in the shared folder.

    Where the folder is no file system the driver can write to, the package has to be
    installed on the executors.
    """
    context = spark.sparkContext
    if getattr(context, "_scholion_shipped", False):
        return
    context._scholion_shipped = True
    at = shared_dir(spark)
    if "://" in at and not at.startswith("file://"):
        return
    folder = Path(at.removeprefix("file://").removeprefix("file:"))
    folder.mkdir(parents=True, exist_ok=True)
    package = Path(__file__).resolve().parent
    path = folder / f"scholion-{uuid.uuid4().hex[:12]}.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(str(path))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and runs on this machine alone (tests) is one made
    and set; on a cluster a folder of one machine would be of no use to the others.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        at = tempfile.mkdtemp(prefix="scholion-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The table outlives any executor, so later stages never recompute what led to it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def brief_plans(spark: SparkSession, letters: int = 4_000) -> Iterator[None]:
    """While many small steps run, the driver keeps no more of each plan's text than this; it keeps all of them to the end."""
    key = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(key)
    spark.conf.set(key, str(letters))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drop(df: DataFrame) -> None:
    """Delete the files of a materialised table that is no longer read."""
    spark = df.sparkSession
    root = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    for uri in df.inputFiles()[:1]:
        folder = os.path.dirname(uri)
        if root in folder:
            fs, at = _file(spark, folder)
            fs.delete(at, True)


def _file(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file to a folder that the session reaches, over what was there."""
    fs, at = _file(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file, whole."""
    fs, at = _file(spark, path)
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()

