"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_fallback: dict[str, str] = {}
_shipped: set[str] = set()
_made: dict[str, list[str]] = {}


def build(app: str = "folio", master: str = "local[8]", **conf: str) -> SparkSession:
    """A session with the settings the tests and the bench use."""
    builder = SparkSession.builder.master(master).appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "6g",
        "spark.driver.host": "127.0.0.1",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.  A local master may do without: it gets a temporary one, gone when Python ends."""
    conf = spark.sparkContext.getConf()
    if folder := conf.get("spark.checkpoint.dir"):
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _fallback:
        _fallback[key] = tempfile.mkdtemp(prefix="folio-")
        atexit.register(shutil.rmtree, _fallback[key], ignore_errors=True)
    return f"file://{_fallback[key]}"


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def keep(df: DataFrame, name: str, wide: bool = False, release: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps neither recompute it nor lose it with an executor.

    ``wide`` rows hold megabytes: they get row groups of two, since Spark's reader holds up to 4096 rows of a group at once.
    ``release`` deletes the shuffle files of the write when it is done; else they stay until the driver collects its garbage.
    Results may read it until they are used, so it stays until :func:`clean`.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    few = {"parquet.block.row.count.limit": 2}
    before = spark.conf.get(_RELEASE, None)
    if release:
        spark.conf.set(_RELEASE, "true")
    try:
        df.write.options(**few if wide else {}).parquet(path)
    finally:
        if release:
            spark.conf.unset(_RELEASE) if before is None else spark.conf.set(_RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Delete what this application has kept in the shared folder; the number of tables.  Results that still read them end here."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for p in paths:
        path = hadoop.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that were started without it on their path."""
    root = Path(__file__).resolve().parent
    paths = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if str(root.parent) in paths or app in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="folio-zip-")) / "folio.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in root.rglob("*.py"):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
