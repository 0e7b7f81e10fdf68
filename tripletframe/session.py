"""Spark session defaults used by tests, bench and the driver entry."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "tripletframe") -> SparkSession:
    """Return (or create) a session with AQE on, Arrow on and the UI off.

    On a cluster the master and shuffle partitions come from spark-submit;
    AQE coalesces/splits partitions at run time, so the static number here only
    matters for local runs.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256m")
        .config("spark.sql.files.maxPartitionBytes", "256m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        .config("spark.sql.parquet.aggregatePushdown", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TF_DRIVER_MEMORY", "16g"))
    )
    if master:
        b = b.master(master)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder: the cluster's ``spark.checkpoint.dir`` when set.

    Only when a local session names none (tests) a fresh folder under the
    system temp dir is created and registered. On a cluster a machine-local
    folder would lose data, so a missing setting is an error there.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    conf = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="tf-ckpt-")
    sc.setCheckpointDir(conf)
    return conf


def cut_lineage(df):
    """Materialise ``df`` in the shared checkpoint folder and continue from the written data.

    Used where one intermediate feeds several branches of a large plan: the
    optimizer then sees one small leaf instead of a copy of the whole
    upstream plan per branch, and a lost executor recomputes from the files.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tripletframe`` importable in every Python worker (Arrow UDFs, mapInPandas).

    Zips the package once per driver process and adds it with ``addPyFile``
    (what ``--py-files`` does for spark-submit), once per SparkContext.
    """
    import shutil

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="tf-pyfiles-")
    archive = shutil.make_archive(os.path.join(out, "tripletframe"), "zip", root_dir=os.path.dirname(pkg), base_dir="tripletframe")
    sc.addPyFile(archive)
    _SHIPPED.add(key)
