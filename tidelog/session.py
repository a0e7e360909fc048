"""What the engine asks of a session."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Settings that the plans count on: run-time planning, and splitting a join's hot keys even where that adds a shuffle.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> None:
    """Let Python workers on this host import the package. Other hosts need it on their Python path, as by ``--py-files``."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is what the cluster names in ``spark.checkpoint.dir``. Where that is unset a local master
    gets a temporary folder, and any other master the warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        own = "file://" + tempfile.mkdtemp(prefix="tidelog-")
    else:
        own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def shared_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark)}/tidelog/{label}-{uuid.uuid4().hex}"


def tuned(spark: SparkSession) -> SparkSession:
    """The session with :data:`SETTINGS` and importable by its workers."""
    importable(spark)
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark
