"""Session settings that the operators count on."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",  # larger methods are not compiled to machine code; Spark then takes smaller ones
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    """A builder with the settings: UTC, adaptive execution, and overwriting of written partitions only."""
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    return builder


def importable(spark: SparkSession) -> SparkSession:
    """The session, whose Python workers look for this package where the driver has it as well.

    Enough for local sessions; on a cluster, ship the package with --py-files.
    """
    home, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    there = env.get("PYTHONPATH", "").split(os.pathsep)
    if home not in there:
        env["PYTHONPATH"] = os.pathsep.join([home, *filter(None, there)])
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below spark.checkpoint.dir, which all executors see; where that is unset (local sessions), below the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_work"
    return f"{root.rstrip('/')}/terracell/{name}-{uuid.uuid4().hex}"
