"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(name: str = "ruleweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects; settings of a running session or spark-submit win."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return ship(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only where that is unset (tests on one machine) a temporary folder is made and remembered in the session.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("ruleweave.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ruleweave-")
        spark.conf.set("ruleweave.shared.dir", found)
    return found.rstrip("/")


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors once per application, so that Python tasks can import it there."""
    context = spark.sparkContext
    if getattr(context, "_ruleweave_shipped", False):
        return spark
    package = Path(__file__).parent
    target = os.path.join(tempfile.mkdtemp(prefix="ruleweave-"), "ruleweave.zip")
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(target)
    context._ruleweave_shipped = True
    return spark
