"""Session helpers: ship the package to executors, and a session for local use."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="helixframe-")) / "helixframe.zip"
    with zipfile.ZipFile(target, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def folder(spark: SparkSession) -> str:
    """A fresh folder that the driver and all executors see: below ``spark.checkpoint.dir``, or a temporary one where all run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="helixframe-")
    return f"{base.rstrip('/')}/helixframe/{uuid.uuid4().hex}"


def local_session(cores: int = 8, shuffle: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("helixframe")
        .config("spark.sql.shuffle.partitions", str(shuffle)).config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
