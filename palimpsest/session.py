"""What a session needs before Python runs on its executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def local(spark: SparkSession) -> bool:
    """Driver and executors are one process on one machine."""
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors through Spark, once an application. Only a local session whose
    Python workers find the package on their own path (PYTHONPATH, or started in the repository) needs
    none; what the driver finds says nothing of other machines."""
    sc = spark.sparkContext
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if sc.applicationId in _shipped or (local(spark) and (ROOT in paths or Path.cwd().resolve() == ROOT)):
        return
    target = Path(tempfile.mkdtemp(prefix="palimpsest-")) / "palimpsest.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((ROOT / "palimpsest").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def shared(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a local session gets one of its own; on
    a cluster, whose machines would each write to their own disk, that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")
