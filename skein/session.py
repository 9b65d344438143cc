"""What a job needs on a cluster: a folder that all its machines share, and this package on the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

KEY = "spark.checkpoint.dir"


def one_machine(master: str) -> bool:
    """Whether driver and executors are one process, so that any local folder is shared."""
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; on one machine a folder of our own where none is named, else an error."""
    sc = spark.sparkContext
    at = spark.conf.get(KEY, None) or sc.getCheckpointDir()
    if not at:
        if not one_machine(sc.master):
            raise RuntimeError(f"set {KEY} to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="skein-")
        atexit.register(shutil.rmtree, at, True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark context.

    Executors fetch the archive from the driver whenever they start, also long after this call, so it
    stays until the driver ends.
    """
    sc = spark.sparkContext
    if getattr(sc, "_skein_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="skein-ship-")
    atexit.register(shutil.rmtree, folder, True)
    at = os.path.join(folder, "skein.zip")
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(at)
    sc._skein_shipped = True
