"""What a session needs before grouped functions run."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable in Python workers. Where PYTHONPATH or the working folder has it already, nothing is
    sent."""
    root = Path(__file__).resolve().parents[2]
    sc = spark.sparkContext
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p] + [Path.cwd()]
    if root in known or sc.applicationId in _shipped:
        return spark
    _shipped.add(sc.applicationId)
    to = tempfile.mkdtemp(prefix="gaugeline-")
    sc.addPyFile(shutil.make_archive(f"{to}/gaugeline", "zip", root, "gaugeline"))
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder that the driver and all executors see, which a cluster names in spark.checkpoint.dir. Only
    a session whose executors are threads of this process may go without."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gaugeline-"))
        root = sc.getCheckpointDir()
    return f"{root.rstrip('/')}/gaugeline/{name}-{uuid4().hex}"
