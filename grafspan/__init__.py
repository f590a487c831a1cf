"""Code-graph analytics on Spark: graph, retrieval and incremental operators as DataFrame plans."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path


def importable(spark) -> None:  # noqa: ANN001
    """Lets Python workers on this machine import the package from where the driver has it. A cluster gets it by --py-files."""
    env, here = spark.sparkContext.environment, str(Path(__file__).resolve().parent.parent)
    if here not in (old := env.get("PYTHONPATH", "")).split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [here, old]))


def shared_dir(spark) -> str:  # noqa: ANN001
    """The folder in spark.checkpoint.dir, which all executors share. Where that is unset, a local master gets a folder of its own; any other must name one."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="grafspan-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at.rstrip("/")
