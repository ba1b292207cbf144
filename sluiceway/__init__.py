"""sluiceway: taint-flow analytics over agent tool-call logs, on Spark."""

import os


def at_hand(spark) -> None:
    """Let Python workers on this machine import the package (on a cluster, ship it with --py-files)."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if here not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [here, known]))
