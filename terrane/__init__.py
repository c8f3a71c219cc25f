"""Spark-native layers, tile pyramids and training-data operators."""

from __future__ import annotations

import os


def visible(spark) -> None:
    """Let Python workers that don't start in this repository find the package: its folder goes on their path."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
