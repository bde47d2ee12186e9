"""Config files of jobs, and what their command lines share."""

from __future__ import annotations

import json
import logging
import os

from pyspark.sql import SparkSession


def load(name: str, path: str | None = None) -> dict:
    """The settings of job ``name``: those beside its module, with the ones of the JSON file ``path`` in their place. Unknown names are refused."""
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{name}.json"), encoding="utf-8") as f:
        found = json.load(f)
    if path:
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        if odd := sorted(set(own) - set(found)):
            raise ValueError(f"{path}: no such settings: {', '.join(odd)}")
        found |= own
    return found


def session(name: str) -> SparkSession:
    """The session of a command line; its master and memory come from spark-submit or spark-defaults."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
