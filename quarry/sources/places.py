"""Where queries put files that they read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; a folder of our own only where a local session names none."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", place)
    return f"{place.rstrip('/')}/{name}-{uuid.uuid4().hex}"
