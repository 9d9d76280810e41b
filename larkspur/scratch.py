"""A folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, as in tests, a temporary folder of this process."""
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="larkspur-"))
        place = _own[0]
    return place.rstrip("/")
