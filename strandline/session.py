"""Session settings the operators rely on, and the shared folder for written steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Re-planning at run time: merges small shuffle partitions, splits skewed join
# partitions (even where that costs one more shuffle), and turns a sort-merge join
# into a broadcast join once the measured size of a side is under the threshold.
# Groups here are persons, far more than the small first map of an aggregate holds:
# without that map, grouping 24 million events by person takes half the time.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.codegen.aggregate.map.twolevel.enabled": "false",
}


def tune(spark: SparkSession) -> SparkSession:
    """Turn on adaptive execution and plain aggregate maps; sizes (partitions, thresholds) stay the cluster's."""
    for key, value in ADAPTIVE.items():
        spark.conf.set(key, value)
    return spark


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir`` for a table written mid-way.

    A machine-local folder is used only on a local master with the setting unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="strandline-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
