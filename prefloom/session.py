"""Session settings and the shared scratch folder."""

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app_name="prefloom", master=None, shuffle_partitions=None, **conf):
    """A session with the settings the operators are written for.

    On a cluster leave `master` to spark-submit. Partition counts are left to adaptive
    execution, which merges small shuffle partitions and splits skewed ones; give
    `shuffle_partitions` as the upper bound (cores x 2-4 on a cluster).
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **{key: str(value) for key, value in conf.items()},
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_folder(spark):
    """A fresh path below the shared folder named by spark.checkpoint.dir.

    Only a local-mode session without that setting gets a temporary folder: on a cluster a
    machine-local folder would be lost with its executor.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = os.path.join(tempfile.gettempdir(), "prefloom-scratch")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"
