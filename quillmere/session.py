"""The session of the bench and the tests; a cluster's own session does as well."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder that the cluster names in spark.checkpoint.dir. Where it is unset, in a folder of this process,
    which only a local master may use: executors of other machines would not see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="quillmere-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        root = f"file://{root}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/quillmere/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once to a scratch path and read from there: what it took to make it isn't done again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def session(cpus: int | str = "*", **conf: str) -> SparkSession:
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.environ["PYTHONPATH"] = os.pathsep.join([root, *filter(None, [os.environ.get("PYTHONPATH")])])
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("quillmere")
    defaults = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.driver.memory": "8g",
    }
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
