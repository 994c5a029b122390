"""Tables between the stages of a plan, in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once, in the folder that spark.checkpoint.dir names, and a scan of it; a temporary folder if that is unset and all runs on one machine."""
    path = staging_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staging_folder(spark: SparkSession, name: str) -> str:
    """A new folder, not yet made, that executors share; what is in it goes when the session ends."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="waywright-stages-")
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/stage-{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_gone, spark, path)
    return path


def _gone(spark, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended before the interpreter does
        return
