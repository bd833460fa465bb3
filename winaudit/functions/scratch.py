"""Tables written to the folder that every executor shares.

Lineage is cut by writing Parquet there and reading it back: a lost executor
then costs a re-read, never a recomputation of what came before. Tables of steps that are
over are discarded; those that a returned frame still reads stay until the folder is cleared.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


#: Where the tables of materialize() stand.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where that is unset on a single machine (tests), a new local one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-winaudit-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/winaudit/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Write df as Parquet in the shared folder, in a folder for each value of `by`, and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete what materialize() wrote for these very frames. No frame still to be run may read them; other frames are left alone."""
    for t in tables:
        path = _PATHS.pop(t, None) if t is not None else None
        if path:
            jvm = t.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
