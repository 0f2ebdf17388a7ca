"""Tables written to the shared checkpoint folder, so that lost executors cost no recomputation."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import ConfigError

_written: dict[str, tuple[SparkSession, str]] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a local session (one process, as in tests) gets a temporary folder of its
    own; any other raises, as its executors could not read what the driver's machine holds.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        named = sc._jsc.sc().getCheckpointDir()
        named = named.get() if named.isDefined() else None
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ConfigError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        named = tempfile.mkdtemp(prefix="terraweave-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


def staged(df: DataFrame) -> DataFrame:
    """df written as Parquet into the shared folder and read again; cuts the lineage."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/terraweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[path] = (spark, path)
    out._terraweave_path = path
    return out


def drop_staged(*frames: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "_terraweave_path", None)
        if path and _written.pop(path, None):
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _drop_all() -> None:
    for spark, path in list(_written.values()):
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended before this process
            return
