"""Where intermediate results that several plans read are kept.

A staged table is a Parquet table in the folder all executors share, so a lost executor never loses it and its lineage is cut.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_STAGED: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, one of this process (single-node use and tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="quillspark-")
        atexit.register(shutil.rmtree, _OWN["dir"], True)
    return _OWN["dir"]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and returns a scan of it. Removed when the process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _STAGED:
        atexit.register(clear)
    _STAGED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def discard_at_exit(spark: SparkSession, path: str) -> str:
    """Marks a folder, of an index built for one query, for removal when the process ends."""
    if not _STAGED:
        atexit.register(clear)
    _STAGED.append((spark, path))
    return path


def clear() -> None:
    """Deletes every staged table of this process."""
    while _STAGED:
        spark, path = _STAGED.pop()
        try:
            if "://" in path or path.startswith("file:"):
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            else:
                shutil.rmtree(Path(path), ignore_errors=True)
        except Exception:  # the session may be gone at exit; the folder then belongs to the cluster's own cleaning
            pass
