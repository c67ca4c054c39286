"""Staged tables: lineage is cut by writing Parquet to the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset on a local master, as in tests.

    Elsewhere a local folder would scatter a table's parts over the machines, so an unset folder is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="evigrade-")
        folder = _LOCAL[app]
    return folder.rstrip("/")


def cut(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends there, and a lost executor loses nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_ONCE: dict[tuple[str, str, str], DataFrame] = {}


def once(spark: SparkSession, name: str, source: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` gives, staged once in a session for each name and source, and again where the shared folder was cleared.

    Tables under ``source`` mustn't change meanwhile.
    """
    key = (spark.sparkContext.applicationId, name, source)
    if key not in _ONCE or not all(_is_there(spark, f) for f in _ONCE[key].inputFiles()[:1]):
        _ONCE[key] = cut(make(), name)
    return _ONCE[key]


def _is_there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
