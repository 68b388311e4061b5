"""Tables written to the folder that the driver and all executors share.

They live as long as the driver needs them: `release` drops them early, and what is left
goes when the driver ends.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []
#: By application: the folder of a local session that names none.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as a full URI; only a local session without it, as in tests, gets a folder of its own."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = tempfile.mkdtemp(prefix="gaugeworks-")
        found = f"file://{_own[context.applicationId]}"
    return qualified(spark, found)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme and host by which Spark takes it, so that other readers take it alike."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
    return f"file://{full.removeprefix('file:')}" if re.match("file:/[^/]", full) else full


def for_workers(path: str) -> str:
    """A full URI as Python workers open it; an error, on the driver, if they can't."""
    path = re.sub("^s3[an]://", "s3://", path)
    try:
        pafs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, OSError) as e:
        raise ValueError(f"Python workers can't reach {path}; name a folder in spark.checkpoint.dir that they can ({e})") from e
    return path


def shared_path(spark: SparkSession, label: str) -> str:
    """A new name in the shared folder, to be dropped with the others."""
    if not _made:
        atexit.register(_at_exit)
    _made.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _made[-1]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in time for `release`."""
    return len(_made)


def release(spark: SparkSession, since: int = 0, keep: str | None = None) -> None:
    """Drops what was written since a mark, but for one path. Frames that read it can't be used any more."""
    gone = [p for p in _made[since:] if p != keep]
    _made[since:] = [p for p in _made[since:] if p == keep]
    hadoop = spark._jsc.hadoopConfiguration()
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(hadoop).delete(at, True)


def _at_exit() -> None:
    if (spark := SparkSession.getActiveSession()) is not None:
        with contextlib.suppress(Exception):  # the engine may be gone already
            release(spark)
