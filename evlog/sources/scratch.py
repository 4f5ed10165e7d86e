"""Folders for intermediate files: shared by driver and executors, and removed when the process ends."""

from __future__ import annotations

import atexit
import contextlib
import logging
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOG = logging.getLogger(__name__)
_own: str | None = None
#: The folders of this process. Results are lazy, so what they read stays until the process ends, or clean() is called.
_made: dict[str, SparkSession] = {}


def folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Where it is unset: a folder of this machine, removed at exit, if the executors are on
    this machine too, as in tests; elsewhere that is an error, as no one else would see the files."""
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="evlog-work-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
        _LOG.info("spark.checkpoint.dir is unset: intermediate files are in %s", _own)
    return f"file://{_own}"


def new(spark: SparkSession, name: str) -> str:
    """The path of a folder of one's own, which is removed with the others."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder, and forget it if it is one of new()'s."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _made.pop(path, None)


def clean() -> int:
    """Remove this process's folders, once no result that reads them is wanted any more; how many there were. Done at exit too,
    where the session is still there."""
    n = len(_made)
    for path, spark in list(_made.items()):
        with contextlib.suppress(Exception):  # a session that has ended
            if not spark.sparkContext._jsc.sc().isStopped():
                delete(spark, path)
        _made.pop(path, None)
    return n


atexit.register(clean)
