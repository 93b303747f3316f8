"""Tables that several queries share, written once in the folder that all executors see."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_known: dict[tuple[str, str], dict[str, str]] = {}


def folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode and where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="visitcast-")
    return _own[context.applicationId]


def once(spark: SparkSession, key: str, make: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The tables that `make` returns, as Parquet; made at the first call of an application with this key, read again later.

    For results that cost a fit: `key` has to name all that they depend on, and the tables that they are
    made from are taken not to change while the application lives (forget() otherwise).
    """
    at = (spark.sparkContext.applicationId, key)
    if at not in _known:
        paths = {}
        for name, df in make().items():
            paths[name] = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
            df.write.parquet(paths[name])
        _known[at] = paths
    return {name: spark.read.parquet(path) for name, path in _known[at].items()}


def forget(spark: SparkSession) -> None:
    """Makes once() start anew; the tables stay where they are."""
    for at in [x for x in _known if x[0] == spark.sparkContext.applicationId]:
        del _known[at]
