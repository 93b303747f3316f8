"""Small pieces that the corpus operators share: input, shared scratch tables, size-checked joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII blanks that separate words: space and U+0009 to U+000D.
BLANKS = r"[\x20\x09-\x0D]+"
#: Rows up to which a narrow side (ids, hashes) may be broadcast; beyond, Spark shuffles.
BROADCAST_ROWS = 500_000
#: Stands for a missing doc_id where an order is needed; such rows come last.
NO_ID = (1 << 63) - 1

_own_dirs: dict[str, str] = {}
_scratch: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores, dealt to all of them; any other as it is.

    For work that is heavy in each row: a table of a few row groups would keep most cores
    idle. Only for plain scans, whose partitions are known without a job.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode and where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="visitcast-")
    return _own_dirs[context.applicationId]


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, remembered for clear_scratch()."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Deletes what this application has written below the shared folder; returns how many paths.

    For the caller, once the results are stored: they are read from these tables.
    """
    paths = _scratch.pop(spark.sparkContext.applicationId, [])
    for x in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(x)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if a count proves at most `rows` rows, else unmarked (sort-merge join)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def modest_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """From now on the session's Arrow batches hold at most `rows` rows and about `size` bytes.

    Spark's default of 10,000 rows suits numbers; of whole texts, each running task
    would hold tens of MB several times over, beside the executor's heap.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


@contextmanager
def modest(spark: SparkSession, rows: int = 1000, size: str = "8m") -> Iterator[None]:
    """modest_batches() for the actions within; the caller's settings return afterwards."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(n, None) for n in names]
    modest_batches(spark, rows, size)
    try:
        yield
    finally:
        for n, x in zip(names, before, strict=True):
            if x is not None:
                spark.conf.set(n, x)
            else:
                spark.conf.unset(n)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def keyed(docs: DataFrame) -> DataFrame:
    """docs with _k (doc_id, missing ones last) and _t (hash of the text): the key of a row.

    Rows that repeat both are one document to the operators; extra columns pass through.
    """
    return docs.withColumns({"_k": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "_t": F.xxhash64(text_of())})


def without(docs: DataFrame, rejected: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs less the rows whose (_k, _t) stand in `rejected`."""
    bad = small(rejected.select("_k", "_t").distinct(), rows)
    return keyed(docs).join(bad, ["_k", "_t"], "left_anti").select(docs.columns)


def sampled(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """At most `rows` rows: those with the smallest hash of the columns `by`.

    Where there are many more, a bound on the hash that about half as many again
    stay below comes first, so that few rows are sorted, however large the table.
    """
    draw, total = F.pmod(F.xxhash64(*by), F.lit(1 << 40)), df.count()
    if total > 2 * rows:
        df = df.filter(draw < int((1 << 40) * (1.5 * rows + 100) / total))
    return df.orderBy(draw, *by).limit(rows)
