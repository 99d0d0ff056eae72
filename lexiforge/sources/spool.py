"""Tables written to the folder that driver and executors share, to cut lineage.

A table is written while a DataFrame is being built, so explain() of a query that spools runs jobs. Tables stay until
`free` removes them or the process ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables that have been written, oldest first.
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, one of our own if all runs in this process, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lexiforge-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def free(spark: SparkSession, paths: list[str]) -> None:
    """Remove tables; what was read from them must not be read again."""
    for path in paths:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session may have ended; the folder is scratch space
            pass
        if path in _written:
            _written.remove(path)


@contextmanager
def written() -> Iterator[list[str]]:
    """A list that gets the paths of the tables spooled inside, for `free`."""
    found: list[str] = []
    before = set(_written)
    try:
        yield found
    finally:
        found += [p for p in _written if p not in before]


def spool(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back: what follows repeats nothing above it, and reads the columns it needs."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spool-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(lambda: free(spark, list(_written)))
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
