"""What the operators of this subpackage share: reading tables, shared storage, text batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

from vidweave.functions.shipping import ship


def prepare(spark: SparkSession) -> None:
    """Sends the package out, and bounds what a Python worker gets at once, by rows and by bytes: long texts
    would make batches of the usual number of rows large."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset and all runs
    in one process on one machine (as in tests), a new local one that is then set as the checkpoint folder. On a
    cluster a local folder would be lost, so there the setting must be given."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='vidweave-')}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written once as Parquet to the shared folder and read back: later steps neither compute
    it again nor depend on the executors that made it."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(sizes: Iterable[int], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges (start, end) over consecutive items, each of at most `most` in total or of one item."""
    start = total = 0
    end = 0
    for end, n in enumerate(sizes):
        if end > start and total + n > most:
            yield start, end
            start, total = end, 0
        total += n
    if start <= end and total >= 0:
        yield start, end + 1
