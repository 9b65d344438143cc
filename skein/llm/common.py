"""What the corpus operators share: inputs, tables in the shared folder, numbered rows and batch sizes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import session
from skein.session import shared_folder

#: Bytes of text handled at a time in a Python worker (one longer text is handled alone).
BLOCK_BYTES = 1 << 20
#: Bytes of an Arrow batch between the JVM and Python, where the session has no size of its own.
BATCH_BYTES = 8 << 20
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the data folder ``sf_dir``, read by Spark only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, tag: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written to the shared folder and read back: lost executors can't undo it, later plans start at it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/skein/{tag}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, tag: str, name: str = "_row") -> DataFrame:
    """``df`` with a column ``name`` that numbers its rows, written, so that every later plan reads the same numbers."""
    return cut(df.withColumn(name, F.monotonically_increasing_id()), tag)


def unused(df: DataFrame, name: str) -> str:
    """A name that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, and keep Arrow batches small.

    Batches of whole texts are held several times over (in the JVM, in the pipe and in Python), so a
    session that has the default size of a batch gets ``BATCH_BYTES``; one that sets its own keeps it.
    """
    if spark.conf.get(BATCH_KEY) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))
    session.ship(spark)
