"""Reading inputs and writing artifacts, all through Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skein.session import shared_folder

#: Extension to format; all others are "other".
FORMATS = ("docx", "doc", "rtf", "txt")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def archive(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """Files below ``root`` with their format and hash; larger ones are listed without content (pruned at the listing)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.withColumn("format", detect_format(F.col("path")))
    if max_bytes is None:
        return files.withColumn("sha256", F.sha2("content", 256)).withColumn("status", F.lit("read"))
    small = files.filter(F.col("length") <= max_bytes).withColumn("sha256", F.sha2("content", 256)).withColumn("status", F.lit("read"))
    large = files.filter(F.col("length") > max_bytes).select("path", "modificationTime", "length", F.lit(None).cast("binary").alias("content"), "format", F.lit(None).cast("string").alias("sha256"), F.lit("too_large").alias("status"))
    return small.unionByName(large)


def detect_format(path: Column) -> Column:
    """The format that the last extension of a path names."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin(*FORMATS), ext).otherwise("other")


def decoded(content: Column) -> Column:
    """Text of bytes: by a UTF-16 or UTF-8 mark, else UTF-8 if valid, else Latin-1. NULs go."""
    head2, head3 = F.hex(F.substring(content, 1, 2)), F.hex(F.substring(content, 1, 3))
    text = (
        F.when(head2.isin("FFFE", "FEFF"), F.decode(content, "UTF-16"))
        .when(head3 == "EFBBBF", F.decode(F.substring(content, 4, F.length(content)), "UTF-8"))
        .when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8"))
        .otherwise(F.decode(content, "ISO-8859-1"))
    )
    return F.replace(text, F.lit("\x00"), F.lit(""))


def new_rows(incoming: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` whose keys aren't in ``present``, one for each key: an idempotent append."""
    return incoming.dropDuplicates(keys).join(present.select(*keys).distinct(), keys, "left_anti")


def jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines with a stated schema; a line that doesn't parse is kept in ``_corrupt``."""
    text = schema if isinstance(schema, str) else ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return spark.read.schema(f"{text}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def csv_last(lines: DataFrame, schema: str, key: str, order: str, defaults: dict[str, str]) -> DataFrame:
    """CSV lines (column ``value``) parsed by ``schema``; rows without the key go, the last row of a key stays."""
    row = F.from_csv("value", schema)
    parsed = lines.select(order, row.alias("r")).select(order, "r.*").filter(F.trim(key) != "")
    for name, value in defaults.items():
        parsed = parsed.withColumn(name, F.when(F.coalesce(F.trim(name), F.lit("")) == "", value).otherwise(F.trim(name)))
    last = Window.partitionBy(key).orderBy(F.desc(order))
    return parsed.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", order)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``_i``, its place from 0 in the order, found without one task that sorts all rows.

    The ranges are written before they are counted: a plan that made them once for the rows and once for
    the counts, where fewer columns are needed, would cut them at other places.
    """
    shared_folder(df.sparkSession)
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_p", F.spark_partition_id()).checkpoint()
    place = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    sizes = place.groupBy("_p").agg(F.max("_k").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return place.join(F.broadcast(before.select("_p", "_before")), "_p").withColumn("_i", F.col("_before") + F.col("_k") - 1).drop("_p", "_k", "_before")


def strided(df: DataFrame, k: int, *order: str) -> DataFrame:
    """``k`` rows at even strides of the order (all, if there are fewer)."""
    if k <= 0:
        raise ValueError("a sample needs a positive size")
    n = df.count()
    if n <= k:
        return df
    at = df.sparkSession.range(k).select(F.floor(F.col("id") * n / k).alias("_i"))
    return numbered(df, *order).join(F.broadcast(at), "_i").drop("_i")


def write_artifact(df: DataFrame, path: str, fmt: str, *order: str) -> None:
    """A report in one file of stable order; reports are small by nature."""
    df.coalesce(1).sortWithinPartitions(*order).write.mode("overwrite").format(fmt).option("header", "true").save(path)
