"""Sources: Parquet, CSV, vocabulary text, in-memory lists. Schemas are given, never inferred."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayforge.operators.skew import lookup_join
from assayforge.schemas import EXTRA_COLUMN_NAMES, EXTRA_COUNTS, RAW_COLUMN_NAMES, VOCABULARY
from assayforge.session import pinned

UNEVEN = 2  # times an even share of the rows that one split of a scan may hold
MOST_READS = 32  # of an uneven scan, each by tasks that keep their share of the rows


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` if it has all columns, else an error naming the absent ones."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return df


def require_paths(spark: SparkSession, *paths: str) -> None:
    """Fails before any job starts when an input does not exist."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    absent = []
    for path in paths:
        hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
        matches = hadoop_path.getFileSystem(conf).globStatus(hadoop_path)
        if matches is None or len(matches) == 0:
            absent.append(path)
    if absent:
        raise FileNotFoundError(f"missing inputs: {', '.join(absent)}")


def read_parquet(spark: SparkSession, *paths: str, schema: T.StructType | None = None,
                 columns: Sequence[str] | None = None) -> DataFrame:
    """One table from a file, a directory or several of them; only ``columns`` are read.

    Columns of ``schema`` or ``columns`` that the files don't have are an error, found before any row
    is read: Spark would read them as nulls.
    """
    require_paths(spark, *paths)
    there = spark.read.option("mergeSchema", "false").parquet(*paths)
    if schema is not None:
        require_columns(there, [n for n in schema.names if columns is None or n in columns])
    df = there if schema is None else spark.read.schema(schema).parquet(*paths)
    return df if columns is None else require_columns(require_columns(there, columns), columns).select(*columns)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, *, columns: Sequence[str] | None = None,
             rename: dict[str, str] | None = None) -> DataFrame:
    """Columns of a CSV file with a header, matched by name and renamed.

    The file may have more columns than the schema: its header says which is which, the wanted ones
    are parsed and cast, and files of one folder must agree on the header.
    """
    require_paths(spark, path)
    header = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    wanted = [f for f in schema.fields if columns is None or f.name in columns]
    require_columns(header, [f.name for f in wanted])
    df = header.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])
    return df.withColumnsRenamed(rename or {})


def read_assays(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Raw long assay rows under the short column names."""
    return read_parquet(spark, path, schema=schema).withColumnsRenamed(RAW_COLUMN_NAMES)


def read_extra_counts(spark: SparkSession, path: str) -> DataFrame:
    """(smiles, binds) of the read-count source."""
    return read_csv(spark, path, EXTRA_COUNTS, rename=EXTRA_COLUMN_NAMES)


def parquet_relation(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    """A SQL relation straight over a Parquet path."""
    clause = f" WHERE {where}" if where else ""
    return spark.sql(f"SELECT * FROM parquet.`{path}`{clause}")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token, token_id) as written by ``write_vocabulary``."""
    return read_parquet(spark, path, schema=VOCABULARY)


def ordered_lines(spark: SparkSession, path: str, wanted: Callable[[Column], Column] | None = None) -> DataFrame:
    """(file, position, value): the lines of text files, numbered from 0 on over all files in the order of their names.

    Only the lines for which ``wanted`` holds are kept and numbered. A file may be cut into many splits, each
    read by its own task: lines are numbered inside their split, whose place is its first byte, and one number
    a split says how many lines come before it. Lines end with LF, CRLF or CR.
    """
    require_paths(spark, path)
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    kept = lines if wanted is None else lines.where(wanted(F.col("value")))
    # A split's lines have numbers in a row, which are written with them.
    placed = pinned(kept.withColumn("at", F.monotonically_increasing_id()))
    splits = placed.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    shifts = splits.select("file", "start", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    return lookup_join(placed, shifts, ["file", "start"], "inner").select(
        "file", (F.col("at") + F.col("shift")).alias("position"), "value")


def import_vocabulary_text(spark: SparkSession, path: str, first_id: int = 2) -> DataFrame:
    """(token, token_id) from text files with a token per line; blank lines take no id.

    Ids go on from file to file, in the order of their names; a file of any size is read by many tasks.
    """
    stripped = lambda line: F.regexp_replace(line, r"^\s+|\s+$", "")
    lines = ordered_lines(spark, path, lambda line: F.length(stripped(line)) > 0)
    return lines.select(stripped(F.col("value")).alias("token"), (F.col("position") + first_id).cast("int").alias("token_id"))


def read_records(spark: SparkSession, path: str, subset: int | None = None) -> DataFrame:
    """Training records; a given ``subset`` reads only that partition's files."""
    require_paths(spark, path)
    df = spark.read.parquet(path).withColumn("subset", F.col("subset").cast("tinyint"))
    return df if subset is None else df.where(F.col("subset") == subset)


def molecules(spark: SparkSession, smiles: Sequence[str]) -> DataFrame:
    """(position, smiles) from a short list held by the caller."""
    return spark.createDataFrame(list(enumerate(smiles)), "position long, smiles string")


def spread_scan(df: DataFrame) -> DataFrame:
    """``df`` spread over all task slots if its scan has fewer splits than slots or uneven ones, else as it is.

    For row-local but heavy work on columns and filters of a table. A split of a file holds the row groups that begin in it, so that
    of files with large row groups some splits have all rows and others none; counting them reads no column. An even scan is left
    alone. Parquet files are read several times over, each reading keeping its share of the rows, so nothing is shuffled or written;
    other sources, and scans that would take more than ``MOST_READS`` readings, are dealt by a shuffle.
    """
    slots, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    held = df.groupBy(F.spark_partition_id().alias("split")).count()
    most, total = held.agg(F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.sum("count"), F.lit(0))).first()
    if splits >= slots and most * slots <= UNEVEN * total:
        return df
    place = _row_places(df)
    reads = math.ceil(most * slots / total) if total else 1
    if place is None or reads > MOST_READS:
        return df.repartition(max(slots, splits))
    return reduce(DataFrame.unionAll, [df.where(F.pmod(F.xxhash64(place), F.lit(reads)) == i) for i in range(reads)])


def _row_places(df: DataFrame) -> Column | None:
    """The number of a row in its file, if ``df`` reads Parquet files."""
    place = F.col("_metadata.row_index")
    try:
        df.select(place).schema  # noqa: B018  (an error where there is no such column)
    except AnalysisException:
        return None
    return None if "_metadata" in df.columns else place


def row_count(df: DataFrame) -> int:
    return df.count()


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` rows."""
    return df.limit(n)
