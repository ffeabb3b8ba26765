"""CSV that arriving rows are appended to: one header, each batch once.

A folder holds ``data/000-header`` with the header line alone, ``data/<query>-<batch>`` with the lines of each
micro-batch, and ``commits``, one record a batch, written when its lines are there. All files below ``data`` in the
order of their names are one CSV file; a reader takes the batches that are committed, so that an attempt that
broke off is not seen and a repeated one, which replaces the first, is seen once.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

# Quotes are doubled, as other CSV readers expect, and blanks at the ends of a text stay.
FORMAT = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
COMMIT = "query_id string, batch_id long, folder string, n_rows long"


def write_batch(df: DataFrame, output: str, query_id: str, batch_id: int) -> None:
    """Writes the lines of one batch, then its commit. The same batch again replaces both."""
    spark = df.sparkSession
    if batch_id == 0:  # the same line each time
        header = spark.createDataFrame([], df.schema).coalesce(1)
        header.write.mode("overwrite").options(**FORMAT).option("header", True).csv(f"{output}/data/000-header")
    folder = f"{query_id}-{batch_id:010d}"
    df.write.mode("overwrite").options(**FORMAT).option("header", False).csv(f"{output}/data/{folder}")
    # Counted in the files; an observation of the rows would leave the session with an object that fitted models,
    # which hold their session, can't be sent to tasks with.
    rows = spark.read.schema(df.schema).options(**FORMAT).option("multiLine", True).csv(f"{output}/data/{folder}").count()
    commit = spark.createDataFrame([(query_id, batch_id, folder, rows)], COMMIT)
    commit.coalesce(1).write.mode("overwrite").json(f"{output}/commits/{folder}")


def append_csv(df: DataFrame, output: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Appends what ``transform`` makes of every micro-batch, and ends when nothing new is there."""
    query_id: list[str] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        if not query_id:  # the checkpoint keeps it
            query_id.append(json.loads(batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0])["id"])
        write_batch(transform(batch), output, query_id[0], batch_id)

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def commits(spark: SparkSession, output: str) -> DataFrame:
    """(query_id, batch_id, folder, n_rows) of the batches that are there in full; none before the first."""
    try:
        return spark.read.schema(COMMIT).option("recursiveFileLookup", True).json(f"{output}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT)


def read_csv_log(spark: SparkSession, output: str, schema: T.StructType, *, multiline: bool = False) -> DataFrame:
    """All committed rows; an empty text comes back as null, as Spark's CSV has it.

    ``multiline`` where text holds line ends; such files are read whole, each by one task.
    """
    folders = [r["folder"] for r in commits(spark, output).select("folder").collect()]  # one a batch
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).options(**FORMAT).option("multiLine", multiline).csv([f"{output}/data/{f}" for f in folders])


def check_log(spark: SparkSession, output: str, schema: T.StructType, *, multiline: bool = False) -> DataFrame:
    """(query_id, batch_id, n_rows, found): batches whose files have another number of rows than was committed."""
    rows = read_csv_log(spark, output, schema, multiline=multiline).select(
        F.regexp_extract("_metadata.file_path", "/data/([^/]+)/", 1).alias("folder"))
    counted = rows.groupBy("folder").agg(F.count("*").alias("found"))
    both = commits(spark, output).join(counted, "folder", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return both.where("found <> n_rows").select("query_id", "batch_id", "n_rows", "found")
