"""New files in, prepared or scored rows appended once."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from assayforge.functions.names import fresh
from assayforge.functions.sequences import SMILES_PATTERN, replace_linker, tokenize
from assayforge.operators.models import score
from assayforge.operators.vocabulary import encode_tokens


def stream_parquet(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Rows of the Parquet files matching a glob path, in file arrival order; all new files at once by default."""
    reader = spark.readStream.schema(schema)
    return (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).parquet(path)


def stream_csv(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Rows of the CSV files in a directory; the header must follow ``schema``."""
    reader = spark.readStream.schema(schema).option("header", True).option("enforceSchema", False)
    return (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).csv(path)


def append_once(df: DataFrame, output: str, checkpoint: str,
                transform: Callable[[DataFrame], DataFrame] = lambda batch: batch, mode: str = "append") -> StreamingQuery:
    """Processes what is there, writing each micro-batch to its own folder of ``output``.

    The folder is named after the query id, which the checkpoint keeps, and the batch id. It is
    overwritten, so a batch repeated after a failure replaces its first attempt instead of adding rows
    twice, while another query with a checkpoint of its own adds to what is there.
    """
    query_id: list[str] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        if not query_id:
            query_id.append(json.loads(batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0])["id"])
        transform(batch).write.mode("overwrite").parquet(f"{output}/query_id={query_id[0]}/batch_id={batch_id}")

    return (
        df.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def score_stream(df: DataFrame, model: PipelineModel, output: str, checkpoint: str, *,
                 keep: Sequence[str], out: str = "binds") -> StreamingQuery:
    """Appends (keep..., positive-class probability) of every new row."""
    return append_once(df, output, checkpoint, lambda batch: score(batch, model, keep=keep, out=out))


def prepare(df: DataFrame, text: str, vocab: DataFrame, *, pattern: str = SMILES_PATTERN,
            clean: Callable = replace_linker) -> DataFrame:
    """Cleaned text and token ids of every row: row-local, so batch and stream give the same."""
    cleaned = df.withColumn("clean", clean(F.col(text)))
    parts = fresh("_tokens", cleaned)
    return encode_tokens(cleaned.withColumn(parts, tokenize(F.col(text), pattern)), parts, vocab, "ids").drop(parts)


def prepare_stream(df: DataFrame, text: str, vocab: DataFrame, output: str, checkpoint: str, *,
                   pattern: str = SMILES_PATTERN, clean: Callable = replace_linker) -> StreamingQuery:
    return append_once(
        df, output, checkpoint, lambda batch: prepare(batch, text, vocab, pattern=pattern, clean=clean)
    )


def read_appended(spark: SparkSession, output: str) -> DataFrame:
    """Everything written so far."""
    return spark.read.parquet(output).drop("query_id", "batch_id")
