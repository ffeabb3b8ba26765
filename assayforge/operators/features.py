"""Feature vectors: one-hot categories, fingerprints, concatenation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import CountVectorizerModel, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayforge.functions.names import fresh


def one_hot_pipeline(column: str, out: str) -> Pipeline:
    """Category to one-hot vector, a slot per category in alphabetical order; unseen ones raise."""
    index = StringIndexer(inputCol=column, outputCol=f"_{column}_index", stringOrderType="alphabetAsc",
                          handleInvalid="error")
    encoder = OneHotEncoder(inputCol=f"_{column}_index", outputCol=out, dropLast=False)
    return Pipeline(stages=[index, encoder])


def one_hot_columns(df: DataFrame, column: str, categories: Sequence[str], prefix: str) -> DataFrame:
    """The same as 0/1 columns for a known category list; any other value raises."""
    known = F.col(column).isin(list(categories))
    checked = F.when(known, F.col(column)).otherwise(
        F.raise_error(F.concat(F.lit("unknown category: "), F.coalesce(F.col(column), F.lit("null"))))
    )
    flags = {f"{prefix}{c}": F.when(checked == c, 1).otherwise(0) for c in sorted(categories)}
    return df.withColumns(flags)


def add_bits_vector(df: DataFrame, bits: str, n_bits: int, out: str = "fingerprint") -> DataFrame:
    """Adds a sparse 0/1 vector of length ``n_bits`` from the positions of the set bits."""
    names = [str(i) for i in range(n_bits)]
    listed = fresh("_names", df, [out])
    to_vector = CountVectorizerModel.from_vocabulary(names, inputCol=listed, outputCol=out).setBinary(True)
    return to_vector.transform(df.withColumn(listed, F.col(bits).cast("array<string>"))).drop(listed)


def add_array_vector(df: DataFrame, array: str, out: str) -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(array).cast("array<double>")))


def assembler(columns: Sequence[str], out: str = "features") -> VectorAssembler:
    """Stage that puts vectors and numbers side by side in one vector."""
    return VectorAssembler(inputCols=list(columns), outputCol=out)


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return assembler(columns, out).transform(df)
