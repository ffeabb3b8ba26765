"""Batch scoring of sequences and the submission table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayforge.functions.names import fresh
from assayforge.functions.sequences import SMILES_PATTERN, pad, tokenize
from assayforge.functions.udfs import batch_scorer
from assayforge.operators.reshape import unpivot_scores
from assayforge.operators.vocabulary import encode_tokens
from assayforge.schemas import ID_MISSING


def score_sequences(df: DataFrame, text: str, vocab: DataFrame, load: Callable, *, max_length: int = 128,
                    batch_size: int = 1024, pattern: str = SMILES_PATTERN, out: str = "scores",
                    on_overflow: str = "error") -> DataFrame:
    """Tokenise, encode, pad and score ``text``; adds the model's output array."""
    parts, number = fresh("_tokens", df, [out]), fresh("_ids", df, [out])
    tokens = df.withColumn(parts, tokenize(F.col(text), pattern))
    ids = encode_tokens(tokens, parts, vocab, number)
    padded = ids.withColumn(number, pad(F.col(number), max_length, on_overflow))
    scorer = batch_scorer(load, batch_size=batch_size, input_length=max_length)
    return padded.withColumn(out, scorer(F.col(number))).drop(parts, number)


def spread_scores(df: DataFrame, scores: str, names: Sequence[str]) -> DataFrame:
    """The score array as one ``<name>_pred`` column each."""
    picked = {f"{name}_pred": F.get(F.col(scores), i) for i, name in enumerate(names)}
    return df.withColumns(picked).drop(scores)


def submission(df: DataFrame, names: Sequence[str], *, limit: int | None = None) -> DataFrame:
    """(id, binds) in id order from rows with an id column and a ``<name>_pred`` column per name.

    Ids that are null or -1, molecules not measured against that name, are left out.
    """
    rows = df if limit is None else df.limit(limit)
    pairs = {name: f"{name}_pred" for name in names}
    return unpivot_scores(rows, pairs, drop_ids=[ID_MISSING]).orderBy("id")
