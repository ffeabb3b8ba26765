"""Named queries over a folder of tables, each next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assayforge.sources.readers import spread_scan

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function name."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table, dealt over all slots when its files are too few to keep them busy."""
    return spread_scan(table(spark, folder, name).select(*columns))


# SQL fragments used by several queries.

def sql_hash(*keys: str, seed: int | str) -> str:
    """md5 of the '|'-joined keys and the seed."""
    return f"md5({' || '.join(f'{k}::VARCHAR || chr(124)' for k in keys)} || '{seed}')"


def sql_uniform(digest: str, word: int = 0) -> str:
    return f"(('0x' || substr({digest}, {8 * word + 1}, 8))::BIGINT / 4294967296::DOUBLE)"


def sql_uint32(text: str, word: int = 0) -> str:
    return f"(('0x' || substr(md5({text}), {8 * word + 1}, 8))::BIGINT)"


def sql_clip(value: str, low: float, high: float) -> str:
    return f"least(greatest({value}, {low}::DOUBLE), {high}::DOUBLE)"


def sql_focal(p: str) -> str:
    return f"(-pow(1 - {p}, 2) * ln({p}))"
