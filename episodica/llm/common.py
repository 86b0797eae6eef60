"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: A word of the contracts: no blank, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a count of the rows (narrow rows only); larger tables are left to shuffled joins."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def held_out(doc_id: Column) -> Column:
    """Fold 0 of 5 by the CRC of the id's text; a row without id is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(4))


def each(column: pa.Array, rows: int = 128) -> Iterator:
    """Values of an Arrow column, a few rows at a time, so that a batch of texts is not held a second time."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()
