"""Shared helpers: written intermediate tables, row numbers, Arrow mapping."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeaudit.session import checkpoint_dir

#: Name of the row number that operators add; it never leaves them.
ROW = "__row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: lineage is
    cut there, so a lost executor costs only re-reads of the written files."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_number(row: str | None = None) -> Column:
    """The column `row`, or else a unique number a row (`__row`), unrelated to
    any column, so null or repeated ids never merge rows.  Write the result
    before using it twice."""
    return (F.col(row) if row else F.monotonically_increasing_id()).alias(ROW)


def rows_of(docs: DataFrame) -> DataFrame:
    """`docs` as structs `d` with row numbers, written: a filter that decides
    on the whole table finds the rows again by their numbers."""
    return written(docs.select(F.struct(*docs.columns).alias("d"), row_number()), "rows")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """`fn` over the Arrow batches of `df`; batches for which it gives None are
    skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = fn(b)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)
