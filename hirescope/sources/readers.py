"""Readers for the source tables (catalog table or Parquet path)."""

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirescope.sources.schemas import (
    DESCRIPTIONS_RAW,
    KEYWORD_SNAPSHOTS,
    NOISE_TABLE,
    POSTINGS_RAW,
    conform,
)


def read_source(spark: SparkSession, location: str) -> DataFrame:
    """A path (contains ``/``) is read as Parquet, anything else as a catalog table."""
    if "/" in location:
        return spark.read.parquet(location)
    return spark.read.table(location)


def read_postings_raw(spark: SparkSession, location: str) -> DataFrame:
    return conform(read_source(spark, location), POSTINGS_RAW, "postings_raw")


def read_descriptions_raw(spark: SparkSession, location: str) -> DataFrame:
    return conform(read_source(spark, location), DESCRIPTIONS_RAW, "descriptions_raw")


def read_keyword_snapshots(spark: SparkSession, location: str) -> DataFrame:
    return conform(read_source(spark, location), KEYWORD_SNAPSHOTS, "keyword_snapshots")


def read_noise_terms(spark: SparkSession, location: str) -> DataFrame:
    """A noise list kept as a table: one ``keyword`` column, repeats and NULLs allowed."""
    return conform(read_source(spark, location), NOISE_TABLE, "noise_terms")


def newest_partition_date(spark: SparkSession, location: str) -> dt.date | None:
    """The newest ``snapshot_date`` of a table partitioned by it, from the names
    of its partitions.

    Only files are listed, as any scan does; then the newest date must show
    one row (a partition may be empty), or the next one is asked. The NULL
    partition has no date. None if the table is laid out otherwise or empty:
    then the rows have to be read.
    """
    table = read_source(spark, location)
    named = [re.search(r"/snapshot_date=([^/]+)/[^/]*$", f) for f in table.inputFiles()]
    if not all(named):
        return None
    for day in sorted({m[1] for m in named if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", m[1])}, reverse=True):
        day = dt.date.fromisoformat(day)
        if table.where(F.col("snapshot_date") == F.lit(day)).limit(1).count():
            return day
    return None
