"""Readers for the Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def canonical_uuid(c: Column) -> Column:
    """One spelling (lower case, hyphens) of a UUID written with any case, braces, urn prefix, blanks or no hyphens; null if it is none."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), r"^[\s{]*(urn:uuid:)?[\s{]*", ""), r"[\s}\-]+", "")
    return F.when(
        bare.rlike(r"\A[0-9a-f]{32}\z"),
        F.concat_ws("-", F.substring(bare, 1, 8), F.substring(bare, 9, 4), F.substring(bare, 13, 4), F.substring(bare, 17, 4), F.substring(bare, 21, 12)),
    )
