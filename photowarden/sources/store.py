"""Cutting a plan's lineage: narrow intermediate rows as Parquet in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from photowarden.runtime import passing_folder


def materialized(df: DataFrame) -> DataFrame:
    """df, written once and read back: several readers don't compute it again. The table goes when the application ends."""
    path = passing_folder(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
