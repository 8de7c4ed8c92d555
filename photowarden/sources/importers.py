"""Import of exported analyses: JSON documents in four shapes, NDJSON, and the store of the last analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photowarden.sources import documents

LAST = "last_analysis"


def read_json_document(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Rows of a JSON file that is a list of rows, {"analysis": rows}, {"data": rows} or one row; a damaged file ends the
    read. With a schema files of any size are read by many tasks; without one it is inferred from whole files."""
    if schema is not None:
        return documents.read_rows(spark, path, schema)
    df = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
    for name in ("analysis", "data"):
        if name in df.columns and isinstance(df.schema[name].dataType, T.ArrayType):
            return df.select(F.inline(name))
    return df


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of documents {"analysis": rows} that stand one after the other in files, pretty or not, as `sinks.write_json` has
    them: a document begins at a line that is "{" or begins with it and ends before the next such line."""
    text = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\n(?=\{)")).alias("value"))
    return text.select(F.inline(F.from_json("value", T.StructType([T.StructField("analysis", T.ArrayType(schema))]))["analysis"]))


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One row a line; blank lines are skipped and a bad line fails the read."""
    if schema is None:
        return spark.read.option("mode", "FAILFAST").json(path)
    lines = spark.read.text(path).select(F.rtrim(F.regexp_replace("value", "\r$", "")).alias("value")).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def save_last(df: DataFrame, name: str = LAST) -> None:
    df.write.mode("overwrite").saveAsTable(name)


def load_last(spark: SparkSession, name: str = LAST) -> DataFrame:
    return spark.table(name)


def clear_last(spark: SparkSession, name: str = LAST) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
