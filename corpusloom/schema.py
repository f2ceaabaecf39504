"""The canonical document row, and the adapter from tables (doc_id, text, lang, source)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import hashing
from corpusloom.functions.text import CONTENT_TYPES

DOCUMENT = T.StructType([
    T.StructField("schema_version", T.IntegerType(), False),
    *(T.StructField(n, T.StringType(), False) for n in ("document_id", "source_id", "source_record_id", "text", "language", "content_type")),
    *(T.StructField(n, T.ArrayType(T.StringType(), False), False) for n in ("privacy_warnings", "quality_warnings")),
    T.StructField("metadata", T.StringType(), False),
])

#: Our own convention for tables that have no content type: by doc_id % 5.
ADAPTED_TYPES = ("general", "encyclopedia", "science", "math", "code")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as canonical documents, with doc_id as input_index."""
    d = table(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*map(F.lit, ADAPTED_TYPES)), (F.col("doc_id") % 5 + 1).cast("int"))
    record = F.col("doc_id").cast("string")
    none = F.array().cast("array<string>")
    return d.select(F.lit(1).alias("schema_version"), hashing.document_id(F.col("source"), record).alias("document_id"), F.col("source").alias("source_id"), record.alias("source_record_id"), "text", F.col("lang").alias("language"), kind.alias("content_type"), none.alias("privacy_warnings"), none.alias("quality_warnings"), F.lit("{}").alias("metadata"), F.col("doc_id").alias("input_index"))


def violations(df: DataFrame) -> DataFrame:
    """(document_id, rule) for each rule of the document contract that a row breaks."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    unique = lambda c: F.coalesce(F.size(c) != F.size(F.array_distinct(c)), F.lit(True))
    rules: dict[str, Column] = {
        "schema_version": F.coalesce(F.col("schema_version") != 1, F.lit(True)),
        "document_id": F.coalesce(F.col("document_id") != hashing.document_id(F.col("source_id"), F.col("source_record_id")), F.lit(True)),
        "source_id": F.coalesce(~F.col("source_id").rlike(r"^[a-z0-9][a-z0-9-]*$"), F.lit(True)),
        "source_record_id": blank(F.col("source_record_id")),
        "text": blank(F.col("text")),
        "language": blank(F.col("language")),
        "content_type": F.coalesce(~F.col("content_type").isin(*CONTENT_TYPES), F.lit(True)),
        "privacy_warnings": unique(F.col("privacy_warnings")),
        "quality_warnings": unique(F.col("quality_warnings")),
    }
    broken = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in rules.items())))
    return df.select("document_id", F.explode(broken).alias("rule"))


def json_line(df: DataFrame) -> DataFrame:
    """(value): canonical JSON lines, keys in order, nulls kept."""
    names = sorted(f.name for f in DOCUMENT)
    return df.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value"))


def rekeyed(df: DataFrame) -> DataFrame:
    """Documents with ids bound to their contents, and changed: whether the id is a new one."""
    record = hashing.content_bound(F.col("source_record_id"), hashing.content_sha(F.col("text")))
    out = df.withColumn("_old", F.col("document_id")).withColumn("source_record_id", record)
    return out.withColumn("document_id", hashing.document_id(F.col("source_id"), F.col("source_record_id"))).withColumn("changed", F.col("document_id") != F.col("_old")).drop("_old")
