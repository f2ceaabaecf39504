"""Sources: strict JSON lines, Parquet with field mappings, file inventories, archives, generated tables."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import hashing
from corpusloom.functions.text import stripped
from corpusloom.schema import DOCUMENT


@dataclass(frozen=True)
class Source:
    """How rows of one source are read and accepted."""

    source_id: str
    language: str
    content_type: str
    text_field: str = "text"
    id_field: str | None = None
    min_chars: int = 1
    max_chars: int = 1_000_000
    score_field: str | None = None
    min_score: float | None = None
    excluded_flags: tuple[str, ...] = field(default=())


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Canonical JSON lines; a malformed line fails the read."""
    return spark.read.schema(DOCUMENT).option("mode", "FAILFAST").json(path)


def read_files(spark: SparkSession, path: str, form: str = "parquet", glob: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Parquet or JSON files, pruned to columns."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    df = reader.format(form).load(path)
    return df.select(*columns) if columns else df


def read_values(spark: SparkSession, path: str, schema: str, whole: bool = False) -> DataFrame:
    """JSON lines, or whole files that hold an array."""
    return spark.read.schema(schema).option("multiLine", whole).json(path)


def accepted(df: DataFrame, source: Source) -> DataFrame:
    """df with `accepted_text`, and only rows that a source takes: text within bounds once stripped, no excluded flag set, score high enough.

    A null or malformed score rejects. Built-in tests come in the order of their cost.
    """
    text = stripped(F.col(source.text_field))
    out = df.where(F.col(source.text_field).isNotNull())
    for flag in source.excluded_flags:
        out = out.where(~F.coalesce(F.col(flag), F.lit(False)))
    if source.score_field:
        out = out.where(F.coalesce(F.col(source.score_field).try_cast("double") >= source.min_score, F.lit(False)))
    return out.withColumn("accepted_text", text).where(F.length("accepted_text").between(max(1, source.min_chars), source.max_chars))


def to_documents(df: DataFrame, source: Source, position: Column | None = None) -> DataFrame:
    """Rows of a source as canonical documents; without an id field the record is named by its position in a stable order."""
    own = F.col(source.id_field).cast("string") if source.id_field else F.format_string("position-%09d", position)
    record = F.concat(F.lit(f"{source.source_id}:"), own)
    none = F.array().cast("array<string>")
    rows = df.select(F.lit(1).alias("schema_version"), hashing.document_id(F.lit(source.source_id), record).alias("document_id"), F.lit(source.source_id).alias("source_id"), record.alias("source_record_id"), F.col(source.text_field).alias("text"), F.lit(source.language).alias("language"), F.lit(source.content_type).alias("content_type"), none.alias("privacy_warnings"), none.alias("quality_warnings"), F.lit("{}").alias("metadata"))
    return rows.where((F.trim("text") != "") & own.isNotNull()) if source.id_field else rows.where(F.trim("text") != "")


def inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, size, sha256) of files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def unmatched_files(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected (path, sha256) that no file has."""
    return expected.join(actual, ["path", "sha256"], "left_anti")


def read_archived_json(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """(archive, member, value): JSON values in tar archives, one row each; lists give a row an element."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in parts:
            rows = []
            for name, content in zip(files["path"], files["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for member in sorted((m for m in tar if m.isfile() and m.name.endswith(suffix)), key=lambda m: m.name):
                        loaded = json.loads(tar.extractfile(member).read())
                        rows += [(name, member.name, json.dumps(v, ensure_ascii=False)) for v in (loaded if isinstance(loaded, list) else [loaded])]
            yield pd.DataFrame(rows, columns=["archive", "member", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, value string")


def first_accepted(df: DataFrame, source_col: str, order: list[str], test: Column, most: int) -> DataFrame:
    """(source, position): the first accepted row among the first `most` of each source."""
    rows = df.withColumn("position", F.row_number().over(Window.partitionBy(source_col).orderBy(*order)))
    return rows.where(F.col("position") <= most).groupBy(source_col).agg(F.min(F.when(test, F.col("position"))).alias("position"))


def translated_pair(row_instruction: Column, row_input: Column, row_output: Column, translated: tuple[Column, Column, Column]) -> tuple[Column, Column]:
    """(question, answer): translated fields where they are not empty, instruction and input joined by a blank line."""
    pick = lambda t, o: F.coalesce(F.nullif(F.trim(t), F.lit("")), F.trim(o))
    question = F.concat_ws("\n\n", F.nullif(pick(translated[0], row_instruction), F.lit("")), F.nullif(pick(translated[1], row_input), F.lit("")))
    return question, pick(translated[2], row_output)
