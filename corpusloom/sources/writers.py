"""Sinks. Spark's commit protocol makes each write atomic; _SUCCESS marks a complete one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.schema import json_line
from corpusloom.operators.gates import manifest


def write_documents(df: DataFrame, path: str, per_file: int = 100_000) -> None:
    """Canonical JSON lines, at most per_file a file."""
    json_line(df).write.option("maxRecordsPerFile", per_file).mode("overwrite").text(path)


def write_splits(df: DataFrame, path: str) -> None:
    df.write.partitionBy("split").mode("overwrite").parquet(path)


def shard_numbers(df: DataFrame, order: list[str], per_shard: int, by: list[str]) -> DataFrame:
    """df with the shard of each row: so many rows a shard, in order."""
    return df.withColumn("shard", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / per_shard))


def token_bytes(df: DataFrame, tokens: str, shard: str, order: str, width: int = 2) -> DataFrame:
    """(shard, tokens binary, index binary): little-endian ids of width bytes (2 or 4), and 64-bit (offset, count) pairs of the documents in a shard.

    An id that doesn't fit the width is an error. Shards have a fixed capacity, which bounds a group's size.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        arrays = [np.asarray(x, np.int64) for x in rows[tokens]]
        if any(len(a) and (a.min() < 0 or a.max() >= 256**width) for a in arrays):
            raise ValueError(f"shard {rows[shard].iloc[0]} holds ids that do not fit {width} bytes")
        counts = np.array([len(a) for a in arrays], np.uint64)
        index = np.stack([np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.uint64), counts], axis=1)
        return pd.DataFrame({"shard": [rows[shard].iloc[0]], "tokens": [np.concatenate(arrays).astype(f"<u{width}").tobytes()], "index": [index.astype("<u8").tobytes()]})

    kind = dict(df.dtypes)[shard]
    return df.groupBy(shard).applyInPandas(run, f"shard {kind}, tokens binary, index binary")


def read_token_bytes(df: DataFrame, width: int = 2) -> DataFrame:
    """(shard, document, tokens) of what token_bytes() packed with that width."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            out = []
            for shard, data, index in zip(rows["shard"], rows["tokens"], rows["index"], strict=True):
                ids = np.frombuffer(data, f"<u{width}")
                out += [(shard, k, ids[int(a) : int(a + n)].astype(np.int64)) for k, (a, n) in enumerate(np.frombuffer(index, "<u8").reshape(-1, 2))]
            yield pd.DataFrame(out, columns=["shard", "document", "tokens"])

    kind = dict(df.dtypes)["shard"]
    return df.mapInPandas(run, f"shard {kind}, document int, tokens array<bigint>")


def write_manifest(df: DataFrame, source: str, path: str) -> None:
    manifest(df, source).coalesce(1).write.mode("overwrite").json(path)


def markdown(rows: DataFrame, most: int = 200) -> str:
    """A table of a small report; at most `most` rows are read."""
    names = rows.columns
    lines = ["| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]
    return "\n".join(lines + ["| " + " | ".join(str(r[n]) for n in names) + " |" for r in rows.limit(most).collect()])
