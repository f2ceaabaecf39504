"""Identities, stable hashes and selection by hash: results that no partitioning changes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def document_id(source: Column, record: Column) -> Column:
    return F.concat(F.lit("doc-"), F.sha2(F.concat(source, F.lit("\x00"), record), 256))


def content_bound(record: Column, text_sha: Column) -> Column:
    """The record id with the content's digest, unless it has it already."""
    tail = F.concat(F.lit("#sha256-"), text_sha)
    return F.when(F.endswith(record, tail), record).otherwise(F.concat(record, tail))


def seeded(seed: str | int, key: Column, between: str = ":") -> Column:
    """sha256 of seed, separator and key, in hexadecimal digits, which sort as the numbers do."""
    return F.sha2(F.concat(F.lit(f"{seed}{between}"), key), 256)


def leading(hex_: Column, digits: int = 16) -> Column:
    """The number of the first hexadecimal digits."""
    return F.conv(F.substring(hex_, 1, digits), 16, 10).cast("decimal(20,0)")


def basis_points(seed: str | int, key: Column) -> Column:
    return (leading(seeded(seed, key)) % 10_000).cast("int")


def below_ratio(hex_: Column, ratio: float) -> Column:
    """Whether a 256-bit hash lies below ratio of its range; a sample at a smaller ratio is part of one at a larger."""
    if ratio >= 1:
        return F.lit(True)
    return hex_ < f"{math.floor(ratio * (1 << 256)):064x}"


def content_sha(text: Column) -> Column:
    return F.sha2(text, 256)


def cluster_id(kind: str, members: Column) -> Column:
    return F.concat(F.lit("cluster-"), F.sha2(F.concat(F.lit(f"{kind}\x00"), F.array_join(F.array_sort(members), "\x00")), 256))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
