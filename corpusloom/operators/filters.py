"""Filters of a fixed size, which spare most rows without a partner the way to a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The filter's bits (a power of two); they are broadcast as at most a 64th as many rows of 16 bytes.
BITS = 1 << 26


def maybe_among(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key may be in keys, and a few others: for an exact join that follows. key: a column of both, a 64-bit hash.

    A hash sets one bit. So of n keys at most n / BITS of the other rows pass, and the broadcast is as large for any n.
    """
    at = F.col(key).bitwiseAND(F.lit(BITS - 1))
    word, bit = F.shiftright(at, 6).alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    words = keys.select(word, bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    held = rows.select("*", word, bit.alias("_bit")).join(F.broadcast(words), "_word")
    return held.where(F.col("_bits").bitwiseAND(F.col("_bit")) != 0).select(*rows.columns)


def parted(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(some, rest): the rows whose key may be in keys, few others among them, and all other rows, null keys included.

    For joins of large rows of which few have a partner: only some has to be shuffled. key: a 64-bit hash; keys has
    these in its only column. The filter is that of maybe_among(); columns of rows may have any names.
    """
    word, bits = "_word", "_bits"
    while {word, bits} & {c.lower() for c in rows.columns}:
        word, bits = word + "_", bits + "_"

    def placed(k: Column) -> tuple[Column, Column]:
        at = k.bitwiseAND(F.lit(BITS - 1))
        return F.shiftright(at, 6), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))

    (own_word, own_bit), (key_word, key_bit) = placed(key), placed(F.col(keys.columns[0]))
    words = keys.groupBy(key_word.alias(word)).agg(F.bit_or(key_bit).alias(bits))
    held = rows.withColumn(word, own_word).join(F.broadcast(words), word, "left")
    among = F.coalesce(F.col(bits).bitwiseAND(own_bit) != 0, F.lit(False))
    own = [F.col(f"`{c}`") for c in rows.columns]
    return held.where(among).select(*own), held.where(~among).select(*own)
