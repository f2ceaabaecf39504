"""Exact and near duplicates of documents."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import hashing
from corpusloom.functions.text import estimated_tokens, length_bucket  # noqa: F401
from corpusloom.operators.filters import maybe_among
from corpusloom.operators.graph import connected
from corpusloom.storage import discard, released, stored

# Fixed values of the fingerprints.
SHINGLE_CHARS = 24
ROLLING_BASE = 1_000_003
SAMPLE_BITS = 4
BANDS, BAND_BITS = 8, 8
LENGTH_RATIO = 0.90
JACCARD = 0.90
#: Documents of one shingle beyond which they must also be near in length to meet, and beyond which they must share a band instead.
CROWD, MASS = 64, 4096
#: Shingles before a common one that are looked at for an earlier one.
LEAD = 4
#: Fixed masks of the probes: half of the 64 bits each.
PROBE_MASKS = ("3ea3a67ae90b184b", "af8393415d4c27d3", "995aa968afc6a49a", "e2c767a29ddac904", "da4f25c4e33c1e0b", "f18e22a8ba71a9e6", "3e6110d87b5983e7", "b8656164d64fd558")
HAMMING = 3


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order."""
    own = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(own)).where("_place = 1").drop("_place")


def _sha(text_col: str, sha_col: str | None) -> Column:
    return (hashing.content_sha(F.col(text_col)) if sha_col is None else F.col(sha_col)).alias("text_sha256")


def exact_clusters(df: DataFrame, id_col: str = "document_id", text_col: str = "text", index_col: str = "input_index", sha_col: str | None = None) -> DataFrame:
    """(text_sha256, representative, members, n): texts that two documents or more share; members by index, the earliest one represents. sha_col: where df has the texts' hashes in place of the texts."""
    rows = df.select(F.col(id_col).alias("id"), _sha(text_col, sha_col), F.col(index_col).alias("i"))
    groups = rows.groupBy("text_sha256").agg(F.min_by("id", "i").alias("representative"), F.array_sort(F.collect_list(F.struct("i", "id"))).alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return groups.select("text_sha256", "representative", F.transform("m", lambda x: x["id"]).alias("members"), "n")


def exact_representatives(df: DataFrame, rule: str = "earliest", id_col: str = "document_id", text_col: str = "text", index_col: str = "input_index", sha_col: str | None = None) -> DataFrame:
    """(text_sha256, document_id): one document a text, the earliest by index or the one of the least id. A map-side minimum, no self-join. sha_col: see exact_clusters()."""
    sha = _sha(text_col, sha_col)
    pick = F.min(F.struct(index_col, id_col))[id_col] if rule == "earliest" else F.min(id_col)
    return df.groupBy(sha).agg(pick.alias("document_id"))


def first_wins(df: DataFrame, order: list[str], text: Column, scope: list[str] | None = None) -> DataFrame:
    """Rows whose stripped text no earlier row of the same scope has."""
    rows = df.withColumn("digest", hashing.content_sha(text))
    return first_rows(rows, [*(scope or []), "digest"], order)


def shingles_of(text: str, person: bytes = b"corpusloom") -> np.ndarray:
    """Sampled 24-character rolling hashes of a text without white space, ascending; a keyed hash of all of it if it is short or none is sampled."""
    compact = "".join(text.split())
    codes = np.array([ord(c) for c in compact], np.uint64)
    n = len(codes) - SHINGLE_CHARS + 1
    if n > 1:
        powers = np.array([pow(ROLLING_BASE, SHINGLE_CHARS - 1 - k, 1 << 64) for k in range(SHINGLE_CHARS)], np.uint64)
        windows = np.zeros(n, np.uint64)
        for k in range(SHINGLE_CHARS):
            windows += codes[k : k + n] * powers[k]
        found = np.unique(windows[windows & np.uint64((1 << SAMPLE_BITS) - 1) == 0])
        if len(found):
            return found
    whole = hashlib.blake2b(compact.encode("utf-8", "surrogatepass"), digest_size=8, person=person[:16]).digest()
    return np.array([int.from_bytes(whole, "big")], np.uint64)


def simhash_of(values: np.ndarray) -> int:
    """One bit for each of 64 places: whether at least half of the values have it."""
    ones = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0)
    return int("".join("1" if 2 * x >= len(values) else "0" for x in ones), 2)


_PRINT = T.StructType([T.StructField("shingles", T.ArrayType(T.LongType())), T.StructField("simhash", T.LongType())])


@F.pandas_udf(_PRINT)
def fingerprint(text: pd.Series) -> pd.DataFrame:
    """The sampled shingles and the simhash, as bit patterns of signed numbers. Null texts count as empty."""
    sets = [shingles_of(x or "") for x in text]
    return pd.DataFrame({"shingles": [s.view(np.int64) for s in sets], "simhash": [int(np.uint64(simhash_of(s)).view(np.int64)) for s in sets]})


def fingerprints(df: DataFrame, id_col: str = "document_id", text_col: str = "text", keep: tuple[str, ...] = ("input_index",)) -> DataFrame:
    return df.select(F.col(id_col).alias("document_id"), *keep, F.length(text_col).alias("chars"), fingerprint(F.col(text_col)).alias("f")).select("document_id", *keep, "chars", "f.shingles", "f.simhash")


def band_pairs(prints: DataFrame, length_ratio: float = LENGTH_RATIO) -> DataFrame:
    """(a, b): documents that share a band of their simhashes and are near in length; the lengths are tested before any set is moved.

    Bands of eight bits are coarse, so a band's bucket grows with the corpus: near_pairs() finds its pairs by shingles.
    """
    bands = F.array(*(F.shiftrightunsigned("simhash", BAND_BITS * k).bitwiseAND(F.lit((1 << BAND_BITS) - 1)) for k in range(BANDS)))
    rows = prints.select("document_id", "chars", F.posexplode(bands).alias("band", "value"))
    a, b = (rows.select("band", "value", F.col("document_id").alias(x), F.col("chars").alias(f"n_{x}")) for x in "ab")
    near = F.least("n_a", "n_b") >= length_ratio * F.greatest("n_a", "n_b")
    return a.join(b, ["band", "value"]).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; two empty ones have 1."""
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(a) + F.size(b) - both
    return F.when(all_ == 0, F.lit(1.0)).otherwise(both / all_)


def _band(k: int) -> Column:
    return F.shiftrightunsigned("simhash", BAND_BITS * k).bitwiseAND(F.lit((1 << BAND_BITS) - 1))


@F.pandas_udf(T.ArrayType(T.LongType()))
def _bitmap(sets: pd.Series) -> pd.Series:
    """1,024 bits of a set, one or less for each value."""

    def one(values: np.ndarray) -> np.ndarray:
        bits = np.zeros(1024, bool)
        bits[np.asarray(values, np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(54)] = True
        return np.packbits(bits).view(np.int64)

    return sets.map(one)


def _ones(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0), lambda total, x: total + F.bit_count(x))


def near_pairs(prints: DataFrame, threshold: float = JACCARD, length_ratio: float = LENGTH_RATIO) -> DataFrame:
    """(a, b, similarity): the pairs of band_pairs() whose shingle sets are as similar as asked, which is more than not at all.

    Sets as similar as that share one of the first n - threshold * n + 1 of their n shingles (in the order of the
    shingles), so documents meet by these and are then tested for bands and lengths; those of a shingle that many have
    meet by it and a class of length or, if very many have it, a band. A pair is left out where an earlier shingle is
    seen to bring it. Bitmaps bound what two sets can share; sets are moved only for the pairs that this leaves.
    Documents are told apart by 64-bit hashes until their sets are compared.
    """
    if threshold <= 0:
        raise ValueError("threshold must be above 0")
    spark = prints.sparkSession
    released(spark)
    node = F.xxhash64("document_id").alias("node")
    sets = F.when(F.size("shingles") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.col("shingles"))
    rows = prints.select(node, "chars", "simhash", sets.alias("own")).withColumn("n", F.size("own"))
    first = F.slice("own", F.lit(1), (F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1).cast("int"))
    each = rows.select("node", "chars", "simhash", "n", F.slice("own", 1, LEAD).alias("lead"), F.posexplode(first).alias("at", "key"))
    shared = stored(each.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "keys")
    released(spark)
    bands = F.array(*(F.xxhash64("key", F.lit(k), _band(k)) for k in range(BANDS)))
    held = maybe_among(each, "key", shared).withColumn("earlier", F.slice("lead", F.lit(1), F.least("at", F.lit(LEAD)))).drop("lead", "at").join(shared, "key")
    # classes a little wider than the ratio of two lengths that are near, each document in its own and the next
    length = F.floor(F.log(F.greatest("chars", F.lit(1))) / (1.001 * max(1e-3, -math.log(max(length_ratio, 1e-9)))))
    classes = F.array(*(F.xxhash64("key", length + k) for k in range(2)))
    keys = F.when(F.col("df") <= CROWD, F.array("key")).when(F.col("df") <= MASS, classes).otherwise(bands)
    held = stored(held.select("node", "chars", "simhash", "n", "earlier", F.explode(keys).alias("key")), "entries")
    released(spark)
    discard(shared)
    a, b = (held.select("key", *(F.col(c).alias(f"{c}_{x}") for c in held.columns if c != "key")) for x in "ab")
    alike = lambda c, ratio: F.least(f"{c}_a", f"{c}_b") >= ratio * F.greatest(f"{c}_a", f"{c}_b") - 1e-9
    long_enough = F.least("chars_a", "chars_b") >= length_ratio * F.greatest("chars_a", "chars_b")
    differ = F.col("simhash_a").bitwiseXOR(F.col("simhash_b"))
    one_band = F.lit(False)
    for k in range(BANDS):
        one_band |= F.shiftrightunsigned(differ, BAND_BITS * k).bitwiseAND(F.lit((1 << BAND_BITS) - 1)) == 0
    met = a.join(b, "key").where((F.col("node_a") < F.col("node_b")) & long_enough & alike("n", threshold) & one_band & ~F.arrays_overlap("earlier_a", "earlier_b"))
    pairs = stored(met.select("node_a", "node_b").distinct(), "pairs")
    discard(held)
    nodes = pairs.select(F.col("node_a").alias("node")).union(pairs.select("node_b"))
    full = stored(maybe_among(prints.select(node, "document_id", "shingles"), "node", nodes).withColumn("bits", _bitmap("shingles")), "sets")
    # values that two sets share have the same bit in both, and those without a bit of their own are counted
    brief = full.select("node", F.size("shingles").alias("n"), "bits", (F.size("shingles") - _ones(F.col("bits"))).alias("over"))
    a, b = (brief.select(*(F.col(c).alias(f"{c}_{x}") for c in brief.columns)) for x in "ab")
    most = _ones(F.zip_with("bits_a", "bits_b", lambda x, y: x.bitwiseAND(y))) + F.least("over_a", "over_b")
    enough = most >= threshold / (1 + threshold) * (F.col("n_a") + F.col("n_b")) - 1e-6
    pairs = stored(pairs.join(a, "node_a").join(b, "node_b").where(enough).select("node_a", "node_b"), "pairs")
    released(spark)
    a, b = (full.select(F.col("node").alias(f"node_{x}"), F.col("document_id").alias(f"id_{x}"), F.col("shingles").alias(f"s_{x}")) for x in "ab")
    out = pairs.join(a, "node_a").join(b, "node_b").withColumn("similarity", jaccard(F.col("s_a"), F.col("s_b"))).where(F.col("similarity") >= threshold)
    return out.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), F.round("similarity", 6).alias("similarity"))


def clusters_of(pairs: DataFrame, kind: str = "near") -> DataFrame:
    """(cluster_id, representative, members): the components of pairs (a, b); the least id represents."""
    members = connected(pairs.select("a", "b")).groupBy("comp").agg(F.array_sort(F.collect_list("node")).alias("members"))
    return members.select(hashing.cluster_id(kind, F.col("members")).alias("cluster_id"), F.col("comp").alias("representative"), "members")


def probe_pairs(prints: DataFrame, bucket: Column, distance: int = HAMMING) -> DataFrame:
    """(a, b): documents of one bucket that agree on the bits of a probe and differ in `distance` bits of their simhashes at most."""
    masks = F.array(*(F.lit(int(np.uint64(int(m, 16)).view(np.int64))) for m in PROBE_MASKS))
    rows = prints.select("document_id", "simhash", bucket.alias("bucket"), F.posexplode(F.transform(masks, lambda m: F.col("simhash").bitwiseAND(m))).alias("probe", "signature"))
    a, b = (rows.select("bucket", "probe", "signature", F.col("document_id").alias(x), F.col("simhash").alias(f"h_{x}")) for x in "ab")
    return a.join(b, ["bucket", "probe", "signature"]).where((F.col("a") < F.col("b")) & (hashing.hamming(F.col("h_a"), F.col("h_b")) <= distance)).select("a", "b").distinct()


def retained(representatives: DataFrame, components: DataFrame, id_col: str = "document_id") -> DataFrame:
    """Representatives that are in no component, or its least member."""
    c = components.select(F.col("node").alias(id_col), "comp")
    return representatives.join(c, id_col, "left").where(F.col("comp").isNull() | (F.col("comp") == F.col(id_col))).drop("comp")


def near_components(pairs: DataFrame) -> DataFrame:
    return stored(connected(pairs.select("a", "b")), "components")
