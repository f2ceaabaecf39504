"""Whole pipelines as chains of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import hashing
from corpusloom.functions import text as X
from corpusloom.operators import dedup, splitting
from corpusloom.operators.filters import parted
from corpusloom.storage import discard, stored


def cleaned(docs: DataFrame) -> DataFrame:
    """Normalised text and merged warnings; nothing is dropped here."""
    out = X.normalize(docs)
    new = X.quality_warnings(F.col("clean_text"), F.col("language"))
    return out.withColumn("quality_warnings", F.array_distinct(F.concat("quality_warnings", new))).withColumn("text", F.col("clean_text")).drop("clean_text")


def small_pipeline(docs: DataFrame) -> DataFrame:
    """(document_id, group_key, split): clean, find exact and near duplicates, split so that duplicates stay together."""
    clean = cleaned(docs)
    # the clean texts are read once and neither written nor joined: all that follows works on their hashes and fingerprints
    every = stored(dedup.fingerprints(clean.withColumn("text_sha256", hashing.content_sha(F.col("text"))), keep=("input_index", "text_sha256")), "every")
    brief = stored(every.select("document_id", "input_index", "text_sha256"), "brief")
    exact = dedup.exact_clusters(brief, sha_col="text_sha256").select(F.explode("members").alias("b"), F.col("representative").alias("a")).where("a <> b")
    representatives = dedup.exact_representatives(brief, sha_col="text_sha256").select("document_id")
    copies = stored(brief.join(representatives, "document_id", "left_anti").select("document_id").distinct(), "copies")
    some, rest = parted(every.drop("text_sha256").where("document_id IS NOT NULL"), F.xxhash64("document_id"), copies.select(F.xxhash64("document_id")))
    prints = stored(rest.unionByName(some.join(copies, "document_id", "left_anti")), "prints")
    discard(every, copies)
    near = dedup.near_pairs(prints)
    links = exact.select("a", "b").unionByName(near.select("a", "b"))
    return splitting.assign(brief, dedup.near_components(links))


def large_pipeline(docs: DataFrame, share: float = 0.01, seed: str = "validation-v1") -> DataFrame:
    """(document_id, split) of what stays: clean, exact representatives, probes, components, retention, eligible rows of lowest hash validate."""
    from corpusloom.operators.sampling import validation_split

    clean = stored(cleaned(docs), "clean")
    representatives = dedup.exact_representatives(clean, "min_id").select("document_id")
    rows = clean.join(representatives, "document_id", "left_semi")
    bucket = F.concat_ws("|", "language", X.length_bucket(F.col("chars")))
    pairs = dedup.probe_pairs(stored(dedup.fingerprints(rows, keep=("language",)), "prints"), bucket)
    kept = dedup.retained(rows, dedup.near_components(pairs))
    tokens = X.estimated_tokens(F.col("text"), F.col("language"))
    return validation_split(kept, (F.size("quality_warnings") == 0) & tokens.between(512, 7168), "document_id", seed, share).select("document_id", "split")
