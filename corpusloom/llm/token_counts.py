"""Token counts: an exact histogram of encoded lengths, and suffix sums that answer every context limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.bpe import default_vocabulary, encoded_lengths
from corpusloom.llm.common import table
from corpusloom.storage import stored

#: Lengths in one block of the two-level sums: no task sorts more rows than this at once.
BLOCK = 4096


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """(length, n_docs, tokens) for each length that occurs. Rows whose length is null are not counted.

    Map-side counts leave at most one row a length and task, whatever the number of documents that share a length.
    """
    return lengths.where(F.col(length_col).isNotNull()).groupBy(F.col(length_col).cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n_docs")).withColumn("tokens", F.col("length") * F.col("n_docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """For each length L of the histogram, taken as a context limit:

    n_docs, tokens: of length L; docs_to, tokens_to: of length L or less; docs_over, tokens_over: longer than L;
    truncated_tokens: the total when each document is cut to L tokens; lost_tokens: what the cut removes;
    quantile: the share of documents of length L or less, rounded to 9 places.

    Sums run within blocks of lengths and over the blocks' totals, so no task holds the whole histogram. For a limit
    between two lengths L1 < L < L2 the answers follow from the row of L1 (see totals_at). An empty table gives no rows.
    """
    block = F.floor(F.col("length") / BLOCK)
    rows = histogram.withColumn("block", block)
    sums = rows.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    # one row a block of lengths: max length / BLOCK rows
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select("block", F.coalesce(F.sum("block_docs").over(after), F.lit(0)).alias("docs_after"), F.coalesce(F.sum("block_tokens").over(after), F.lit(0)).alias("tokens_after"), F.sum("block_docs").over(every).alias("all_docs"), F.sum("block_tokens").over(every).alias("all_tokens"))
    within = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    over = rows.join(sums, "block").select("length", "n_docs", "tokens", "all_docs", "all_tokens", (F.col("docs_after") + F.coalesce(F.sum("n_docs").over(within), F.lit(0))).alias("docs_over"), (F.col("tokens_after") + F.coalesce(F.sum("tokens").over(within), F.lit(0))).alias("tokens_over"))
    cut = F.col("all_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("length")
    return over.select(
        "length", "n_docs", "tokens",
        (F.col("all_docs") - F.col("docs_over")).alias("docs_to"), (F.col("all_tokens") - F.col("tokens_over")).alias("tokens_to"), "docs_over", "tokens_over",
        cut.alias("truncated_tokens"), (F.col("all_tokens") - cut).alias("lost_tokens"),
        F.round((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs"), 9).alias("quantile"),
    )


def totals_at(limits: DataFrame, contexts: list[int]) -> DataFrame:
    """(context, docs_over, truncated_tokens) for any list of context limits, also ones that no document's length equals."""
    # as many partial rows as contexts and tasks
    rows = limits.select("length", "n_docs", F.explode(F.array(*(F.lit(int(c)) for c in contexts)).cast("array<long>")).alias("context"))
    return rows.groupBy("context").agg(
        F.sum(F.when(F.col("length") > F.col("context"), F.col("n_docs")).otherwise(0)).alias("docs_over"),
        F.sum(F.col("n_docs") * F.least("length", "context")).alias("truncated_tokens"),
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = encoded_lengths(table(spark, sf_dir, "documents"), *default_vocabulary(), keep=[])
    # stored, since the sums read it twice and every text would be encoded twice
    return context_limits(stored(length_histogram(lengths), "histogram"))
