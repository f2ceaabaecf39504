"""Coverage, compression, percentile, accuracy and loss metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts_by(df: DataFrame, dimensions: list[str], tokens: Column | None = None) -> DataFrame:
    """(dimension, value, documents[, tokens]) for each dimension, in one pass."""
    one = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions))
    rows = df.select(F.explode(one).alias("x"), (F.lit(0) if tokens is None else tokens).alias("t"))
    aggs = [F.count(F.lit(1)).alias("documents")] + ([] if tokens is None else [F.sum("t").alias("tokens")])
    return rows.groupBy("x.dimension", "x.value").agg(*aggs)


def label_counts(df: DataFrame, array_col: str, name: str) -> DataFrame:
    return df.select(F.explode(array_col).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("documents"))


def shares(df: DataFrame, by: str) -> DataFrame:
    total = F.sum("documents").over(Window.partitionBy(F.lit(0)))
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("documents")).select(by, F.round(F.col("documents") / total, 6).alias("share"))


def compression(df: DataFrame, dimensions: list[str], scale: int = 6) -> DataFrame:
    """Totals, and for each value of each dimension: documents, characters, bytes, tokens, ratios, unknown rate, round-trip failures. One pass over grouping sets."""
    sums = [F.count(F.lit(1)).alias("documents"), *(F.sum(c).alias(c) for c in ("characters", "utf8_bytes", "tokens", "unknowns")), F.sum(F.col("roundtrip_failure").cast("int")).alias("roundtrip_failures")]
    sets = [[], *[[F.col(d)] for d in dimensions]]
    out = df.groupingSets(sets, *map(F.col, dimensions)).agg(*sums)
    ratio = lambda a, b: F.round(F.col(a) / F.col(b), scale)
    return out.withColumn("chars_per_token", ratio("characters", "tokens")).withColumn("bytes_per_token", ratio("utf8_bytes", "tokens")).withColumn("unknown_rate", ratio("unknowns", "tokens"))


def percentiles(df: DataFrame, value: Column, by: list[str] | None = None, at: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """Percentiles with linear interpolation."""
    p = F.percentile(value, list(at)).alias("p")
    out = df.groupBy(*by).agg(p) if by else df.agg(p)
    return out.select(*(by or []), *(F.round(F.get("p", F.lit(k)), 6).alias(f"p{round(100 * x):02d}") for k, x in enumerate(at)))


#: Documents of a stratum that bootstrap() holds in an array.
BLOCK = 4096


def _ranks(df: DataFrame, stratum: str, order: list[str], block: int) -> DataFrame:
    """df with rank (from 0) and size of the stratum. Ranks are counted in parts by the hash of the first order column, so that no stratum meets in a task."""
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("size")).withColumnRenamed(stratum, "_s")
    parted = df.join(sizes, df[stratum].eqNullSafe(F.col("_s"))).drop("_s").withColumn("_p", F.pmod(F.xxhash64(order[0]), F.floor(F.col("size") / block) + 1))
    before = Window.partitionBy(stratum).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parted.groupBy(stratum, "_p").agg(F.count(F.lit(1)).alias("_n")).select(F.col(stratum).alias("_s"), F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    joined = parted.join(parts, parted[stratum].eqNullSafe(F.col("_s")) & (F.col("_p") == F.col("_q")))
    own = F.row_number().over(Window.partitionBy(stratum, "_p").orderBy(*order)) - 1
    return joined.withColumn("rank", F.col("_b") + own).drop("_s", "_p", "_q", "_b")


def bootstrap(df: DataFrame, numerator: str, denominator: str, stratum: str, resamples: int = 2000, seed: str = "bootstrap", block: int = BLOCK) -> DataFrame:
    """(low, high): the 2.5 and 97.5 percentiles of the ratio of sums over resamples within strata.

    A resample draws from each stratum as many documents as it has, with replacement. A hash of the resample and of the
    number of the draw names a block of the stratum, then one of the resample and of the number in the block names a
    document there: no stratum is collected, draws are not shuffled, and the result is the same at every partitioning.
    """
    rows = df.select(F.col(stratum).alias("s"), F.col("document_id").cast("string").alias("d"), F.col(numerator).cast("double").alias("x"), F.col(denominator).cast("double").alias("y"))
    ranked = _ranks(rows, "s", ["d", "x", "y"], block).withColumn("key", F.xxhash64(F.lit(seed), "s"))
    # block k has the ranks from k * block; a draw falls into it in proportion to its documents
    hit = F.floor(F.pmod(F.xxhash64("key", "resample", "rank"), F.col("size")) / block)
    draws = ranked.select("s", "key", "rank", "size", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample"))
    counts = draws.groupBy("s", "key", hit.alias("block"), "resample").agg(F.count(F.lit(1)).cast("int").alias("n"))
    counts = counts.groupBy("s", "key", "block").agg(F.collect_list(F.struct("resample", "n")).alias("counts")).withColumnRenamed("s", "t")
    held = ranked.groupBy("s", F.floor(F.col("rank") / block).alias("of")).agg(F.array_sort(F.collect_list(F.struct("rank", "x", "y"))).alias("held"))

    def drawn(c: Column) -> Column:
        def add(acc: Column, k: Column) -> Column:
            one = F.get("held", F.pmod(F.xxhash64("key", "block", c["resample"], k), F.size("held")).cast("int"))
            return F.struct((acc["x"] + one["x"]).alias("x"), (acc["y"] + one["y"]).alias("y"))

        none = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
        return F.struct(c["resample"].alias("resample"), F.aggregate(F.sequence(F.lit(1), c["n"]), none, add).alias("of"))

    met = counts.join(held, F.col("t").eqNullSafe(F.col("s")) & (F.col("block") == F.col("of")))
    sums = met.select(F.explode(F.transform("counts", drawn)).alias("r")).groupBy("r.resample").agg((F.sum("r.of.x") / F.sum("r.of.y")).alias("ratio"))
    return sums.agg(F.percentile("ratio", [0.025, 0.975]).alias("p")).select(F.get("p", F.lit(0)).alias("low"), F.get("p", F.lit(1)).alias("high"))


def vocabulary_coverage(df: DataFrame, ids: str, size: int) -> DataFrame:
    return df.select(F.explode(ids).alias("id")).agg(F.count_distinct("id").alias("observed"), F.count(F.lit(1)).alias("tokens")).withColumn("coverage", F.round(F.col("observed") / size, 6))


def best_choice(scores: Column) -> Column:
    """The position of the greatest score; the first of equal ones."""
    return -F.array_max(F.transform(scores, lambda s, i: F.struct(s.alias("s"), (-i).alias("i"))))["i"]


def accuracy(df: DataFrame, by: list[str], answer: str, scores: str, lengths: str) -> DataFrame:
    """Raw and length-normalised accuracy, and chance, of multiple-choice tasks."""
    raw = best_choice(F.col(scores)) == F.col(answer)
    normal = best_choice(F.zip_with(scores, lengths, lambda s, n: s / n)) == F.col(answer)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("tasks"), F.round(F.avg(raw.cast("int")), 6).alias("accuracy"), F.round(F.avg(normal.cast("int")), 6).alias("normalized"), F.round(F.avg(1 / F.size(scores)), 6).alias("chance"))


def weighted_loss(df: DataFrame, by: list[str], loss: str, n: str) -> DataFrame:
    mean = F.sum(F.col(loss) * F.col(n)) / F.sum(n)
    return df.groupBy(*by).agg(F.sum(n).alias("targets"), F.round(mean, 9).alias("loss"), F.round(F.exp(mean), 6).alias("perplexity"))


def targets_per_step(df: DataFrame, position: str, targets: str, per_step: int) -> DataFrame:
    return df.groupBy(F.floor(F.col(position) / per_step).alias("step")).agg(F.sum(targets).alias("targets"))


def schedule(steps: DataFrame, name: str, total: int, warmup: int, cooldown: int = 0, least: float = 0.1, col: str = "step") -> DataFrame:
    """steps with multiplier: the learning rate's factor at each step, a function of the step alone."""
    s = F.col(col)
    if name == "constant":
        after = F.lit(1.0)
    elif name == "trapezoidal":
        progress = (s - (total - cooldown)) / F.lit(float(max(cooldown - 1, 1)))
        after = F.when(s < total - cooldown, F.lit(1.0)).otherwise(1 - (1 - least) * progress)
    else:
        progress = (s - warmup) / F.lit(float(max(total - warmup - 1, 1)))
        after = least + (1 - least) * (0.5 * (1 + F.cos(F.pi() * progress)))
    return steps.withColumn("multiplier", F.when(s < warmup, (s + 1) / F.lit(float(max(warmup, 1)))).otherwise(after))


def deltas(events: DataFrame, by: list[str], order: str, value: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """events with the seconds and the change since the one before, and the change a second. ties: columns that order events of one time."""
    own = Window.partitionBy(*by).orderBy(order, *ties)
    seconds = F.col(order).cast("double") - F.lag(order).over(own).cast("double")
    change = F.col(value) - F.lag(value).over(own)
    return events.withColumn("seconds", seconds).withColumn("change", change).withColumn("rate", F.when(F.col("seconds") > 0, F.col("change") / F.col("seconds")))


def candidate_counts(pairs: DataFrame) -> DataFrame:
    """(pairs, documents): how many pairs (a, b) there are, and how many different documents they name."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("d")).distinct().agg(F.count(F.lit(1)).alias("documents"))
    return pairs.agg(F.count(F.lit(1)).alias("pairs")).join(named)


def accuracy_by(df: DataFrame, by: list[str], right: str) -> DataFrame:
    """(by, tasks, accuracy) of answers that are marked right or not; a null mark counts as wrong."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("tasks"), F.round(F.avg(F.coalesce(F.col(right), F.lit(False)).cast("int")), 6).alias("accuracy"))
