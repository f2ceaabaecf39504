"""Selection by stable hashes, quotas and mixtures. Nothing here depends on the order or number of partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import hashing


def by_basis_points(df: DataFrame, key: Column, seed: str | int, points: int | Column) -> DataFrame:
    return df.where(hashing.basis_points(seed, key) < points)


def by_ratio(df: DataFrame, key: Column, seed: str, ratio: float) -> DataFrame:
    """A sample by threshold on a 256-bit hash; nested in that of a larger ratio."""
    return df.where(hashing.below_ratio(hashing.seeded(seed, key, "\x00"), ratio))


def lowest(df: DataFrame, key: Column, seed: str, k: int, by: list[str] | None = None, between: str = "\x00") -> DataFrame:
    """The k rows of the lowest hashes, in all or for each group, with their hash as rank_hash. Top-k is taken before the shuffle."""
    rows = df.withColumn("rank_hash", hashing.seeded(seed, key, between))
    if not by:
        return rows.orderBy("rank_hash").limit(k)
    own = Window.partitionBy(*by).orderBy("rank_hash")
    return rows.withColumn("_rank", F.row_number().over(own)).where(F.col("_rank") <= k).drop("_rank")


def validation_split(df: DataFrame, eligible: Column, id_col: str, seed: str, share: float = 0.01) -> DataFrame:
    """df with split: the share of eligible rows with the lowest hashes validates (the count rounded half to even), all else trains.

    The rank is found with a range-free threshold: only the boundary hash goes to the driver.
    """
    hash_ = hashing.seeded(seed, F.col(id_col), "\x00")
    n = df.where(eligible).count()
    k = round(n * share)
    if not k:
        return df.withColumn("split", F.lit("train"))
    edge = df.where(eligible).select(hash_.alias("h")).orderBy("h").limit(k).agg(F.max("h")).head()[0]
    return df.withColumn("split", F.when(eligible & (hash_ <= edge), "validation").otherwise("train"))


def skip_and_take(df: DataFrame, order: list[str], skip: int, take: int, by: list[str]) -> DataFrame:
    own = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(own)).where((F.col("_n") > skip) & (F.col("_n") <= skip + take)).drop("_n")


def within_quota(df: DataFrame, amount: Column, target: int | Column, by: list[str], order: list[str]) -> DataFrame:
    """Rows in order while the sum before them is below the target: the last row may pass it."""
    own = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("before", F.coalesce(F.sum(amount).over(own), F.lit(0))).where(F.col("before") < target)


def carried_targets(available: list[tuple[str, int]], targets: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, effective target, taken) in priority order: what a source can't fill is carried to the next. A few dozen sources: plain Python."""
    out, carry = [], 0
    for source, have in available:
        wanted = targets[source] + carry
        taken = min(have, wanted)
        carry = wanted - taken
        out.append((source, wanted, taken))
    return out


def redistributed(available: dict[str, int], targets: dict[str, int], fallbacks: list[str], ceiling: int) -> dict[str, int]:
    """Final amounts: what exhausted streams lack goes to the fallbacks in order, up to a ceiling each; an error if it doesn't fit."""
    out = {s: min(targets[s], available[s]) for s in targets}
    missing = sum(targets.values()) - sum(out.values())
    for s in fallbacks:
        more = max(0, min(missing, min(available[s], ceiling) - out.get(s, 0)))
        out[s] = out.get(s, 0) + more
        missing -= more
    if missing:
        raise ValueError(f"{missing} are left that no fallback has")
    return out


def repeated_union(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """The parts together, each row as often as its part's weight, with component and copy."""
    out = None
    for k, (df, weight) in enumerate(parts):
        rows = df.withColumn("component", F.lit(k)).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(weight))))
        out = rows if out is None else out.unionByName(rows)
    return out


def by_rules(df: DataFrame, rules: list[dict], seed: str) -> DataFrame:
    """Documents without warnings that match one rule and its basis points, with the rule's name. Two rules for one document are an error."""
    tests = {r["name"]: F.col("source_id").isin(r["source_ids"]) & F.col("content_type").isin(r["content_types"]) & F.col("language").isin(r["languages"]) for r in rules}
    points = F.coalesce(*(F.when(tests[r["name"]], F.lit(r["basis_points"])) for r in rules))
    matching = F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items())))
    clean = df.where((F.size("quality_warnings") == 0) & (F.size("privacy_warnings") == 0)).withColumn("_rules", matching).where(F.size("_rules") > 0)
    one = clean.withColumn("rule", F.when(F.size("_rules") == 1, F.get("_rules", F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("overlapping rules for "), F.col("document_id")))))
    return one.where((hashing.basis_points(seed, F.col("document_id")) < points) & F.col("rule").isNotNull()).drop("_rules")


def permuted(positions: DataFrame, n: int, seed: int, epoch: int, col: str = "position", rounds: int = 4, walks: int = 64) -> DataFrame:
    """positions with dataset_index: a permutation of range(n) for each seed and epoch.

    A Feistel network over pairs (left, right) of two ranges whose product is n or a little more; where it leaves
    range(n) it is applied again, which keeps it a permutation. One of about sqrt(n) steps leaves the range, so that
    `walks` steps suffice; if ever they don't, that is an error.
    """
    wide = max(1, math.isqrt(max(n, 1) - 1) + 1)
    high = max(1, -(-n // wide))

    def mixed(half: Column, k: int) -> Column:
        text = F.concat(F.lit(f"{seed}:{epoch}:{k}:"), half.cast("string"))
        return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")

    def step(x: Column) -> Column:
        def turned(pair: Column, k: int) -> Column:
            if k == rounds:
                return pair["l"] * wide + pair["r"]
            if k % 2:
                new = F.struct(pair["l"].alias("l"), F.pmod(pair["r"] + mixed(pair["l"], k), F.lit(wide)).alias("r"))
            else:
                new = F.struct(F.pmod(pair["l"] + mixed(pair["r"], k), F.lit(high)).alias("l"), pair["r"].alias("r"))
            # a lambda variable, so that a round is computed once
            return F.get(F.transform(F.array(new), lambda p: turned(p, k + 1)), F.lit(0))

        return turned(F.struct(F.floor(x / wide).alias("l"), F.pmod(x, F.lit(wide)).alias("r")), 0)

    start = F.struct(F.col(col).cast("long").alias("x"), F.lit(False).alias("moved"))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(walks)), start, lambda a, _: F.when(a["moved"] & (a["x"] < n), a).otherwise(F.struct(step(a["x"]).alias("x"), F.lit(True).alias("moved"))), lambda a: a["x"])
    return positions.withColumn("dataset_index", F.when(walk < n, walk).otherwise(F.raise_error(F.lit("the walk did not end"))))


def replayed(steps: DataFrame, every: int, col: str = "step") -> DataFrame:
    """steps with stream and position: each `every`-th step, counted from 1, is of the replayed stream, the others of the main one; both are read in order."""
    replay = F.pmod(F.col(col), F.lit(every)) == 0
    before = F.floor(F.col(col) / every)
    return steps.withColumn("stream", F.when(replay, "replay").otherwise("main")).withColumn("position", F.when(replay, before - 1).otherwise(F.col(col) - before - 1).cast("long"))


def repeated_until(targets: DataFrame, least: int, most: int, order: str, count: str) -> DataFrame:
    """(epoch, order, count, running): the ordered rows again and again, up to the row at which the running sum reaches least; an error if that is over most.

    Sums run over the rows once; the number of epochs follows from the total, and only the last epoch is cut.
    """
    own = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = targets.select(F.col(order), F.col(count), F.sum(count).over(own).alias("upto"))
    total = rows.agg(F.sum(count).alias("t")).head()["t"]
    if not total:
        raise ValueError("there is nothing to repeat")
    total = F.lit(total)
    epochs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.lit(least) - 1) / total)))
    out = rows.withColumn("epoch", epochs).withColumn("running", F.col("upto") + F.col("epoch") * total).where(F.col("running") - F.col(count) < least)
    over = F.when(F.col("running") > most, F.raise_error(F.lit("the plan passes its upper budget"))).otherwise(F.col("running"))
    return out.select("epoch", order, count, over.alias("running"))


def by_source_points(df: DataFrame, seed: str, points: dict[str, int], default: int, id_col: str, source_col: str) -> DataFrame:
    """Rows whose hash is below the basis points of their source, or below the default where it has none."""
    known = F.create_map(*(F.lit(x) for kv in points.items() for x in kv)) if points else F.create_map().cast("map<string,int>")
    return df.where(hashing.basis_points(seed, F.col(id_col)) < F.coalesce(F.try_element_at(known, F.col(source_col)), F.lit(default)))


def by_priority(sources: DataFrame, kind: str, ranks: list[str], then: list[str]) -> DataFrame:
    """sources (a row a source) with place: by the rank of their kind, others last, then by the columns given."""
    rank = F.lit(len(ranks))
    for k, name in enumerate(ranks):
        rank = F.when(F.col(kind) == name, k).otherwise(rank)
    return sources.withColumn("place", F.row_number().over(Window.orderBy(rank, *then)))
