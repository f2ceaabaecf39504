"""Checks and gates: each is a row (name, passed, detail), so that an audit is a table."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check(df: DataFrame, name: str, passed: Column, detail: Column) -> DataFrame:
    """A check over aggregates of df."""
    return df.agg(passed.alias("passed"), detail.cast("string").alias("detail")).select(F.lit(name).alias("name"), F.coalesce("passed", F.lit(False)).alias("passed"), "detail")


def checks(df: DataFrame, tests: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Several checks over one pass of df."""
    flat = [c.alias(f"{k}_{i}") for i, pair in enumerate(tests.values()) for k, c in zip("pd", pair, strict=True)]
    row = df.agg(*flat)
    each = F.array(*(F.struct(F.lit(name).alias("name"), F.coalesce(F.col(f"p_{i}"), F.lit(False)).alias("passed"), F.col(f"d_{i}").cast("string").alias("detail")) for i, name in enumerate(tests)))
    return row.select(F.inline(each))


def audit(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def corpus_audit(df: DataFrame, min_chars: int, max_chars: int, types: list[str]) -> DataFrame:
    """Bounds, classes, unique ids and unique texts of a corpus: violation counts in one pass, and distinct counts beside it."""
    bad = lambda test: F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0))
    n = F.length("text")
    one = checks(df, {name: (bad(test) == 0, bad(test)) for name, test in {"length_bounds": ~n.between(min_chars, max_chars), "content_type": ~F.col("content_type").isin(types), "blank_text": F.trim("text") == ""}.items()})
    ids = check(df.groupBy("document_id").count(), "unique_ids", F.coalesce(F.max("count"), F.lit(1)) == 1, F.sum(F.col("count") - 1))
    texts = check(df.groupBy(F.sha2("text", 256).alias("t")).count(), "unique_texts", F.coalesce(F.max("count"), F.lit(1)) == 1, F.sum(F.col("count") - 1))
    return audit([one, ids, texts])


def share_limit(df: DataFrame, by: str, amount: Column, most: float) -> DataFrame:
    """(by, amount, share, passed): each category's share against a ceiling."""
    all_ = F.sum("amount").over(Window.partitionBy(F.lit(0)))  # over a row a category
    sums = df.groupBy(by).agg(F.sum(amount).alias("amount")).withColumn("all", all_)
    return sums.select(by, "amount", F.round(F.col("amount") / F.col("all"), 6).alias("share"), (F.col("amount") / F.col("all") <= most).alias("passed"))


def disjoint(a: DataFrame, b: DataFrame, key: str, name: str) -> DataFrame:
    return check(a.select(key).intersect(b.select(key)), name, F.count(F.lit(1)) == 0, F.count(F.lit(1)))


def covered(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Keys that are wanted and not there."""
    return wanted.select(key).distinct().join(have.select(key).distinct(), key, "left_anti")


def file_states(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, state): missing, extra, size_mismatch or ok, of expected and actual (path, size)."""
    e, a = expected.select("path", F.col("size").alias("want")), actual.select("path", F.col("size").alias("have"))
    state = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("want") != F.col("have"), "size_mismatch").otherwise("ok")
    return e.join(a, "path", "full").select("path", state.alias("state"))


def smoke(df: DataFrame, step: str, loss: str, edge: int = 5, slack: float = 1.02) -> DataFrame:
    """Contiguous steps, finite losses, and a mean of the last few losses that is not above that of the first few."""
    low, high = df.agg(F.min(step), F.max(step)).head()
    rows = df.withColumn("lo", F.lit(low)).withColumn("hi", F.lit(high))
    mean = lambda test: F.avg(F.when(test, F.col(loss)))
    first, last = mean(F.col(step) < F.col("lo") + edge), mean(F.col(step) > F.col("hi") - edge)
    finite = F.sum(F.when(F.col(loss).isNull() | F.isnan(loss) | (F.abs(loss) == float("inf")), 1).otherwise(0))
    return checks(rows, {
        "contiguous": ((F.count(F.lit(1)) == F.max("hi") - F.max("lo") + 1) & (F.count_distinct(step) == F.count(F.lit(1))), F.count(F.lit(1))),
        "finite": (finite == 0, finite),
        "not_rising": (last <= slack * first, F.round(last / first, 6)),
    })


def vocabulary_choice(small: DataFrame, large: DataFrame, key: str, gain: float = 0.10) -> DataFrame:
    """Whether the larger vocabulary saves the share of tokens asked for in all, and makes no group worse. Both: (key, tokens); their keys must be equal."""
    both = small.select(key, F.col("tokens").alias("s")).join(large.select(key, F.col("tokens").alias("l")), key, "full")
    return checks(both, {
        "same_groups": (F.sum(F.when(F.col("s").isNull() | F.col("l").isNull(), 1).otherwise(0)) == 0, F.count(F.lit(1))),
        "reduction": (1 - F.sum("l") / F.sum("s") >= gain, F.round(1 - F.sum("l") / F.sum("s"), 6)),
        "no_regression": (F.max(F.when(F.col("l") > F.col("s"), 1).otherwise(0)) == 0, F.sum(F.when(F.col("l") > F.col("s"), 1).otherwise(0))),
    })


def version_id(payload: dict) -> str:
    """A short id of canonical JSON."""
    import hashlib

    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:12]


def manifest(df: DataFrame, source: str, text_col: str = "text") -> DataFrame:
    """One row: rows, characters, bytes and an order-free digest of a dataset."""
    digest = F.sha2(F.col("document_id"), 256)
    return df.agg(F.lit(source).alias("source_id"), F.count(F.lit(1)).alias("record_count"), F.sum(F.length(text_col)).alias("characters"), F.sum(F.octet_length(text_col)).alias("utf8_bytes"), F.min(digest).alias("least_digest"), F.max(digest).alias("greatest_digest"))


def same_counts(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """(stage, rows): row counts along a lineage."""
    return reduce(DataFrame.unionByName, (df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("stage"), "rows") for n, df in stages))


def order_breaks(df: DataFrame, by: str, order: list[str], score: str) -> DataFrame:
    """(by, rows, breaks): how often a row's score is below that of the row before it in its group; 0 where the order is right."""
    before = F.lag(score).over(Window.partitionBy(by).orderBy(*order))
    marked = df.select(by, (F.col(score) < before).cast("int").alias("b"))
    return marked.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("b"), F.lit(0)).alias("breaks"))


def share_sums(shares: DataFrame, by: list[str], share: str, tolerance: float = 1e-9) -> DataFrame:
    """(by, total, complete): whether the shares of each distribution sum to 1."""
    out = shares.groupBy(*by).agg(F.sum(share).alias("total"))
    return out.select(*by, F.round("total", 9).alias("total"), (F.abs(F.col("total") - 1) <= tolerance).alias("complete"))


def least_ratio_gate(metrics: DataFrame, key: str, value: str, least: dict[str, float], default: float) -> DataFrame:
    """metrics with least and passed: whether each group reaches the least value set for it, or the default."""
    known = F.create_map(*(F.lit(x) for kv in least.items() for x in kv))
    bound = F.coalesce(F.try_element_at(known, F.col(key)), F.lit(float(default)))
    return metrics.select(key, value, bound.alias("least"), (F.col(value) >= bound).alias("passed"))


def above_chance(scores: DataFrame, name: str, margin: float) -> DataFrame:
    """(name, tasks, accuracy, chance, passed) of each benchmark, and of all together under the name `all`, weighted by tasks."""
    mean = lambda c: F.sum(F.col(c) * F.col("tasks")) / F.sum("tasks")
    every = scores.agg(F.lit("all").alias(name), F.sum("tasks").alias("tasks"), mean("accuracy").alias("accuracy"), mean("chance").alias("chance"))
    rows = scores.select(name, "tasks", "accuracy", "chance").unionByName(every.where("tasks IS NOT NULL"))
    passed = F.col("accuracy") >= F.col("chance") + margin
    return rows.select(name, "tasks", F.round("accuracy", 6).alias("accuracy"), F.round("chance", 6).alias("chance"), passed.alias("passed"))


def distribution_gate(documents: DataFrame, stream: str, source: str, size: str, targets: dict[str, int], cap: float) -> DataFrame:
    """(stream, size, target, largest, reached, capped): whether each stream reaches its target, and its largest source stays under a share of it."""
    known = F.create_map(*(F.lit(x) for kv in targets.items() for x in kv))
    sources = documents.groupBy(stream, source).agg(F.sum(size).alias("own"))
    out = sources.groupBy(stream).agg(F.sum("own").alias("size"), F.max("own").alias("largest"))
    target = F.try_element_at(known, F.col(stream))
    return out.select(stream, "size", target.alias("target"), "largest", F.coalesce(F.col("size") >= target, F.lit(False)).alias("reached"), (F.col("largest") <= F.col("size") * cap).alias("capped"))
