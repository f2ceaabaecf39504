"""Mixing sources to target weights: iterative proportional fitting of token weights, and sampling by calibrated probabilities.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import table
from corpusloom.storage import stored

DIMENSIONS = ("source", "lang", "topic")
#: Target of a dimension: the observed share to this power, normalised; below 1 it lifts small categories.
FLATTENING = {"source": 0.5, "lang": 0.7, "topic": 0.9}
#: Tokens wanted, as a share of all tokens.
BUDGET = 0.5
SWEEPS = 12
#: Up to so many cells (rows of a few numbers) the sweeps run in one task, and the cells are broadcast to the documents.
SMALL_CELLS = 100_000
NONE = "\x00none"


def form_class(text: Column) -> Column:
    """A coarse class of form that stands in for a topic column where documents have none."""
    length = F.length(text)
    lines = F.size(F.split(text, "\n"))
    return F.when(length >= 8000, "long").when(length < 400, "short").when(length < 100 * lines, "list").otherwise("prose")


def estimated_tokens(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, one at least."""
    return F.greatest(F.lit(1), F.floor(F.octet_length(text) / 4)).cast("long")


def cells(docs: DataFrame) -> DataFrame:
    """(source, lang, topic, tokens): summed map-side first, so that a source with a third of all rows is no hot key."""
    return docs.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").cast("double").alias("tokens"))


def _wanted(d: str, given: dict[str | None, float]) -> Column:
    parts = [F.lit(x) for c, w in given.items() for x in (NONE if c is None else c, float(w))]
    return F.coalesce(F.try_element_at(F.create_map(*parts), F.col(d)), F.lit(0.0))


def raked(cell: DataFrame, flattening: dict[str, float] = FLATTENING, sweeps: int = SWEEPS, targets: dict[str, dict[str | None, float]] | None = None, budget: float = BUDGET) -> DataFrame:
    """cells with share: the observed shares fitted to the targets of each dimension in turn, sweeps times.

    A cell gets no more than all of its documents: what is beyond stays with the other cells of its category, as these
    are fitted to what is left of the target in the steps that follow.

    targets has the weights of a dimension's categories (None: the null one), in place of flattened observed shares.
    They are scaled to sum to 1 over the categories there are; those it doesn't name get nothing.
    """
    targets = targets or {}
    total = Window.partitionBy
    out = cell.withColumn("all", F.sum("tokens").over(total(F.lit(0)))).withColumn("share", F.col("tokens") / F.col("all"))
    for d in DIMENSIONS:
        part = total(d)
        # each cell carries its part of the category's powered share, so that the sum over cells is the sum over categories
        out = out.withColumn(f"size_{d}", F.sum("share").over(part)).withColumn(f"power_{d}", _wanted(d, targets[d]) if d in targets else F.pow(f"size_{d}", F.lit(flattening[d])))
        out = out.withColumn(f"norm_{d}", F.sum(F.col(f"power_{d}") * F.col("share") / F.col(f"size_{d}")).over(total(F.lit(0)))).withColumn(f"target_{d}", F.col(f"power_{d}") / F.col(f"norm_{d}"))
    out = out.select(*DIMENSIONS, "tokens", "all", "share", *(f"target_{d}" for d in DIMENSIONS))
    for _ in range(sweeps):
        for d in DIMENSIONS:
            fit = F.col("share") * F.col(f"target_{d}")
            own = F.sum("share").over(total(d))
            # a category can be left with nothing only where targets are given
            fit = F.coalesce(F.try_divide(fit, own), F.lit(0.0)) if targets else fit / own
            out = out.withColumn("share", F.least(fit, F.col("tokens") / F.lit(budget) / F.col("all")))
    return out


def probabilities(docs: DataFrame, flattening: dict[str, float] = FLATTENING, budget: float = BUDGET, sweeps: int = SWEEPS, targets: dict[str, dict[str | None, float]] | None = None) -> tuple[DataFrame, bool]:
    """(source, lang, topic, weight) and whether the table is small. weight: the probability at which a document of the cell is kept."""
    cell = stored(cells(docs), "cells")
    small = cell.limit(SMALL_CELLS + 1).count() <= SMALL_CELLS
    fitted = raked(cell.coalesce(1) if small else cell, flattening, sweeps, targets, budget)
    return stored(fitted.select(*DIMENSIONS, F.least(F.lit(1.0), budget * F.col("share") * F.col("all") / F.col("tokens")).alias("weight")), "weights"), small


def draw(id_: Column) -> Column:
    """A number in [0, 1) from the id alone: rows with one id share their fate at every partitioning."""
    return F.conv(F.substring(F.md5(F.coalesce(id_.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None, flattening: dict[str, float] = FLATTENING, budget: float = BUDGET, keep: list[str] | None = None, targets: dict[str, dict[str | None, float]] | None = None) -> DataFrame:
    """(id, source, lang, topic, n_tokens, weight, sampled[, kept columns]) of each row.

    Token weights are raked to the targets of source, lang and topic (given, or else observed shares to a power); weight is what a cell's documents are sampled by,
    1 at most. Null categories are categories of their own, and null texts count as empty: one token. Repeated rows
    count each, and rows with one id share their fate. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    topic = form_class(text) if topic is None else topic
    known = lambda c: F.coalesce(c, F.lit(NONE))
    # kept columns under other names, so that none of them clashes
    rows = df.select(F.col(id_col).alias("id"), known(F.col("source")).alias("source"), known(F.col("lang")).alias("lang"), known(topic).alias("topic"), estimated_tokens(text).alias("n_tokens"), *(F.col(c).alias(f"kept_{c}") for c in keep or []))
    weights, small = probabilities(rows, flattening, budget, targets=targets)
    joined = rows.join(F.broadcast(weights) if small else weights, list(DIMENSIONS))
    plain = lambda c: F.when(F.col(c) != NONE, F.col(c)).alias(c)
    return joined.select(F.col("id").alias(id_col), *(plain(d) for d in DIMENSIONS), "n_tokens", F.round("weight", 6).alias("weight"), (draw(F.col("id")) < F.col("weight")).alias("sampled"), *(F.col(f"kept_{c}").alias(f"kept_{c}") for c in keep or []))


def sample(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of df that are sampled, with all their columns."""
    out = mixed(df, id_col, keep=df.columns, **options).where("sampled")
    return out.select(*(F.col(f"kept_{c}").alias(c) for c in df.columns))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def oracle(source: str = "documents") -> str:
    power = ", ".join(f"power(size_{d}, {FLATTENING[d]}) AS power_{d}" for d in DIMENSIONS)
    size = ", ".join(f"sum(share) OVER (PARTITION BY {d}) AS size_{d}" for d in DIMENSIONS)
    target = ", ".join(f"power_{d} / sum(power_{d} * share / size_{d}) OVER () AS target_{d}" for d in DIMENSIONS)
    steps, last = [], "w0"
    for k in range(SWEEPS * len(DIMENSIONS)):
        d = DIMENSIONS[k % len(DIMENSIONS)]
        steps.append(f"w{k + 1} AS MATERIALIZED (SELECT * REPLACE (least(share * target_{d} / sum(share) OVER (PARTITION BY {d}), tokens / {BUDGET} / total) AS share) FROM {last})")
        last = f"w{k + 1}"
    text = "coalesce(text, '')"
    return f"""
WITH docs AS (SELECT doc_id, source, lang,
    CASE WHEN length({text}) >= 8000 THEN 'long' WHEN length({text}) < 400 THEN 'short' WHEN length({text}) < 100 * len(string_split({text}, chr(10))) THEN 'list' ELSE 'prose' END AS topic,
    greatest(1, strlen({text}) // 4)::BIGINT AS n_tokens FROM {source}),
cell AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM docs GROUP BY ALL),
s0 AS (SELECT *, sum(tokens) OVER () AS total, tokens / sum(tokens) OVER () AS share FROM cell),
s1 AS (SELECT *, {size} FROM s0), s2 AS (SELECT *, {power} FROM s1), w0 AS MATERIALIZED (SELECT *, {target} FROM s2),
{", ".join(steps)},
p AS (SELECT source, lang, topic, least(1.0, {BUDGET} * share * total / tokens) AS weight FROM {last})
SELECT doc_id, docs.source, docs.lang, docs.topic, n_tokens, round(weight, 6) AS weight, (('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::UBIGINT)::DOUBLE / 4294967296.0 < weight AS sampled
FROM docs JOIN p ON docs.source IS NOT DISTINCT FROM p.source AND docs.lang IS NOT DISTINCT FROM p.lang AND docs.topic = p.topic
"""


ORACLE_SQL = oracle()
