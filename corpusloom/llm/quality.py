"""Quality rules with adaptive thresholds: mergeable quantile sketches for each language and source replace fixed cutoffs.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import bound, table, words_of
from corpusloom.storage import stored

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Bits of a value that the sketch keeps: a bucket is narrower than 1/127 of its values.
PRECISION = 8
#: (metric, weight of the distance between the median and the outer fifth, least distance of the fence from that fifth).
#: The least distance is what a measure may vary by where four fifths of a group have the same value, mostly 0.
FENCES = (("chars_per_100_words", 8, 20), ("symbols_per_1000_chars", 8, 200), ("dup_lines_per_1000", 8, 500))
#: A group's quantiles are drawn towards those of its language, and these towards those of all documents, as if this many
#: further documents had them: the fewer a group has, the more.
PRIOR_DOCS = 100
#: Groups up to which their thresholds (a few numbers each) are sent to all tasks.
SMALL_GROUPS = 50_000


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """How many words lie in windows of width words that occur twice or more in the array, the first occurrence included."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def of_hashes(h: Column) -> Column:
        n = F.size(h)
        keys = F.when(n >= width, F.transform(F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(width))))).otherwise(F.array().cast("array<bigint>"))
        return bound(keys, of_keys)

    def of_keys(keys: Column) -> Column:
        # most texts repeat no window, and need no sort
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(bound(F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))), of_sorted))

    def of_sorted(s: Column) -> Column:
        same = lambda x, j: (x["k"] == F.get(s, j - 1)["k"]) | (x["k"] == F.get(s, j + 1)["k"])
        at = F.array_sort(F.transform(F.filter(s, lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("end"))
        step = lambda acc, p: F.struct((acc["covered"] + p + width - F.greatest(p, acc["end"])).alias("covered"), (p + width).alias("end"))
        return F.aggregate(at, start, step, lambda acc: acc["covered"])

    return bound(hashes, of_hashes)


def measured(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of each text (null: no words)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: _without(line, SPACE) != "")

    def facts(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(_without(text, SPACE)).cast("long").alias("word_chars"),
            (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
            bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            bound(lines, F.size).cast("long").alias("n_lines"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
        )

    out = df.select(*keep, bound(words_of(F.col(text_col)), facts).alias("facts"))
    failed = (F.col("facts.n_words") < 20) | (100 * F.col("facts.n_repeat_words") > 30 * F.col("facts.n_words"))
    return out.select(*keep, "facts.*", failed.alias("base_failed"))


def metrics() -> dict[str, Column]:
    """Whole numbers, so that each engine and partitioning puts a document in the same bucket."""
    per = lambda a, scale, b: F.when(F.col(b) > 0, F.floor(F.col(a) * scale / F.col(b))).otherwise(0).cast("long")
    return {"chars_per_100_words": per("word_chars", 100, "n_words"), "symbols_per_1000_chars": per("n_symbols", 1000, "word_chars"), "dup_lines_per_1000": per("n_dup_lines", 1000, "n_lines")}


def bucket(value: Column) -> Column:
    """The lower edge of the value's bucket: its leading PRECISION bits."""
    shift = F.greatest(F.length(F.bin(value)) - PRECISION, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(facts: DataFrame, by: list[str]) -> DataFrame:
    """(by, metric, bucket, n): a quantile sketch is a count for each bucket, and two are merged by adding counts.

    Map-side sums leave at most one row a bucket and task, so a group of any size costs the same after its shuffle.
    """
    values = F.array(*(F.struct(F.lit(name).alias("metric"), bucket(value).alias("bucket")) for name, value in metrics().items()))
    return facts.select(*by, F.explode(values).alias("v")).groupBy(*by, "v.metric", "v.bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    return sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))


def fifths(sketch: DataFrame, by: list[str], docs: str) -> DataFrame:
    """(by, metric, q20, q50, q80, docs): the buckets in which the documents of rank ceil(n / 5), ceil(n / 2) and ceil(4 n / 5) lie."""
    group = Window.partitionBy(*by, "metric")
    ranked = sketch.select(*by, "metric", "bucket", F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("rank"), F.sum("n").over(group).alias("all"))
    at = lambda k: F.min(F.when(10 * F.col("rank") >= k * F.col("all"), F.col("bucket")))
    return ranked.groupBy(*by, "metric").agg(at(2).alias("q20"), at(5).alias("q50"), at(8).alias("q80"), F.max("all").alias(docs))


def thresholds(facts: DataFrame) -> DataFrame:
    """One row a (lang, source) group: <metric>_low and <metric>_high, beyond which a document is out of its group's range.

    The fences stand the given number of distances between the median and the outer fifth beyond that fifth, and never
    nearer than the least distance. Only documents that pass the base rules count. Null languages and sources are groups
    of their own. Fifths are drawn towards those of the language and of all documents as PRIOR_DOCS says, in whole
    numbers.
    """
    fine = sketches(facts.where(~F.col("base_failed")), ["lang", "source"])
    by_lang = merged(fine, ["lang"])
    by_all = merged(by_lang, [])
    f = fifths(fine, ["lang", "source"], "docs")
    m = fifths(by_lang, ["lang"], "docs")
    a = fifths(by_all, [], "docs")
    f, m, a = (x.select(*(F.col(c).alias(f"{p}_{c}") for c in x.columns)) for p, x in (("f", f), ("m", m), ("a", a)))
    joined = f.join(m, f.f_lang.eqNullSafe(m.m_lang) & (f.f_metric == m.m_metric)).join(a, f.f_metric == a.a_metric)
    marks = ("q20", "q50", "q80")
    drawn = lambda own, other, q: F.expr(f"({own}_docs * {own}_{q} + {PRIOR_DOCS} * {other}_{q}) div ({own}_docs + {PRIOR_DOCS})")
    for q in marks:
        joined = joined.withColumn(f"m_{q}", drawn("m", "a", q))
    out = joined.select(F.col("f_lang").alias("lang"), F.col("f_source").alias("source"), F.col("f_metric").alias("metric"), *(drawn("f", "m", q).alias(q) for q in marks))
    aggs = []
    for name, weight, least in FENCES:
        low = F.col("q20") - F.greatest(weight * (F.col("q50") - F.col("q20")), F.lit(least))
        high = F.col("q80") + F.greatest(weight * (F.col("q80") - F.col("q50")), F.lit(least))
        aggs += [F.max(F.when(F.col("metric") == name, low)).alias(f"{name}_low"), F.max(F.when(F.col("metric") == name, high)).alias(f"{name}_high")]
    return out.groupBy("lang", "source").agg(*aggs)


def judged(facts: DataFrame, limits: DataFrame) -> DataFrame:
    """facts with kept: false if base_failed or outside a fence of its language and source; true where its group has no fences."""
    values = facts.select("*", *(bucket(v).alias(f"b_{name}") for name, v in metrics().items()))
    t = limits.withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    # a row a group of language and source; broadcast only while they are few, else Spark may split a hot group
    small = t.limit(SMALL_GROUPS + 1).count() <= SMALL_GROUPS
    joined = values.join(F.broadcast(t) if small else t, values["lang"].eqNullSafe(t["t_lang"]) & values["source"].eqNullSafe(t["t_source"]), "left")
    inside = F.lit(True)
    for name, _, _ in FENCES:
        inside &= F.coalesce(F.col(f"b_{name}").between(F.col(f"{name}_low"), F.col(f"{name}_high")), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & inside).drop("t_lang", "t_source")


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of each row, by the thresholds of its language and source.

    Null and empty texts have no words and fail the base rules. Repeated rows and ids each get their own row. An empty
    table gives no rows. Other columns of df are ignored, whatever their names.
    """
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    # texts are read once; what is judged after the sketches are complete is a small row a document
    facts = stored(measured(own, ["id", "lang", "source"]), "quality")
    out = judged(facts, stored(thresholds(facts), "limits"))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_filter(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of df that quality_rules() keeps, with all their columns. Texts are measured once and written beside their facts."""
    names = {c: f"kept_{c}" for c in df.columns}
    own = df.select(*(F.col(c).alias(n) for c, n in names.items()), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    facts = stored(measured(own, [*names.values(), "lang", "source"]), "quality")
    limits = stored(thresholds(facts.drop(*names.values())), "limits")
    return judged(facts, limits).where("kept").select(*(F.col(n).alias(c) for c, n in names.items()))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def _bucket_sql(value: str) -> str:
    shift = f"greatest(length(bin({value})) - {PRECISION}, 0)"
    return f"((({value}) >> {shift}) << {shift})"


def _oracle() -> str:
    space = r"[\x20\x09-\x0D]"
    low_high = ", ".join(
        f"max(CASE WHEN metric = '{n}' THEN q20 - greatest({w} * (q50 - q20), {m}) END) AS {n}_low, max(CASE WHEN metric = '{n}' THEN q80 + greatest({w} * (q80 - q50), {m}) END) AS {n}_high" for n, w, m in FENCES
    )
    inside = " AND ".join(f"coalesce(b_{n} BETWEEN {n}_low AND {n}_high, true)" for n, _, _ in FENCES)

    def fifth(name: str, source: str, by: str) -> str:
        keys = f"{by}, metric" if by else "metric"
        at = ", ".join(f"min(CASE WHEN 10 * rank >= {k} * total THEN bucket END) AS q{k}0" for k in (2, 5, 8))
        return f"{name} AS (SELECT {keys}, {at}, max(total)::BIGINT AS docs FROM (SELECT {keys}, bucket, sum(n) OVER (PARTITION BY {keys} ORDER BY bucket) AS rank, sum(n) OVER (PARTITION BY {keys}) AS total FROM {source}) GROUP BY {keys})"

    drawn = lambda own, other: ", ".join(f"({own}.docs * {own}.{q} + {PRIOR_DOCS} * {other}.{q}) // ({own}.docs + {PRIOR_DOCS}) AS {q}" for q in ("q20", "q50", "q80"))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '{space}', '', 'g') <> '') AS lines FROM documents),
wins AS (SELECT r, i, list_aggregate(w[i:i + {WINDOW - 1}], 'string_agg', ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
rep AS (SELECT r, i FROM wins QUALIFY count(*) OVER (PARTITION BY r, k) >= 2),
cov AS (SELECT r, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM rep) GROUP BY r),
f0 AS (SELECT d.r, doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{space}', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN cov ON cov.r = d.r),
f1 AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, CASE WHEN n_words > 0 THEN word_chars * 100 // n_words ELSE 0 END AS v1, CASE WHEN word_chars > 0 THEN n_symbols * 1000 // word_chars ELSE 0 END AS v2, CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS v3 FROM f0),
facts AS (SELECT *, {_bucket_sql("v1")} AS b_{FENCES[0][0]}, {_bucket_sql("v2")} AS b_{FENCES[1][0]}, {_bucket_sql("v3")} AS b_{FENCES[2][0]} FROM f1),
fine AS (SELECT lang, source, metric, bucket, count(*) AS n FROM ({" UNION ALL ".join(f"SELECT lang, source, '{n}' AS metric, b_{n} AS bucket FROM facts WHERE NOT base_failed" for n, _, _ in FENCES)}) GROUP BY ALL),
{fifth("f", "fine", "lang, source")}, {fifth("m0", "(SELECT lang, metric, bucket, sum(n) AS n FROM fine GROUP BY ALL)", "lang")}, {fifth("a", "(SELECT metric, bucket, sum(n) AS n FROM fine GROUP BY ALL)", "")},
m AS (SELECT m0.lang, m0.metric, {drawn("m0", "a")} FROM m0 JOIN a ON a.metric = m0.metric),
lim AS (SELECT lang, source, {low_high} FROM (SELECT f.lang, f.source, f.metric, {drawn("f", "m")} FROM f JOIN m ON f.lang IS NOT DISTINCT FROM m.lang AND f.metric = m.metric) GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {inside} AS kept
FROM facts LEFT JOIN lim ON facts.lang IS NOT DISTINCT FROM lim.lang AND facts.source IS NOT DISTINCT FROM lim.source
"""


ORACLE_SQL = _oracle()
