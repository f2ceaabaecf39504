"""The registered queries of the library, each over its whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import hashing as H
from corpusloom.functions import text as X
from corpusloom.operators import conversations as C
from corpusloom.operators import dedup as D
from corpusloom.operators import gates as G
from corpusloom.operators import metrics as M
from corpusloom.operators import sampling as S
from corpusloom.operators import splitting as P
from corpusloom.operators import tokens as T
from corpusloom.plans import pipelines
from corpusloom.schema import documents, json_line, rekeyed, table, violations
from corpusloom.sources import readers, writers
from corpusloom.storage import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


#: Canonical documents in SQL.
DOCS = "docs AS MATERIALIZED (SELECT 'doc-' || sha256(source || chr(0) || doc_id::VARCHAR) AS document_id, source AS source_id, doc_id::VARCHAR AS source_record_id, text, lang AS language, ['general','encyclopedia','science','math','code'][doc_id % 5 + 1] AS content_type, doc_id AS input_index FROM documents)"
_SPACE = r"[\t-\r \x1c-\x1f\x{85}\p{Z}]"
_NO_LF = r"[\t\x0b-\r \x1c-\x1f\x{85}\p{Z}]"
#: A projection with white space to clean: the tables have none.
_DIRTY_SQL = r"'  ' || replace(replace(text, chr(10), '  ' || chr(13) || chr(10)), '. ', '. ' || chr(10) || chr(10) || chr(10) || chr(10)) || chr(9)"


def dirtied(docs: DataFrame) -> DataFrame:
    text = F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit("  \r\n")), F.lit(". "), F.lit(". \n\n\n\n"))
    return docs.withColumn("text", F.concat(F.lit("  "), text, F.lit("\t")))


_CLEAN = rf"""{DOCS}, c0 AS (SELECT * EXCLUDE (text), {_DIRTY_SQL} AS t0 FROM docs),
c1 AS (SELECT *, nfc_normalize(t0) AS t1 FROM c0), c2 AS (SELECT *, regexp_replace(t1, '\r\n?', chr(10), 'g') AS t2 FROM c1),
c3 AS (SELECT *, regexp_replace(regexp_replace(t2, '{_NO_LF}+\n', chr(10), 'g'), '{_NO_LF}+$', '') AS t3 FROM c2),
c4 AS (SELECT *, regexp_replace(t3, '\n{{3,}}', chr(10) || chr(10), 'g') AS t4 FROM c3),
clean AS MATERIALIZED (SELECT *, regexp_replace(regexp_replace(t4, '^{_SPACE}+', ''), '{_SPACE}+$', '') AS text FROM c4)"""
_CHANGES = "list_filter([CASE WHEN t1 <> t0 THEN 'unicode_nfc' END, CASE WHEN t2 <> t1 THEN 'line_endings' END, CASE WHEN t3 <> t2 THEN 'trailing_whitespace' END, CASE WHEN t4 <> t3 THEN 'excess_blank_lines' END, CASE WHEN text <> t4 THEN 'outer_whitespace' END], lambda x: x IS NOT NULL)"
#: Repetition: long lines and their repeats; runs of one character by islands of equal neighbours.
_WARN = rf"""pl AS (SELECT document_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(regexp_replace(l, '^{_SPACE}+', ''), '{_SPACE}+$', '')), lambda l: length(l) >= 20)) AS l FROM docs),
pr AS (SELECT document_id, CASE WHEN sum(n) < 5 THEN 0.0 ELSE 1 - sum(length(l)) / sum(length(l) * n) END AS ratio FROM (SELECT document_id, l, count(*) AS n FROM pl GROUP BY ALL) GROUP BY document_id),
ch AS (SELECT document_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM docs),
runs AS (SELECT DISTINCT document_id FROM (SELECT document_id, c, i - row_number() OVER (PARTITION BY document_id, c ORDER BY i) AS g FROM ch) GROUP BY document_id, c, g HAVING count(*) >= 20),
warned AS MATERIALIZED (SELECT docs.*, coalesce(ratio, 0.0) AS ratio, list_filter([CASE WHEN length(text) < 200 THEN 'too_short' END, CASE WHEN length(text) > 50000 THEN 'too_long' END, CASE WHEN contains(text, chr(65533)) THEN 'decode_replacement' END, CASE WHEN runs.document_id IS NOT NULL OR coalesce(ratio, 0.0) >= 0.2 THEN 'high_repetition' END, CASE WHEN language = 'zh' THEN 'low_language_confidence' END], lambda x: x IS NOT NULL) AS warnings FROM docs LEFT JOIN pr USING (document_id) LEFT JOIN runs USING (document_id))"""


# --- identities, contracts, buckets -------------------------------------------------------------------------------


@query(f"WITH {DOCS} SELECT document_id, source_id, source_record_id, language, content_type FROM docs")
def doc_identity(spark, sf_dir):
    return documents(spark, sf_dir).select("document_id", "source_id", "source_record_id", "language", "content_type")


@query(f"WITH {DOCS} SELECT document_id, source_record_id || '#sha256-' || sha256(text) AS source_record_id, true AS changed FROM docs")
def content_bound_ids(spark, sf_dir):
    out = rekeyed(documents(spark, sf_dir))
    old = documents(spark, sf_dir).select(F.col("document_id"), "source_id", F.col("source_record_id").alias("r"))
    # the old id beside the new record
    return out.withColumn("r", F.split("source_record_id", "#").getItem(0)).select("source_id", "r", "source_record_id", "changed").join(old, ["source_id", "r"]).select("document_id", "source_record_id", "changed")


@query(f"WITH {DOCS} SELECT document_id, CASE WHEN language IN ('zh-Hans','zh-Hant','en','code') THEN language ELSE 'other' END AS bucket, greatest(1, strlen(text) // 4)::BIGINT AS tokens FROM docs")
def token_estimate(spark, sf_dir):
    return documents(spark, sf_dir).select("document_id", X.language_bucket(F.col("language")).alias("bucket"), X.estimated_tokens(F.col("text"), F.col("language")).alias("tokens"))


_BUCKET = "CASE WHEN length(text) < 256 THEN 'lt-256' WHEN length(text) < 512 THEN 'lt-512' WHEN length(text) < 1024 THEN 'lt-1024' WHEN length(text) < 2048 THEN 'lt-2048' WHEN length(text) < 4096 THEN 'lt-4096' WHEN length(text) < 8192 THEN 'lt-8192' ELSE 'gte-8192' END"


@query(f"WITH {DOCS} SELECT {_BUCKET} AS bucket, language, count(*) AS documents, sum(length(text))::BIGINT AS characters FROM docs GROUP BY ALL")
def length_mix(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.groupBy(X.length_bucket(F.length("text")).alias("bucket"), "language").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length("text")).alias("characters"))


_MIX = [("short", 1, 511), ("middle", 512, 2047), ("long", 2048, 4095), ("full", 4096, 8192)]


@query(f"WITH {DOCS}, t AS (SELECT greatest(1, strlen(text) // 4) AS n FROM docs), b(name, lo, hi) AS (VALUES {', '.join(map(str, _MIX))}) SELECT name, count(*) AS documents, sum(n)::BIGINT AS tokens FROM t JOIN b ON n BETWEEN lo AND hi GROUP BY name")
def mixture_buckets(spark, sf_dir):
    n = X.estimated_tokens(F.col("text"), F.col("language"))
    rows = documents(spark, sf_dir).select(n.alias("n"))
    name = F.coalesce(*(F.when(F.col("n").between(lo, hi), F.lit(b)) for b, lo, hi in _MIX))
    return rows.select(name.alias("name"), "n").where("name IS NOT NULL").groupBy("name").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("tokens"))


@query(f"WITH {DOCS}, bad AS (SELECT document_id, CASE WHEN input_index % 7 = 0 THEN 'poetry' ELSE content_type END AS content_type, CASE WHEN input_index % 11 = 0 THEN '  ' ELSE text END AS text FROM docs) SELECT document_id, 'content_type' AS rule FROM bad WHERE content_type = 'poetry' UNION ALL SELECT document_id, 'text' FROM bad WHERE trim(text) = ''")
def contract_violations(spark, sf_dir):
    d = documents(spark, sf_dir)
    bad = d.withColumn("content_type", F.when(F.col("input_index") % 7 == 0, "poetry").otherwise(F.col("content_type"))).withColumn("text", F.when(F.col("input_index") % 11 == 0, "  ").otherwise(F.col("text")))
    return violations(bad)


@query(f"WITH {DOCS} SELECT document_id, sha256('{{\"content_type\":' || to_json(content_type) || ',\"document_id\":' || to_json(document_id) || ',\"language\":' || to_json(language) || ',\"metadata\":\"{{}}\",\"privacy_warnings\":[],\"quality_warnings\":[],\"schema_version\":1,\"source_id\":' || to_json(source_id) || ',\"source_record_id\":' || to_json(source_record_id) || ',\"text\":' || to_json(text) || '}}') AS line_sha FROM docs")
def canonical_lines(spark, sf_dir):
    return json_line(documents(spark, sf_dir)).select(F.get_json_object("value", "$.document_id").alias("document_id"), F.sha2("value", 256).alias("line_sha"))


# --- cleaning -----------------------------------------------------------------------------------------------------


@query(f"WITH {_CLEAN} SELECT document_id, sha256(text) AS text_sha, array_to_string({_CHANGES}, ',') AS changes FROM clean")
def clean_text(spark, sf_dir):
    return X.normalize(dirtied(documents(spark, sf_dir))).select("document_id", F.sha2("clean_text", 256).alias("text_sha"), F.array_join("changes", ",").alias("changes"))


@query(f"WITH {_CLEAN} SELECT change, count(*) AS documents FROM (SELECT unnest({_CHANGES}) AS change FROM clean) GROUP BY change")
def change_counts(spark, sf_dir):
    return M.label_counts(X.normalize(dirtied(documents(spark, sf_dir))), "changes", "change")


@query(f"WITH {DOCS}, {_WARN} SELECT warning, count(*) AS documents FROM (SELECT unnest(warnings) AS warning FROM warned) GROUP BY warning")
def quality_warning_counts(spark, sf_dir):
    d = documents(spark, sf_dir)
    return M.label_counts(d.withColumn("w", X.quality_warnings(F.col("text"), F.col("language"))), "w", "warning")


@query(f"WITH {DOCS}, {_WARN} SELECT document_id, round(ratio, 6) AS ratio FROM warned WHERE ratio > 0")
def paragraph_repetition(spark, sf_dir):
    return documents(spark, sf_dir).select("document_id", F.round(X.repeated_paragraph_ratio(F.col("text")), 6).alias("ratio")).where("ratio > 0")


_GRAMS = rf"w AS (SELECT document_id, list_filter(string_split_regex(text, '{_SPACE}+'), lambda x: x <> '') AS w FROM docs), g AS (SELECT document_id, CASE WHEN len(w) < 4 THEN 0.0 ELSE 1 - len(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) / (len(w) - 3) END AS ratio FROM w)"


@query(f"WITH {DOCS}, {_GRAMS} SELECT document_id, round(ratio, 6) AS ratio FROM g")
def repeated_four_grams(spark, sf_dir):
    return documents(spark, sf_dir).select("document_id", F.round(X.four_gram_repetition(F.col("text")), 6).alias("ratio"))


@query(r"SELECT sum((regexp_matches(text, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}'))::INT)::BIGINT AS email, sum((regexp_matches(text, '(^|[^0-9])1[3-9][0-9]{9}([^0-9]|$)'))::INT)::BIGINT AS phone FROM documents")
def alert_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.agg(F.sum(X.has_email(F.col("text")).cast("int")).alias("email"), F.sum(X.has_phone(F.col("text")).cast("int")).alias("phone"))


@query(f"WITH {DOCS}, {_WARN}, reps AS (SELECT text, min_by(document_id, input_index) AS document_id FROM docs GROUP BY text), r AS (SELECT w.* FROM warned w JOIN reps USING (document_id)) SELECT 'language' AS dimension, language AS value, count(*) AS documents FROM r GROUP BY ALL UNION ALL SELECT 'warning', warning, count(*) FROM (SELECT unnest(warnings) AS warning FROM r) GROUP BY ALL")
def clean_dedup_counts(spark, sf_dir):
    """The flagship: clean, take one document a text, count by language and warning."""
    clean = pipelines.cleaned(documents(spark, sf_dir))
    rows = clean.select("language", "quality_warnings", "input_index", F.sha2("text", 256).alias("sha"))
    first = rows.groupBy("sha").agg(F.min_by(F.struct("language", "quality_warnings"), "input_index").alias("r")).select("r.*")
    both = F.concat(F.array(F.struct(F.lit("language").alias("dimension"), F.col("language").alias("value"))), F.transform("quality_warnings", lambda w: F.struct(F.lit("warning").alias("dimension"), w.alias("value"))))
    return first.select(F.explode(both).alias("x")).groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("documents"))


# --- exact duplicates ---------------------------------------------------------------------------------------------


@query(f"WITH {DOCS} SELECT sha256(text) AS text_sha256, min_by(document_id, input_index) AS representative, string_agg(document_id, ',' ORDER BY input_index) AS members, count(*) AS n FROM docs GROUP BY text HAVING count(*) > 1")
def exact_clusters(spark, sf_dir):
    return D.exact_clusters(documents(spark, sf_dir)).withColumn("members", F.array_join("members", ","))


@query(f"WITH {DOCS} SELECT sha256(text) AS text_sha256, min(document_id) AS document_id FROM docs GROUP BY text")
def exact_reps_min_id(spark, sf_dir):
    return D.exact_representatives(documents(spark, sf_dir), "min_id")


@query(f"WITH {DOCS} SELECT sha256(text) AS text_sha256, min_by(document_id, input_index) AS document_id FROM docs GROUP BY text")
def exact_reps_earliest(spark, sf_dir):
    return D.exact_representatives(documents(spark, sf_dir), "earliest")


@query(f"WITH {DOCS} SELECT document_id, sha256(trim(text)) AS digest FROM docs QUALIFY row_number() OVER (PARTITION BY sha256(trim(text)) ORDER BY source_id, input_index) = 1")
def dedup_first_wins(spark, sf_dir):
    return D.first_wins(documents(spark, sf_dir), ["source_id", "input_index"], F.trim("text")).select("document_id", "digest")


@query(f"WITH {DOCS} SELECT document_id, language FROM docs QUALIFY row_number() OVER (PARTITION BY language, sha256(trim(text)) ORDER BY input_index) = 1")
def dedup_within_language(spark, sf_dir):
    return D.first_wins(documents(spark, sf_dir), ["input_index"], F.trim("text"), ["language"]).select("document_id", "language")


@query(f"WITH {DOCS}, two AS (SELECT document_id, 0 AS shard, input_index AS line FROM docs UNION ALL SELECT document_id, 1, input_index FROM docs WHERE input_index % 3 = 0) SELECT document_id, shard, line FROM two QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY shard, line) = 1")
def identity_dedup(spark, sf_dir):
    d = documents(spark, sf_dir).select("document_id", F.col("input_index").alias("line"))
    two = d.withColumn("shard", F.lit(0)).unionByName(d.where("line % 3 = 0").withColumn("shard", F.lit(1)))
    return D.first_rows(two, ["document_id"], ["shard", "line"]).select("document_id", "shard", "line")


@query("SELECT count(*) - count(DISTINCT text) AS duplicates, round((count(*) - count(DISTINCT text)) / count(*), 6) AS fraction FROM documents")
def duplicate_fraction(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    return d.agg((F.sum("n") - F.count(F.lit(1))).alias("duplicates"), F.round((F.sum("n") - F.count(F.lit(1))) / F.sum("n"), 6).alias("fraction"))


# --- near duplicates ----------------------------------------------------------------------------------------------


def _prints(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir)
    reps = d.join(D.exact_representatives(d).select("document_id"), "document_id", "left_semi")
    return stored(D.fingerprints(reps), "prints")


@query()
def shingle_counts(spark, sf_dir):
    return D.fingerprints(documents(spark, sf_dir)).select("document_id", F.size("shingles").alias("shingles"), F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("simhash"))


@query()
def near_pairs(spark, sf_dir):
    return D.near_pairs(_prints(spark, sf_dir))


@query()
def near_clusters(spark, sf_dir):
    pairs = D.near_pairs(_prints(spark, sf_dir), 0.5).select("a", "b")
    return D.clusters_of(pairs).select("cluster_id", "representative", F.array_join("members", ",").alias("members"))


@query()
def probe_pairs(spark, sf_dir):
    return D.probe_pairs(_prints(spark, sf_dir), F.lit("all"), 12)


_EDGES = f"WITH RECURSIVE {DOCS}, e AS (SELECT a.document_id AS a, b.document_id AS b FROM (SELECT document_id, text, lag(document_id) OVER (PARTITION BY text ORDER BY document_id) AS p FROM docs) a JOIN docs b ON b.document_id = a.p), both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT a AS node, a AS r FROM both_ UNION SELECT x.node, y.b FROM reach x JOIN both_ y ON y.a = x.r)"


def _chain(docs: DataFrame) -> DataFrame:
    """Links between neighbours of equal texts by id: chains, which components must join."""
    own = Window.partitionBy(F.sha2("text", 256)).orderBy("document_id")
    return docs.select(F.col("document_id").alias("a"), F.lag("document_id").over(own).alias("b")).where("b IS NOT NULL")


@query(_EDGES + " SELECT node, min(r) AS comp FROM reach GROUP BY node")
def components(spark, sf_dir):
    return D.near_components(_chain(documents(spark, sf_dir)))


@query(_EDGES + ", comp AS (SELECT node, min(r) AS comp FROM reach GROUP BY node) SELECT document_id FROM docs LEFT JOIN comp ON node = document_id WHERE comp IS NULL OR comp = document_id")
def retained_docs(spark, sf_dir):
    d = documents(spark, sf_dir)
    return D.retained(d.select("document_id"), D.near_components(_chain(d)))


@query(f"WITH {DOCS}, m AS (SELECT list_sort(list(document_id)) AS m FROM docs GROUP BY text HAVING count(*) > 1) SELECT 'cluster-' || sha256('exact' || chr(0) || array_to_string(m, chr(0))) AS cluster_id, len(m) AS n FROM m")
def cluster_ids(spark, sf_dir):
    return D.exact_clusters(documents(spark, sf_dir)).select(H.cluster_id("exact", F.col("members")).alias("cluster_id"), F.size("members").cast("long").alias("n"))


# --- splits -------------------------------------------------------------------------------------------------------

_SPLIT = _EDGES + f""", comp AS (SELECT node, min(r) AS comp FROM reach GROUP BY node), grp AS MATERIALIZED (SELECT document_id, coalesce(comp, document_id) AS group_key FROM docs LEFT JOIN comp ON node = document_id),
sizes AS MATERIALIZED (SELECT group_key, count(*) AS size FROM grp GROUP BY group_key), n AS (SELECT count(*) AS n FROM docs),
rt AS MATERIALIZED (SELECT group_key, size, row_number() OVER (ORDER BY sha256('{P.SALT}' || chr(0) || 'test' || chr(0) || group_key)) AS k FROM sizes),
ft AS (SELECT 0::BIGINT AS k, ''::VARCHAR AS group_key, false AS taken, (SELECT floor(n * 0.01)::BIGINT FROM n) AS remaining UNION ALL SELECT rt.k, rt.group_key, rt.size <= ft.remaining, CASE WHEN rt.size <= ft.remaining THEN ft.remaining - rt.size ELSE ft.remaining END FROM ft JOIN rt ON rt.k = ft.k + 1 WHERE ft.remaining > 0),
rv AS MATERIALIZED (SELECT group_key, size, row_number() OVER (ORDER BY sha256('{P.SALT}' || chr(0) || 'validation' || chr(0) || group_key)) AS k FROM sizes WHERE group_key NOT IN (SELECT group_key FROM ft WHERE taken)),
fv AS (SELECT 0::BIGINT AS k, ''::VARCHAR AS group_key, false AS taken, (SELECT floor(n * 0.01)::BIGINT FROM n) AS remaining UNION ALL SELECT rv.k, rv.group_key, rv.size <= fv.remaining, CASE WHEN rv.size <= fv.remaining THEN fv.remaining - rv.size ELSE fv.remaining END FROM fv JOIN rv ON rv.k = fv.k + 1 WHERE fv.remaining > 0),
assigned AS (SELECT document_id, group_key, CASE WHEN group_key IN (SELECT group_key FROM ft WHERE taken) THEN 'test' WHEN group_key IN (SELECT group_key FROM fv WHERE taken) THEN 'validation' ELSE 'train' END AS split FROM grp)"""


def _assigned(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir)
    return P.assign(d, D.near_components(_chain(d)))


@query(_SPLIT + " SELECT * FROM assigned")
def leakage_safe_split(spark, sf_dir):
    return _assigned(spark, sf_dir)


@query(_SPLIT + " SELECT split, language, count(*) AS documents FROM assigned JOIN docs USING (document_id) GROUP BY ALL")
def split_counts(spark, sf_dir):
    return _assigned(spark, sf_dir).join(documents(spark, sf_dir).select("document_id", "language"), "document_id").groupBy("split", "language").agg(F.count(F.lit(1)).alias("documents"))


@query("SELECT l_orderkey AS group_key, count(DISTINCT l_returnflag) AS splits FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) > 1")
def split_leakage(spark, sf_dir):
    """Orders stand for groups and return flags for splits, so that some groups do lie in several and some don't; leakage_safe_split is tested to have none."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group_key"), F.col("l_returnflag").alias("split"))
    return P.leaks(rows)


_ELIGIBLE = "(length(text) >= 200 AND greatest(1, strlen(text) // 4) BETWEEN 512 AND 7168)"


@query(f"WITH {DOCS}, h AS (SELECT document_id, {_ELIGIBLE} AS ok, sha256('v1' || chr(0) || document_id) AS h FROM docs), r AS (SELECT document_id, ok, row_number() OVER (PARTITION BY ok ORDER BY h) AS k, count(*) OVER (PARTITION BY ok) AS n FROM h) SELECT document_id, CASE WHEN ok AND k <= round_even(n * 0.01, 0) THEN 'validation' ELSE 'train' END AS split FROM r")
def validation_99_1(spark, sf_dir):
    ok = (F.length("text") >= 200) & X.estimated_tokens(F.col("text"), F.col("language")).between(512, 7168)
    return S.validation_split(documents(spark, sf_dir), ok, "document_id", "v1").select("document_id", "split")


# --- sampling and mixing ------------------------------------------------------------------------------------------


@query(f"WITH {DOCS} SELECT document_id, (('0x' || substr(sha256('s1:' || document_id), 1, 16))::UBIGINT % 10000)::INT AS points FROM docs WHERE ('0x' || substr(sha256('s1:' || document_id), 1, 16))::UBIGINT % 10000 < 2500")
def hash_sample_bp(spark, sf_dir):
    d = documents(spark, sf_dir)
    return S.by_basis_points(d, F.col("document_id"), "s1", 2500).select("document_id", H.basis_points("s1", F.col("document_id")).alias("points"))


@query(f"WITH {DOCS} SELECT document_id, sha256('s2' || chr(0) || document_id) < '4000000000000000000000000000000000000000000000000000000000000000' AS quarter FROM docs WHERE sha256('s2' || chr(0) || document_id) < '8000000000000000000000000000000000000000000000000000000000000000'")
def threshold_sample(spark, sf_dir):
    d = S.by_ratio(documents(spark, sf_dir), F.col("document_id"), "s2", 0.5)
    return d.select("document_id", H.below_ratio(H.seeded("s2", F.col("document_id"), "\x00"), 0.25).alias("quarter"))


_HELD = "held AS (SELECT document_id, source_id, sha256('43' || chr(0) || document_id) AS rank_hash FROM docs QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY sha256('43' || chr(0) || document_id)) <= 5)"


@query(f"WITH {DOCS}, {_HELD} SELECT document_id, source_id, rank_hash FROM held")
def heldout_lowest_k(spark, sf_dir):
    return S.lowest(documents(spark, sf_dir), F.col("document_id"), "43", 5, ["source_id"]).select("document_id", "source_id", "rank_hash")


@query(f"WITH {DOCS}, {_HELD} SELECT source_id, count(*) AS documents FROM docs WHERE document_id NOT IN (SELECT document_id FROM held) AND sha256('42' || chr(0) || document_id) < 'c000000000000000000000000000000000000000000000000000000000000000' GROUP BY source_id")
def train_minus_heldout(spark, sf_dir):
    d = documents(spark, sf_dir)
    held = S.lowest(d, F.col("document_id"), "43", 5, ["source_id"]).select("document_id")
    return S.by_ratio(d.join(held, "document_id", "left_anti"), F.col("document_id"), "42", 0.75).groupBy("source_id").agg(F.count(F.lit(1)).alias("documents"))


@query(f"WITH {DOCS} SELECT document_id, sha256('7:' || document_id) AS rank_hash FROM docs ORDER BY rank_hash LIMIT 25")
def lowest_hash_top_k(spark, sf_dir):
    """A top-k report: the limit is the feature."""
    return S.lowest(documents(spark, sf_dir), F.col("document_id"), "7", 25, between=":").select("document_id", "rank_hash")


@query(f"WITH {DOCS} SELECT document_id, source_id FROM docs QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY input_index) BETWEEN 4 AND 13")
def offset_then_limit(spark, sf_dir):
    return S.skip_and_take(documents(spark, sf_dir), ["input_index"], 3, 10, ["source_id"]).select("document_id", "source_id")


@query(f"WITH {DOCS}, r AS (SELECT document_id, source_id, coalesce(sum(greatest(1, strlen(text) // 4)) OVER (PARTITION BY source_id ORDER BY input_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM docs) SELECT * FROM r WHERE before < 10000")
def quota_by_source(spark, sf_dir):
    n = X.estimated_tokens(F.col("text"), F.col("language"))
    return S.within_quota(documents(spark, sf_dir), n, 10_000, ["source_id"], ["input_index"]).select("document_id", "source_id", "before")


@query(f"WITH {DOCS}, u AS (SELECT * FROM docs QUALIFY row_number() OVER (PARTITION BY trim(text) ORDER BY source_id, input_index) = 1), r AS (SELECT document_id, source_id, coalesce(sum(strlen(text)) OVER (PARTITION BY source_id ORDER BY input_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM u WHERE length(trim(text)) BETWEEN 100 AND 20000) SELECT source_id, count(*) AS documents, max(before) AS before FROM r WHERE before < 60000 GROUP BY source_id")
def byte_quota_after_dedup(spark, sf_dir):
    d = D.first_wins(documents(spark, sf_dir), ["source_id", "input_index"], F.trim("text")).where(F.length(F.trim("text")).between(100, 20_000))
    return S.within_quota(d, F.octet_length("text").cast("long"), 60_000, ["source_id"], ["input_index"]).groupBy("source_id").agg(F.count(F.lit(1)).alias("documents"), F.max("before").alias("before"))


@query(f"WITH RECURSIVE {DOCS}, s AS (SELECT source_id, sum(greatest(1, strlen(text) // 4))::BIGINT AS have, row_number() OVER (ORDER BY source_id) AS k FROM docs GROUP BY source_id), f AS (SELECT 0::BIGINT AS k, ''::VARCHAR AS source_id, 0::BIGINT AS effective, 0::BIGINT AS taken, 0::BIGINT AS carry UNION ALL SELECT s.k, s.source_id, 30000 + f.carry, least(s.have, 30000 + f.carry), 30000 + f.carry - least(s.have, 30000 + f.carry) FROM f JOIN s ON s.k = f.k + 1) SELECT source_id, effective, taken FROM f WHERE k > 0")
def carry_forward(spark, sf_dir):
    n = X.estimated_tokens(F.col("text"), F.col("language"))
    sums = documents(spark, sf_dir).groupBy("source_id").agg(F.sum(n).alias("have")).orderBy("source_id").collect()  # a row a source
    rows = S.carried_targets([(r[0], r[1]) for r in sums], {r[0]: 30_000 for r in sums})
    return spark.createDataFrame(rows or [], "source_id string, effective long, taken long")


_RULES = [{"name": "wiki-en", "source_ids": [f"src{i}" for i in range(10)], "content_types": ["encyclopedia", "science"], "languages": ["en"], "basis_points": 6000}, {"name": "code-any", "source_ids": [f"src{i}" for i in range(20)], "content_types": ["code"], "languages": ["en", "fr", "de", "es"], "basis_points": 3000}]


@query(f"WITH {DOCS}, s AS (SELECT document_id, CASE WHEN source_id IN ({', '.join(repr(x) for x in _RULES[0]['source_ids'])}) AND content_type IN ('encyclopedia', 'science') AND language = 'en' THEN 'wiki-en' WHEN content_type = 'code' AND source_id LIKE 'src%' THEN 'code-any' END AS rule, ('0x' || substr(sha256('cool:' || document_id), 1, 16))::UBIGINT % 10000 AS p FROM docs) SELECT document_id, rule FROM s WHERE p < CASE rule WHEN 'wiki-en' THEN 6000 WHEN 'code-any' THEN 3000 END")
def rule_selection(spark, sf_dir):
    return S.by_rules(documents(spark, sf_dir), _RULES, "cool").select("document_id", "rule")


@query(f"WITH {DOCS} SELECT component, language, count(*) AS documents FROM (SELECT 0 AS component, language, unnest(range(1)) FROM docs WHERE language = 'en' UNION ALL SELECT 1, language, unnest(range(3)) FROM docs WHERE language <> 'en') GROUP BY ALL")
def mixture_repeat(spark, sf_dir):
    d = documents(spark, sf_dir)
    return S.repeated_union([(d.where("language = 'en'"), 1), (d.where("language <> 'en'"), 3)]).groupBy("component", "language").agg(F.count(F.lit(1)).alias("documents"))


def _feistel_sql(x: str, rows: str, seed: int = 17, epoch: int = 3, rounds: int = 4) -> str:
    """(position, x): x put through the network once, in a subquery a round."""
    half = lambda c, k: f"('0x' || substr(md5('{seed}:{epoch}:{k}:' || {c}::VARCHAR), 1, 8))::UBIGINT::BIGINT"
    out = f"(SELECT position, wide, high, n, {x} // wide AS l, {x} % wide AS r FROM {rows})"
    for k in range(rounds):
        new = f"l, (r + {half('l', k)}) % wide AS r" if k % 2 else f"(l + {half('r', k)}) % high AS l, r"
        out = f"(SELECT position, wide, high, n, {new} FROM {out})"
    return f"SELECT position, wide, high, n, l * wide + r AS x FROM {out}"


@query(f"WITH RECURSIVE c AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS wide FROM documents), s AS (SELECT range AS position, wide, (n + wide - 1) // wide AS high, n FROM c, range(1000000) WHERE range < n), w AS ({_feistel_sql('position', 's')} UNION ALL {_feistel_sql('x', '(SELECT * FROM w WHERE x >= n)')}) SELECT position, x AS dataset_index FROM w WHERE x < n")
def shuffled_order(spark, sf_dir):
    n = table(spark, sf_dir, "documents").count()
    return S.permuted(spark.range(n).withColumnRenamed("id", "position"), n, 17, 3)


@query("SELECT range AS step, CASE WHEN range % 5 = 0 THEN 'replay' ELSE 'main' END AS stream, CASE WHEN range % 5 = 0 THEN range // 5 - 1 ELSE range - range // 5 - 1 END AS position FROM range(1, 1001)")
def replay_interleave(spark, sf_dir):
    return S.replayed(spark.range(1, 1001).withColumnRenamed("id", "step"), 5)


@query("WITH t AS (SELECT item_id, length(text) AS targets FROM benchmark), c AS (SELECT *, sum(targets) OVER (ORDER BY item_id) AS upto, sum(targets) OVER () AS total FROM t), e AS (SELECT item_id, targets, range AS epoch, upto + range * total AS running FROM c, range(4)) SELECT epoch, item_id, targets, running::BIGINT AS running FROM e JOIN (SELECT max(total) AS t FROM c) ON true WHERE running - targets < t * 2 + t // 2")
def plan_repetition(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.length("text").alias("targets"))
    total = rows.agg(F.sum("targets")).head()[0]
    return S.repeated_until(rows, total * 2 + total // 2, total * 3, "item_id", "targets")


@query(f"WITH {DOCS} SELECT document_id FROM docs WHERE (('0x' || substr(sha256('s:' || document_id), 1, 16))::UBIGINT % 10000) < CASE source_id WHEN 'src1' THEN 9000 WHEN 'src2' THEN 500 ELSE 2500 END")
def points_by_source(spark, sf_dir):
    return S.by_source_points(documents(spark, sf_dir), "s", {"src1": 9000, "src2": 500}, 2500, "document_id", "source_id").select("document_id")


# --- token streams ------------------------------------------------------------------------------------------------

_TOKENS = f"{DOCS}, tok AS MATERIALIZED (SELECT document_id, source_id, language, input_index, list_concat([2], list_transform(list_filter(string_split(text, ''), lambda c: c <> ''), lambda c: ascii(c) + 4), [3]) AS tokens FROM docs)"


def _tokens(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).withColumn("tokens", T.wrapped(T.code_points(F.col("text"))))


@query(f"WITH {_TOKENS} SELECT document_id, len(tokens)::BIGINT AS token_count, (sum(len(tokens)) OVER (PARTITION BY source_id ORDER BY input_index) - len(tokens))::BIGINT AS token_offset FROM tok")
def token_offsets(spark, sf_dir):
    return T.token_offsets(_tokens(spark, sf_dir), F.size("tokens").cast("long"), ["source_id"], ["input_index"]).select("document_id", "token_count", "token_offset")


@query(f"WITH {_TOKENS}, s AS (SELECT unnest(tokens) AS t, input_index, generate_subscripts(tokens, 1) AS i FROM tok), n AS (SELECT t, row_number() OVER (ORDER BY input_index, i) - 1 AS k FROM s) SELECT (k // 512)::BIGINT AS block_id, sum(t)::BIGINT AS token_sum, min_by(t, k)::BIGINT AS first_token, max_by(t, k)::BIGINT AS last_token FROM n GROUP BY k // 512 HAVING count(*) = 512")
def packed_blocks(spark, sf_dir):
    b = T.packed_blocks(_tokens(spark, sf_dir).select("tokens", "input_index"), "tokens", 512, "input_index")
    total = F.aggregate("tokens", F.lit(0).cast("long"), lambda n, t: n + t)
    return b.select("block_id", total.alias("token_sum"), F.element_at("tokens", 1).cast("long").alias("first_token"), F.element_at("tokens", -1).cast("long").alias("last_token"))


_WINDOWS = f"{_TOKENS}, win AS (SELECT document_id, unnest(range(0, len(tokens) - 2048 + 1, 1536)) AS window_start FROM tok WHERE len(tokens) >= 2048)"


@query(f"WITH {_WINDOWS} SELECT document_id, window_start, window_start + 2048 AS window_end, CASE WHEN window_start = 0 THEN 0.0 ELSE 0.25 END AS overlap_ratio FROM win")
def long_windows(spark, sf_dir):
    d = _tokens(spark, sf_dir).withColumn("n", F.size("tokens").cast("long"))
    return T.long_windows(d, "n", 2048, 1536, ["document_id"])


@query(f"WITH {_WINDOWS}, h AS (SELECT *, sha256('w' || chr(0) || document_id || ':' || window_start::VARCHAR) AS selection_hash FROM win) SELECT document_id, window_start, selection_hash, row_number() OVER (ORDER BY selection_hash, document_id, window_start) - 1 AS rank FROM h ORDER BY selection_hash LIMIT 50")
def ranked_windows(spark, sf_dir):
    """The first windows by hash: the limit is the feature."""
    w = long_windows(spark, sf_dir)
    key = F.concat_ws(":", "document_id", F.col("window_start").cast("string"))
    return T.ranked_windows(w, "w", key, 50, ["document_id", "window_start"]).select("document_id", "window_start", "selection_hash", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_TOKENS}, s AS (SELECT document_id, unnest(list_concat([2], tokens[1:6], tokens[1:4], [0, 0])) AS t, unnest(range(12)) AS i FROM tok) SELECT document_id, array_to_string(list(seg ORDER BY i), ',') AS segments FROM (SELECT document_id, i, CASE WHEN t = 0 THEN 0 ELSE sum(CASE WHEN t = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY i) END::BIGINT AS seg FROM s WHERE i IS NOT NULL AND t IS NOT NULL) GROUP BY document_id")
def segment_ids(spark, sf_dir):
    block = F.concat(F.array(F.lit(2)), F.slice("tokens", 1, 6), F.slice("tokens", 1, 4), F.array(F.lit(0), F.lit(0)))
    # short documents make shorter blocks; the SQL's range ends with them
    return _tokens(spark, sf_dir).select("document_id", F.array_join(F.slice(T.segments(block), 1, 12).cast("array<string>"), ",").alias("segments"))


@query(f"WITH {_TOKENS}, st AS (SELECT document_id, tokens, unnest(CASE WHEN len(tokens) <= 1000 THEN [0] ELSE range(0, len(tokens) - 1, 999) END) AS start FROM tok) SELECT document_id, start, len(tokens[start + 1:start + 1000]) AS length, list_sum(tokens[start + 1:start + 1000])::BIGINT AS token_sum, list_sum(CASE WHEN start = 0 THEN tokens[1:1000] ELSE tokens[start + 2:start + 1000] END)::BIGINT - CASE WHEN start = 0 THEN 0 ELSE 100 END AS label_sum FROM st")
def label_fragments(spark, sf_dir):
    f = _tokens(spark, sf_dir).select("document_id", F.explode(T.fragments(F.col("tokens"), F.col("tokens"), 1000)).alias("f"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, t: n + t)
    return f.select("document_id", F.col("f.start").cast("long").alias("start"), F.size("f.tokens").cast("long").alias("length"), total("f.tokens").alias("token_sum"), total("f.labels").alias("label_sum"))


@query(f"WITH {_TOKENS} SELECT document_id, (ceil(len(tokens) / 512.0) * 512)::BIGINT AS padded FROM tok")
def padded_lengths(spark, sf_dir):
    return _tokens(spark, sf_dir).select("document_id", T.padded_length(F.size("tokens"), 512).alias("padded"))


@query(f"WITH {_TOKENS} SELECT count(DISTINCT t) AS observed, count(*) AS tokens, round(count(DISTINCT t) / 70000, 6) AS coverage FROM (SELECT unnest(tokens) AS t FROM tok)")
def vocabulary_coverage(spark, sf_dir):
    return M.vocabulary_coverage(_tokens(spark, sf_dir), "tokens", 70_000)


@query(f"WITH RECURSIVE {_TOKENS}, r AS MATERIALIZED (SELECT source_id, document_id, len(tokens) AS n, row_number() OVER (PARTITION BY source_id ORDER BY input_index) AS k FROM tok), f AS (SELECT source_id, document_id, k, 0 AS shard, n AS used FROM r WHERE k = 1 UNION ALL SELECT r.source_id, r.document_id, r.k, CASE WHEN f.used + r.n > 20000 THEN f.shard + 1 ELSE f.shard END, CASE WHEN f.used + r.n > 20000 THEN r.n ELSE f.used + r.n END FROM f JOIN r ON r.source_id = f.source_id AND r.k = f.k + 1) SELECT document_id, source_id, shard FROM f")
def shard_rollover(spark, sf_dir):
    sizes = _tokens(spark, sf_dir).select("document_id", "source_id", "input_index", F.size("tokens").alias("n"))
    return T.next_fit(sizes, "n", 20_000, ["source_id"], ["input_index"]).select("document_id", "source_id", "shard")


@query()
def binary_round_trip(spark, sf_dir):
    """Token shards as bytes, read back: documents and tokens of each shard."""
    sizes = _tokens(spark, sf_dir).select("document_id", "source_id", "input_index", F.size("tokens").alias("n"), "tokens")
    shards = T.next_fit(sizes.drop("tokens"), "n", 20_000, ["source_id"], ["input_index"]).join(sizes.select("document_id", "tokens"), "document_id").withColumn("key", F.concat_ws("/", "source_id", F.col("shard").cast("string")))
    back = writers.read_token_bytes(writers.token_bytes(shards, "tokens", "key", "input_index", width=4), width=4)
    return back.groupBy("shard").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("tokens")).alias("tokens"))


# --- conversations ------------------------------------------------------------------------------------------------

_CHATS = rf"""turns AS (SELECT conv_id, turn, role, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '{_NO_LF}+\n', chr(10), 'g'), '^{_SPACE}+', ''), '{_SPACE}+$', '') AS content FROM conversations),
chats AS MATERIALIZED (SELECT conv_id, list({{'content': content, 'role': role}} ORDER BY turn) AS m, list(role ORDER BY turn) AS roles FROM turns GROUP BY conv_id),
valid AS MATERIALIZED (SELECT * FROM chats WHERE len(m) >= 2 AND len(list_filter(m, lambda x: x.content = '' OR x.role NOT IN ('system', 'user', 'assistant'))) = 0 AND list_contains(roles, 'user') AND roles[-1] = 'assistant' AND len(list_filter(range(2, len(m) + 1), lambda i: roles[i] = roles[i - 1] AND roles[i] <> 'system')) = 0)"""


def _chats(spark, sf_dir) -> DataFrame:
    return C.assembled(table(spark, sf_dir, "conversations"))


def _valid(spark, sf_dir) -> DataFrame:
    return _chats(spark, sf_dir).where(C.is_valid(F.col("messages")))


@query(f"WITH {_CHATS} SELECT conv_id, len(m)::BIGINT AS messages FROM valid")
def valid_conversations(spark, sf_dir):
    return _valid(spark, sf_dir).select("conv_id", F.size("messages").cast("long").alias("messages"))


@query(f"WITH {_CHATS} SELECT conv_id, array_to_string(list_filter(range(len(m)), lambda i: roles[i + 1] = 'assistant'), ',') AS targets, (len(m) - 1)::BIGINT AS final_target FROM valid")
def target_mask(spark, sf_dir):
    m = F.col("messages")
    return _valid(spark, sf_dir).select("conv_id", F.array_join(C.targets(m).cast("array<string>"), ",").alias("targets"), F.get(C.targets(m, True), F.lit(0)).cast("long").alias("final_target"))


@query(f"WITH {_CHATS} SELECT sha256('[' || array_to_string(list_transform(m, lambda x: '{{\"content\":' || to_json(x.content) || ',\"role\":' || to_json(x.role) || '}}'), ',') || ']') AS conversation_id, count(*) AS copies, min(conv_id) AS conv_id FROM valid GROUP BY 1")
def conversation_dedup(spark, sf_dir):
    v = _valid(spark, sf_dir).withColumn("conversation_id", C.conversation_id(F.col("messages")))
    return v.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("copies"), F.min("conv_id").alias("conv_id"))


@query()
def conversation_near_dedup(spark, sf_dir):
    v = stored(_valid(spark, sf_dir).withColumn("targets", C.targets(F.col("messages"))), "chats")
    keyed = v.join(C.near_key(v), "conv_id")
    return C.deduplicated(keyed, "near_key", ["conv_id"]).select("near_key", "conv_id", F.array_join(F.col("targets").cast("array<string>"), ",").alias("targets"))


@query(f"WITH {_CHATS}, j AS (SELECT m, array_to_string(list_transform(m, lambda x: x.content), ' ') AS t FROM valid) SELECT sum((regexp_matches(t, '[\\p{{L}}\\p{{N}}_.+-]+@[\\p{{L}}\\p{{N}}_.-]+\\.[A-Za-z]{{2,}}'))::INT)::BIGINT AS email, sum((regexp_matches(t, '(^|[^0-9])1[3-9][0-9]{{9}}([^0-9]|$)'))::INT)::BIGINT AS phone, sum((length(t) > 100000 OR len(m) > 64)::INT)::BIGINT AS anomalous_length FROM j")
def conversation_alerts(spark, sf_dir):
    return C.alerts(_valid(spark, sf_dir))


@query(f"WITH {_CHATS} SELECT conv_id, (1 + list_sum(list_transform(m, lambda x: 2 + length(x.content))))::BIGINT AS tokens, list_sum(list_transform(m, lambda x: CASE WHEN x.role = 'assistant' THEN 1 + length(x.content) ELSE 0 END))::BIGINT AS targets FROM valid")
def supervised_labels(spark, sf_dir):
    m = F.col("messages")
    pairs = T.supervised(m, C.targets(m), {"system": 5, "user": 6, "assistant": 7}, 8, T.code_points)
    return _valid(spark, sf_dir).select("conv_id", F.size(pairs).cast("long").alias("tokens"), F.size(F.filter(pairs, lambda p: p["label"] != T.IGNORE)).cast("long").alias("targets"))


@query()
def target_windows(spark, sf_dir):
    m = F.col("messages")
    pairs = T.supervised(m, C.targets(m), {"system": 5, "user": 6, "assistant": 7}, 8, T.code_points)
    rows = _valid(spark, sf_dir).select("conv_id", pairs.alias("p")).select("conv_id", F.transform("p", lambda p: p["token"]).alias("tokens"), F.transform("p", lambda p: p["label"]).alias("labels"))
    w = T.windowed_targets(rows, 256, "conv_id")
    return w.select("conv_id", "window", F.size("tokens").alias("length"), F.size(F.filter("labels", lambda x: x != T.IGNORE)).alias("targets"))


@query("SELECT conv_id, turn, role FROM conversations WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def final_assistant_turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return D.first_rows(c.withColumn("back", -F.col("turn")), ["conv_id"], ["back"]).select("conv_id", "turn", "role")


@query("WITH g AS (SELECT a, b FROM range(-9, 13) t(a), range(-9, 13) u(b)), e AS (SELECT a || ' ' || s || ' ' || b AS x, v FROM (SELECT a, b, unnest(['+', '-', '*']) AS s, unnest([a + b, a - b, a * b]) AS v FROM g)) SELECT CASE ('0x' || substr(sha256('arithmetic:' || x), 1, 2))::UBIGINT % 3 WHEN 0 THEN 'What is ' || x || '?' WHEN 1 THEN 'Compute ' || x || '.' ELSE x || ' =' END AS question, v::VARCHAR AS answer FROM e")
def arithmetic_tasks(spark, sf_dir):
    return C.arithmetic(spark, -9, 12, ["What is {}?", "Compute {}.", "{} ="])


# --- metrics ------------------------------------------------------------------------------------------------------

_METRICS = f"{DOCS}, met AS (SELECT document_id, language, content_type, source_id, length(text) AS characters, strlen(text) AS utf8_bytes, greatest(1, strlen(text) // 4) AS tokens, (input_index % 50 = 0)::INT AS unknowns, (input_index % 200 = 0)::INT AS roundtrip_failure FROM docs)"


def _metric_rows(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.select("document_id", "language", "content_type", "source_id", F.length("text").alias("characters"), F.octet_length("text").alias("utf8_bytes"), X.estimated_tokens(F.col("text"), F.col("language")).alias("tokens"), (F.col("input_index") % 50 == 0).cast("int").alias("unknowns"), (F.col("input_index") % 200 == 0).alias("roundtrip_failure"))


@query(f"WITH {_METRICS} SELECT language, content_type, source_id, count(*) AS documents, sum(characters)::BIGINT AS characters, sum(utf8_bytes)::BIGINT AS utf8_bytes, sum(tokens)::BIGINT AS tokens, sum(unknowns)::BIGINT AS unknowns, sum(roundtrip_failure)::BIGINT AS roundtrip_failures, round(sum(characters) / sum(tokens), 6) AS chars_per_token, round(sum(utf8_bytes) / sum(tokens), 6) AS bytes_per_token, round(sum(unknowns) / sum(tokens), 6) AS unknown_rate FROM met GROUP BY GROUPING SETS ((), (language), (content_type), (source_id))")
def compression_metrics(spark, sf_dir):
    return M.compression(_metric_rows(spark, sf_dir), ["language", "content_type", "source_id"])


@query(f"WITH {_METRICS} SELECT language, round(quantile_cont(characters / tokens, 0.05), 6) AS p05, round(quantile_cont(characters / tokens, 0.5), 6) AS p50, round(quantile_cont(characters / tokens, 0.95), 6) AS p95 FROM met GROUP BY language")
def percentiles(spark, sf_dir):
    return M.percentiles(_metric_rows(spark, sf_dir), F.col("characters") / F.col("tokens"), ["language"])


@query()
def bootstrap_interval(spark, sf_dir):
    return M.bootstrap(_metric_rows(spark, sf_dir), "characters", "tokens", "source_id", 2000)


@query(f"WITH {_METRICS} SELECT 'language' AS dimension, language AS value, count(*) AS documents, sum(tokens)::BIGINT AS tokens FROM met GROUP BY ALL UNION ALL SELECT 'content_type', content_type, count(*), sum(tokens)::BIGINT FROM met GROUP BY ALL UNION ALL SELECT 'source_id', source_id, count(*), sum(tokens)::BIGINT FROM met GROUP BY ALL")
def counts_by_dimension(spark, sf_dir):
    return M.counts_by(_metric_rows(spark, sf_dir), ["language", "content_type", "source_id"], F.col("tokens"))


@query(f"WITH {DOCS} SELECT source_id || '|' || language || '|' || content_type AS stratum, count(*) AS documents FROM docs GROUP BY ALL")
def strata_counts(spark, sf_dir):
    return documents(spark, sf_dir).groupBy(F.concat_ws("|", "source_id", "language", "content_type").alias("stratum")).agg(F.count(F.lit(1)).alias("documents"))


@query(f"WITH {DOCS} SELECT language, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM docs GROUP BY language")
def language_shares(spark, sf_dir):
    return M.shares(documents(spark, sf_dir), "language")


_SCORES = "sc AS (SELECT p_partkey, p_brand, (p_partkey % 4)::INT AS answer, [-(p_size % 7)::DOUBLE, -(p_partkey % 5)::DOUBLE, -(p_size % 3)::DOUBLE, -(p_partkey % 11)::DOUBLE] AS s, [1.0, 2.0, 3.0, 1.0] AS n FROM part), best AS (SELECT *, list_position(s, list_max(s)) - 1 AS b, list_position(list_transform(range(1, 5), lambda i: s[i] / n[i]), list_max(list_transform(range(1, 5), lambda i: s[i] / n[i]))) - 1 AS bn FROM sc)"


@query(f"WITH {_SCORES} SELECT p_brand, count(*) AS tasks, round(avg((b = answer)::INT), 6) AS accuracy, round(avg((bn = answer)::INT), 6) AS normalized, 0.25 AS chance FROM best GROUP BY p_brand")
def choice_accuracy(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    d = lambda c, k: -(F.col(c) % k).cast("double")
    rows = p.select("p_brand", (F.col("p_partkey") % 4).cast("int").alias("answer"), F.array(d("p_size", 7), d("p_partkey", 5), d("p_size", 3), d("p_partkey", 11)).alias("s"), F.array(*map(F.lit, (1.0, 2.0, 3.0, 1.0))).alias("n"))
    return M.accuracy(rows, ["p_brand"], "answer", "s", "n")


@query("SELECT l_returnflag, sum(l_quantity)::BIGINT AS targets, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS loss, round(exp(sum(l_discount * l_quantity) / sum(l_quantity)), 6) AS perplexity FROM lineitem GROUP BY l_returnflag")
def weighted_loss(spark, sf_dir):
    return M.weighted_loss(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity").withColumn("targets", F.col("targets").cast("long"))


@query(f"WITH {_METRICS}, o AS (SELECT tokens, row_number() OVER (ORDER BY document_id) - 1 AS k FROM met) SELECT (k // 24)::BIGINT AS step, sum(tokens)::BIGINT AS targets FROM o GROUP BY k // 24")
def targets_per_step(spark, sf_dir):
    rows = _metric_rows(spark, sf_dir).select("document_id", "tokens").orderBy("document_id")
    placed = T.global_offsets(_ranked(rows, "document_id"), F.lit(1).cast("long"), "r")
    return M.targets_per_step(placed, "token_offset", "tokens", 24)


def _ranked(df: DataFrame, order: str) -> DataFrame:
    """df with r: the rank by a unique string column, from two-level counts by its last hexadecimal digits' range."""
    # ids end in a uniform hash: their first digits cut them into even ranges
    part = F.conv(F.substring(order, 5, 3), 16, 10).cast("int")
    rows = df.withColumn("_p", part)
    before = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).withColumn("_b", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return rows.join(before, "_p").withColumn("r", F.col("_b") + F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1).drop("_p", "_b")


@query("SELECT step, CASE WHEN step < 100 THEN (step + 1) / 100.0 WHEN step < 800 THEN 1.0 ELSE 1 - 0.9 * (step - 800) / 199.0 END AS multiplier FROM range(1000) t(step)")
def learning_rates(spark, sf_dir):
    return M.schedule(spark.range(1000).withColumnRenamed("id", "step"), "trapezoidal", 1000, 100, 200).withColumn("multiplier", F.col("multiplier").cast("double"))


@query("SELECT event_id, round(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)), 3) AS seconds, round(value - lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id), 6) AS change FROM events")
def event_deltas(spark, sf_dir):
    # the tables' times have no zone
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    out = M.deltas(e, ["user_id", "event_type"], "at", "value", ties=("event_id",))
    return out.select("event_id", F.round("seconds", 3).alias("seconds"), F.round("change", 6).alias("change"))


@query("SELECT l.l_returnflag, l.l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem l GROUP BY ALL")
def pricing_summary(spark, sf_dir):
    """A check of plain aggregation over the relational tables."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL")
def orders_by_nation(spark, sf_dir):
    """A check of joins over the relational tables."""
    o, c, n, r = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation", "region"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# --- audits and gates ---------------------------------------------------------------------------------------------


@query(f"WITH {DOCS}, b AS (SELECT sum((length(text) NOT BETWEEN 50 AND 30000)::INT) AS a, sum((content_type NOT IN ('general','encyclopedia','science','math'))::INT) AS c, sum((trim(text) = '')::INT) AS t, count(*) - count(DISTINCT document_id) AS i, count(*) - count(DISTINCT text) AS d FROM docs) SELECT unnest(['length_bounds','content_type','blank_text','unique_ids','unique_texts']) AS name, unnest([a = 0, c = 0, t = 0, i = 0, d = 0]) AS passed, unnest([a, c, t, i, d])::VARCHAR AS detail FROM b")
def corpus_audit(spark, sf_dir):
    return G.corpus_audit(documents(spark, sf_dir), 50, 30_000, ["general", "encyclopedia", "science", "math"])


@query(f"WITH {DOCS}, s AS (SELECT source_id, sum(strlen(text))::BIGINT AS amount FROM docs GROUP BY source_id) SELECT source_id, amount, round(amount / sum(amount) OVER (), 6) AS share, amount / sum(amount) OVER () <= 0.055 AS passed FROM s")
def source_ceiling(spark, sf_dir):
    return G.share_limit(documents(spark, sf_dir), "source_id", F.octet_length("text").cast("long"), 0.055)


@query(f"WITH {DOCS} SELECT 'overlap' AS name, count(*) = 0 AS passed, count(*)::VARCHAR AS detail FROM (SELECT text FROM docs WHERE input_index % 2 = 0 INTERSECT SELECT text FROM docs WHERE input_index % 2 = 1)")
def split_disjoint(spark, sf_dir):
    d = documents(spark, sf_dir)
    return G.disjoint(d.where("input_index % 2 = 0"), d.where("input_index % 2 = 1"), "text", "overlap")


@query(f"WITH {DOCS} SELECT DISTINCT content_type FROM docs WHERE content_type NOT IN (SELECT content_type FROM docs WHERE input_index % 5 < 3)")
def uncovered_types(spark, sf_dir):
    d = documents(spark, sf_dir)
    return G.covered(d, d.where("input_index % 5 < 3"), "content_type")


@query("WITH e AS (SELECT 'f' || doc_id AS path, n_chars AS want FROM documents WHERE doc_id % 3 <> 0), a AS (SELECT 'f' || doc_id AS path, n_chars + (doc_id % 10 = 1)::INT AS have FROM documents WHERE doc_id % 5 <> 0) SELECT path, CASE WHEN have IS NULL THEN 'missing' WHEN want IS NULL THEN 'extra' WHEN want <> have THEN 'size_mismatch' ELSE 'ok' END AS state FROM e FULL JOIN a USING (path)")
def file_states(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("path", F.concat(F.lit("f"), "doc_id"))
    e = d.where("doc_id % 3 <> 0").select("path", F.col("n_chars").alias("size"))
    a = d.where("doc_id % 5 <> 0").select("path", (F.col("n_chars") + (F.col("doc_id") % 10 == 1).cast("int")).alias("size"))
    return G.file_states(e, a)


@query("WITH s AS (SELECT o_orderkey AS step, 5.0 - o_orderkey / 1e6 AS loss FROM orders), e AS (SELECT min(step) AS lo, max(step) AS hi FROM s) SELECT unnest(['contiguous', 'finite', 'not_rising']) AS name, unnest([c, true, r <= 1.02]) AS passed, unnest([n::VARCHAR, '0', r::VARCHAR]) AS detail FROM (SELECT count(*) = max(hi) - max(lo) + 1 AS c, count(*) AS n, round(avg(CASE WHEN step > hi - 5 THEN loss END) / avg(CASE WHEN step < lo + 5 THEN loss END), 6) AS r FROM s, e)")
def smoke_gate(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step"), (5.0 - F.col("o_orderkey") / 1e6).alias("loss"))
    return G.smoke(s, "step", "loss")


@query(f"WITH {_METRICS}, g AS (SELECT language, sum(tokens) AS s, sum(utf8_bytes) // 5 AS l FROM met GROUP BY language) SELECT unnest(['same_groups', 'reduction', 'no_regression']) AS name, unnest([true, 1 - sum(l) / sum(s) >= 0.1, max((l > s)::INT) = 0]) AS passed, unnest([count(*)::VARCHAR, round(1 - sum(l) / sum(s), 6)::VARCHAR, sum((l > s)::INT)::VARCHAR]) AS detail FROM g")
def vocabulary_gate(spark, sf_dir):
    m = _metric_rows(spark, sf_dir).groupBy("language").agg(F.sum("tokens").alias("s"), F.floor(F.sum("utf8_bytes") / 5).alias("l"))
    return G.vocabulary_choice(m.select("language", F.col("s").alias("tokens")), m.select("language", F.col("l").alias("tokens")), "language")


@query(f"WITH {DOCS} SELECT 'all' AS source_id, count(*) AS record_count, sum(length(text))::BIGINT AS characters, sum(strlen(text))::BIGINT AS utf8_bytes, min(sha256(document_id)) AS least_digest, max(sha256(document_id)) AS greatest_digest FROM docs")
def dataset_manifest(spark, sf_dir):
    return G.manifest(documents(spark, sf_dir), "all")


@query(f"WITH {DOCS} SELECT 'acquired' AS stage, count(*) AS rows FROM docs UNION ALL SELECT 'exact', count(DISTINCT text) FROM docs")
def lineage_counts(spark, sf_dir):
    d = documents(spark, sf_dir)
    return G.same_counts([("acquired", d), ("exact", D.exact_representatives(d))])


# --- sources and whole pipelines ----------------------------------------------------------------------------------

_SOURCE = readers.Source("corpus-x", "en", "general", id_field="doc_id", min_chars=300, max_chars=5000, score_field="score", min_score=0.4, excluded_flags=("toxic",))


@query(rf"WITH j AS (SELECT d.doc_id, regexp_replace(regexp_replace(text, '^{_SPACE}+', ''), '{_SPACE}+$', '') AS t, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT 'doc-' || sha256('corpus-x' || chr(0) || 'corpus-x:' || doc_id) AS document_id, length(t)::BIGINT AS n FROM j WHERE coalesce(toxic, 0) = 0 AND coalesce(quality, -1) >= 0.4 AND length(t) BETWEEN 300 AND 5000")
def source_acceptance(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("score"), (F.col("toxic") == 1).alias("toxic"))
    rows = readers.accepted(table(spark, sf_dir, "documents").join(lab, "doc_id", "left"), _SOURCE)
    return readers.to_documents(rows.withColumn("text", F.col("accepted_text")), _SOURCE).select("document_id", F.length("text").cast("long").alias("n"))


@query("WITH r AS (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) SELECT source, min(CASE WHEN length(text) >= 3000 THEN k END) AS position FROM r WHERE k <= 20 GROUP BY source")
def first_accepted(spark, sf_dir):
    return readers.first_accepted(table(spark, sf_dir, "documents"), "source", ["doc_id"], F.length("text") >= 3000, 20).withColumn("position", F.col("position").cast("long"))


@query()
def small_pipeline(spark, sf_dir):
    return pipelines.small_pipeline(documents(spark, sf_dir))


@query()
def large_pipeline(spark, sf_dir):
    return pipelines.large_pipeline(documents(spark, sf_dir))


# --- further gates and metrics ------------------------------------------------------------------------------------


@query("SELECT user_id, count(*) AS rows, coalesce(sum((value < before)::INT), 0)::BIGINT AS breaks FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY user_id")
def order_breaks(spark, sf_dir):
    return G.order_breaks(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")


@query("WITH s AS (SELECT lang, source, count(*) / sum(count(*)) OVER (PARTITION BY lang) AS share FROM documents GROUP BY lang, source), c AS (SELECT lang, share FROM s WHERE lang <> 'en' OR source <> 'src1') SELECT lang, round(sum(share), 9) AS total, abs(sum(share) - 1) <= 1e-9 AS complete FROM c GROUP BY lang")
def share_sums(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("lang", "source").count()
    shares = counts.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy("lang"))).where("lang <> 'en' OR source <> 'src1'")
    return G.share_sums(shares, ["lang"], "share")


@query("SELECT lang, round(sum(length(text)) / sum(len(regexp_extract_all(text, '[^ \\n]+'))), 6) AS ratio, CASE lang WHEN 'en' THEN 5.0 ELSE 6.5 END AS least, round(sum(length(text)) / sum(len(regexp_extract_all(text, '[^ \\n]+'))), 6) >= CASE lang WHEN 'en' THEN 5.0 ELSE 6.5 END AS passed FROM documents GROUP BY lang")
def compression_gate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("lang").agg(F.round(F.sum(F.length("text")) / F.sum(F.regexp_count("text", F.lit(r"[^ \n]+"))), 6).alias("ratio"))
    return G.least_ratio_gate(d, "lang", "ratio", {"en": 5.0}, 6.5)


@query(f"WITH {_SCORES}, b AS (SELECT p_brand, count(*) AS tasks, round(avg((b = answer)::INT), 6) AS accuracy, 0.25 AS chance FROM best GROUP BY p_brand), a AS (SELECT * FROM b UNION ALL SELECT 'all', sum(tasks)::BIGINT, sum(accuracy * tasks) / sum(tasks), sum(chance * tasks) / sum(tasks) FROM b) SELECT p_brand, tasks, round(accuracy, 6) AS accuracy, round(chance, 6) AS chance, accuracy >= chance + 0.01 AS passed FROM a")
def benchmark_gate(spark, sf_dir):
    return G.above_chance(choice_accuracy(spark, sf_dir), "p_brand", 0.01)


@query("WITH s AS (SELECT lang, source, sum(strlen(text)) AS own FROM documents GROUP BY lang, source) SELECT lang, sum(own)::BIGINT AS size, CASE lang WHEN 'en' THEN 100000 WHEN 'fr' THEN 100000000000 END AS target, max(own)::BIGINT AS largest, coalesce(sum(own) >= CASE lang WHEN 'en' THEN 100000 WHEN 'fr' THEN 100000000000 END, false) AS reached, max(own) <= sum(own) * 0.3 AS capped FROM s GROUP BY lang")
def distribution_gate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("size", F.octet_length("text"))
    return G.distribution_gate(d, "lang", "source", "size", {"en": 100_000, "fr": 100_000_000_000}, 0.3)


@query("WITH p AS (SELECT l_orderkey AS a, unnest([l_partkey, l_suppkey]) AS b FROM lineitem WHERE l_quantity > 45) SELECT count(*) AS pairs, (SELECT count(*) FROM (SELECT a FROM p UNION SELECT b FROM p)) AS documents FROM p")
def candidate_counts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_quantity > 45")
    return M.candidate_counts(li.select(F.col("l_orderkey").alias("a"), F.explode(F.array("l_partkey", "l_suppkey")).alias("b")))


@query("SELECT l_linestatus, l_returnflag, count(*) AS tasks, round(avg((l_linenumber % 3 = l_partkey % 3)::INT), 6) AS accuracy FROM lineitem GROUP BY ALL")
def accuracy_by_split(spark, sf_dir):
    right = (F.col("l_linenumber") % 3 == F.col("l_partkey") % 3)
    return M.accuracy_by(table(spark, sf_dir, "lineitem").withColumn("right", right), ["l_linestatus", "l_returnflag"], "right")


@query(f"WITH {DOCS} SELECT DISTINCT source_id, content_type, row_number() OVER (ORDER BY CASE content_type WHEN 'encyclopedia' THEN 0 WHEN 'science' THEN 1 WHEN 'general' THEN 2 ELSE 3 END, source_id, content_type) AS place FROM (SELECT DISTINCT source_id, content_type FROM docs)")
def source_priority(spark, sf_dir):
    kinds = documents(spark, sf_dir).select("source_id", "content_type").distinct()
    return S.by_priority(kinds, "content_type", ["encyclopedia", "science", "general"], ["source_id", "content_type"])


@query("SELECT page_id, url LIKE '%.org/%' OR url LIKE 'https://%7%' AS matched FROM pages")
def glob_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.matches_glob(F.col("url"), ["*.org/*", "https://*7*"]).alias("matched"))
