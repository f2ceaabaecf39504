"""Operators of the library on small inputs of our own; the registered queries are compared with their SQL in test_queries.py."""

import hashlib
import io
import json
import math
import random
import tarfile
import unicodedata
from collections import defaultdict

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from corpusloom import schema
from corpusloom.functions import hashing as H
from corpusloom.functions import text as X
from corpusloom.operators import conversations as C
from corpusloom.operators import dedup as D
from corpusloom.operators import gates as G
from corpusloom.operators import metrics as M
from corpusloom.operators import sampling as S
from corpusloom.operators import splitting as P
from corpusloom.operators import tokens as T
from corpusloom.operators.graph import connected
from corpusloom.sources import readers, writers
from corpusloom.streaming import ingest


def one(df, column):
    return df.select(column.alias("x")).head()["x"]


def docs(spark, texts):
    rows = [(1, f"doc-{i}", "s", str(i), t, "en", "general", [], [], "{}", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "schema_version int, document_id string, source_id string, source_record_id string, text string, language string, content_type string, privacy_warnings array<string>, quality_warnings array<string>, metadata string, input_index long")


def test_normalisation_and_its_labels(spark):
    raw = "  café \t\r\n\r\n\r\nsecond \x1c\r third  "
    df = spark.createDataFrame([(raw,), ("plain",), (None,)], "text string")
    rows = X.normalize(df).collect()
    assert rows[0]["clean_text"] == "café\n\nsecond\n third" and rows[0]["changes"] == list(X.CHANGES)
    assert rows[1]["changes"] == [] and rows[2]["clean_text"] is None
    again = X.normalize(spark.createDataFrame([(rows[0]["clean_text"],)], "text string")).head()
    assert again["changes"] == []


def test_warnings_in_order(spark):
    df = spark.createDataFrame([("a" * 20 + "�", "zh"), ("\n".join(["one line of twenty characters"] * 6) * 2, "en"), ("x y " * 60, "en")], "text string, language string")
    got = [r["w"] for r in df.select(X.quality_warnings(F.col("text"), F.col("language")).alias("w")).collect()]
    assert got == [["too_short", "decode_replacement", "high_repetition", "low_language_confidence"], ["high_repetition"], []]


def test_small_functions(spark):
    df = spark.createDataFrame([("mail a.b@c.org or 13912345678", " -12 ", "4 2 。")], "t string, n string, a string")
    assert one(df, X.has_email(F.col("t"))) and one(df, X.has_phone(F.col("t")))
    assert one(df, X.strict_integer(F.col("n"))) == -12 and one(df, X.strict_integer(F.col("a"))) is None
    assert one(df, X.bare_answer(F.col("a"))) == "42"
    assert one(df, X.meets(F.lit("The Answer"), F.lit("contains"), F.array(F.lit("answer")))) is True
    han, tra = {"体": "體"}, {"體": "体"}
    got = df.select(*(X.script_class(F.lit(t), han, tra).alias(k) for k, t in (("a", "体"), ("b", "體"), ("c", "x")))).head()
    assert tuple(got) == ("zh-Hans", "zh-Hant", "zh")
    assert one(df, X.folded(F.lit("Straße"))) == unicodedata.normalize("NFKC", "Straße").casefold()


def test_contract(spark):
    df = docs(spark, ["x", " "])
    assert {(r[0], r[1]) for r in schema.violations(df).collect()} == {("doc-0", "document_id"), ("doc-1", "document_id"), ("doc-1", "text")}
    line = schema.json_line(df).head()["value"]
    assert list(json.loads(line)) == sorted(json.loads(line))


def test_basis_points_and_thresholds(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    got = {r["k"]: r["p"] for r in df.select("k", H.basis_points("seed", F.col("k")).alias("p")).collect()}
    assert all(p == int(hashlib.sha256(f"seed:{k}".encode()).hexdigest()[:16], 16) % 10_000 for k, p in got.items())
    small, large = ({r["k"] for r in S.by_ratio(df, F.col("k"), "v", r).collect()} for r in (0.1, 0.4))
    assert small < large and 600 < len(large) < 1000


def test_near_cluster(spark):
    base = [f"sentence number {i} of a longer text" for i in range(100)]
    df = docs(spark, [" ".join(base), " ".join([*base[:50], "an edit", *base[51:]]), "something else entirely " * 30])
    pairs = D.near_pairs(D.fingerprints(df)).collect()
    assert [(r["a"], r["b"]) for r in pairs] == [("doc-0", "doc-1")] and pairs[0]["similarity"] >= 0.9
    assert D.clusters_of(D.near_pairs(D.fingerprints(df))).head()["members"] == ["doc-0", "doc-1"]


@pytest.mark.parametrize(("threshold", "crowd", "mass"), [(0.9, 64, 4096), (0.5, 64, 4096), (0.5, 2, 4096), (0.5, 2, 5)])
def test_near_pairs_are_those_of_bands(spark, monkeypatch, threshold, crowd, mass):
    monkeypatch.setattr(D, "CROWD", crowd)
    monkeypatch.setattr(D, "MASS", mass)
    draw = random.Random(5)
    sentence = lambda: "".join(draw.choices("abcdefghij", k=40))
    common, texts = [sentence() for _ in range(6)], []
    for _ in range(12):
        own = [sentence() for _ in range(30)]
        texts += [" ".join([*common, *own[:k], sentence(), *own[k + 1 :]]) for k in range(0, 30, 4)] + [" ".join(own[: 20 + k] + common) for k in range(0, 10, 3)]
    prints = D.fingerprints(docs(spark, [*texts, "", "short"])).cache()
    sets = {r["document_id"]: set(r["shingles"]) for r in prints.collect()}
    pairs = [(r["a"], r["b"]) for r in D.band_pairs(prints).collect()]
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in pairs}
    got = [((r["a"], r["b"]), r["similarity"]) for r in D.near_pairs(prints, threshold).collect()]
    assert sorted(got) == sorted((k, round(v, 6)) for k, v in want.items() if v >= threshold)
    assert len(got) > 10


def test_near_pairs_of_unlike_texts_are_not_listed(spark):
    prints = D.fingerprints(docs(spark, [f"text {i:05}" for i in range(3000)])).cache()
    assert prints.count() == 3000
    executors = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(executors.executorList(False).apply(k).totalShuffleWrite() for k in range(executors.executorList(False).size()))
    before = written()
    assert D.near_pairs(prints).count() == 0
    assert written() - before < 100 * 3000


def test_rolling_hash_and_fallback():
    text = "".join(chr(97 + (i * i) % 26) for i in range(200))
    want = set()
    for i in range(len(text) - 23):
        h = 0
        for c in text[i : i + 24]:
            h = (h * 1_000_003 + ord(c)) % 2**64
        if h % 16 == 0:
            want.add(h)
    assert set(map(int, D.shingles_of(text))) == want
    assert len(D.shingles_of("short")) == 1 and len(D.shingles_of("")) == 1
    assert D.simhash_of(D.shingles_of("x")) == int(D.shingles_of("x")[0])


def test_components_of_a_long_chain(spark):
    links = spark.range(60).select(F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("a"), F.concat(F.lit("n"), F.lpad((F.col("id") + 1).cast("string"), 3, "0")).alias("b"))
    assert {r["comp"] for r in connected(links).collect()} == {"n000"}


def test_split_counts_and_leaks(spark):
    assert P.target_counts(100) == {"train": 98, "validation": 1, "test": 1}
    df = docs(spark, [f"t{i}" for i in range(300)])
    comp = spark.createDataFrame([(f"doc-{i}", "doc-0") for i in range(12)], "node string, comp string")
    out = P.assign(df, comp)
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 294, "validation": 3, "test": 3}
    assert out.where("group_key = 'doc-0' AND split <> 'train'").count() == 0  # larger than any quota
    assert P.leaks(out).count() == 0


def test_quotas():
    assert S.carried_targets([("a", 4), ("b", 100)], {"a": 12, "b": 12}) == [("a", 12, 4), ("b", 20, 20)]
    assert S.redistributed({"a": 300, "b": 900}, {"a": 800, "b": 100}, ["b"], 800) == {"a": 300, "b": 600}
    with pytest.raises(ValueError):
        S.redistributed({"a": 1, "b": 1}, {"a": 5, "b": 0}, ["b"], 9)


def test_overlapping_rules_are_an_error(spark):
    rule = {"source_ids": ["s"], "content_types": ["general"], "languages": ["en"], "basis_points": 10_000}
    with pytest.raises(Exception, match="overlapping rules"):
        S.by_rules(docs(spark, ["x"]), [rule | {"name": "a"}, rule | {"name": "b"}], "seed").collect()


def test_packing_segments_and_fragments(spark):
    df = spark.createDataFrame([(i, [2, 4 + i, 14, 3]) for i in range(10)] + [(10, [])], "i long, t array<int>")
    for parts in (1, 7):
        blocks = T.packed_blocks(df.repartition(parts), "t", 4, "i").orderBy("block_id").collect()
        assert len(blocks) == 10 and blocks[0]["tokens"] == [2, 4, 14, 3]
    assert len(T.packed_blocks(df, "t", 7, "i").collect()) == 5
    assert one(df, T.segments(F.array(*map(F.lit, [2, 5, 2, 6, 0])))) == [1, 1, 2, 2, 0]
    f = one(df.limit(1), T.fragments(F.array(*map(F.lit, range(1, 8))), F.array(*map(F.lit, range(1, 8))), 3))
    assert [(x["start"], x["tokens"], x["labels"]) for x in f] == [(0, [1, 2, 3], [1, 2, 3]), (2, [3, 4, 5], [-100, 4, 5]), (4, [5, 6, 7], [-100, 6, 7])]


def test_target_windows_keep_each_target_once():
    tokens = [2, *range(10, 60)]
    labels = [-100] * 5 + tokens[5:30] + [-100] * 10 + tokens[40:]
    windows = T.target_windows(tokens, labels, 8)
    assert [y for _, w in windows for y in w if y != -100] == [y for y in labels if y != -100]
    assert all(len(t) <= 8 and t[0] == 2 for t, _ in windows)
    assert T.target_windows(tokens, labels, 100) == [(tokens, labels)]


def test_token_bytes_round_trip(spark):
    df = spark.createDataFrame([(0, 0, [2, 5, 3]), (0, 1, [2, 3]), (1, 2, [2, 65535, 3])], "shard long, i long, tokens array<int>")
    back = writers.read_token_bytes(writers.token_bytes(df, "tokens", "shard", "i")).orderBy("shard", "document").collect()
    assert [r["tokens"] for r in back] == [[2, 5, 3], [2, 3], [2, 65535, 3]]


def test_wide_token_ids(spark):
    df = spark.createDataFrame([("x", 0, [65_535, 65_536]), ("x", 1, []), ("x", 2, [2**32 - 1])], "shard string, i long, tokens array<bigint>")
    back = writers.read_token_bytes(writers.token_bytes(df, "tokens", "shard", "i", width=4), width=4).orderBy("document").collect()
    assert [list(r["tokens"]) for r in back] == [[65_535, 65_536], [], [2**32 - 1]]
    with pytest.raises(PythonException, match="do not fit"):
        writers.token_bytes(df, "tokens", "shard", "i").collect()


def test_conversations(spark):
    def valid(*roles, text="x"):
        df = spark.createDataFrame([(1, k, r, text) for k, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
        return one(C.assembled(df), C.is_valid(F.col("messages")))

    assert valid("user", "assistant") and valid("system", "system", "user", "assistant")
    assert not valid("user", "user", "assistant") and not valid("user") and not valid("assistant", "user") and not valid("user", "assistant", text=" ") and not valid("tool", "assistant")


def test_near_key_ignores_format_only(spark):
    rows = [(i, k, r, t) for i, t in enumerate(["Hello, WORLD!", "hello world", "4 + 1", "4 / 1"]) for k, r in enumerate(["user"])] + [(9, 0, "assistant", "hello world")]
    keys = {r["conv_id"]: r["near_key"] for r in C.near_key(C.assembled(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert keys[0] == keys[1] != keys[9] and keys[2] != keys[3]


def test_reply_trees(spark):
    rows = [("r", None, "prompter", 0), ("a", "r", "assistant", 1), ("b", "r", "assistant", 0), ("c", "b", "prompter", None), ("d", "c", "assistant", 2), ("e", "c", "assistant", None), ("z", "zz", "assistant", 0)]
    df = spark.createDataFrame([(m, p, "t", m.upper(), role, False, None, "ready_for_export", rank) for m, p, role, rank in rows], "message_id string, parent_id string, message_tree_id string, text string, role string, deleted boolean, review_result boolean, tree_state string, rank int")
    best = C.best_paths(df).collect()
    assert [[m["content"] for m in r["messages"]] for r in best] == [["R", "B", "C", "D"]]
    paths = {r["message_id"]: [m["content"] for m in r["messages"]] for r in C.reply_paths(df).collect()}
    assert paths == {"a": ["R", "A"], "b": ["R", "B"], "d": ["R", "B", "C", "D"], "e": ["R", "B", "C", "E"]}


def test_gates_and_metrics(spark):
    df = spark.createDataFrame([(i, 5.0 - i / 10) for i in range(20)], "step long, loss double")
    assert all(r["passed"] for r in G.smoke(df, "step", "loss").collect())
    assert not all(r["passed"] for r in G.smoke(df.where("step <> 7"), "step", "loss").collect())
    rates = [r["multiplier"] for r in M.schedule(df, "cosine", 20, 5).orderBy("step").collect()]
    assert rates[4] == 1.0 and abs(rates[-1] - 0.1) < 1e-9
    assert one(df.limit(1), M.best_choice(F.array(*map(F.lit, [1.0, 3.0, 3.0])))) == 1
    assert G.version_id({"b": 1, "a": 2}) == G.version_id({"a": 2, "b": 1})


def test_readers(spark, tmp_path):
    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as tar:
        data = json.dumps([{"q": 1}, {"q": 2}]).encode()
        info = tarfile.TarInfo("m.json")
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))
    assert [json.loads(r["value"])["q"] for r in readers.read_archived_json(spark, str(tmp_path)).collect()] == [1, 2]
    files = readers.inventory(spark, str(tmp_path), "*.gz")
    assert files.count() == 1 and readers.unmatched_files(files.select("path", F.lit("0").alias("sha256")), files).count() == 1
    source = readers.Source("s", "en", "general", min_chars=2, max_chars=5, score_field="score", min_score=0.5, excluded_flags=("bad",))
    rows = spark.createDataFrame([(" abc ", "0.7", False), ("abc", "x", False), ("abc", None, False), ("abcdef", "0.9", False), ("abc", "0.9", True), (None, "1", False)], "text string, score string, bad boolean")
    assert [r["accepted_text"] for r in readers.accepted(rows, source).collect()] == ["abc"]
    out = str(tmp_path / "out")
    canonical = schema.rekeyed(docs(spark, ["x", "y"]))
    writers.write_documents(canonical, out, 1)
    assert readers.read_documents(spark, out).count() == 2


def test_streaming_resumes(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    df = spark.createDataFrame([("a",), ("a ",), ("b",)], "text string")
    df.write.parquet(src)
    for k in range(2):
        ingest.run_to_end(ingest.without_seen(ingest.stream_files(spark, src, "text string")), out, check)
        assert spark.read.parquet(out).count() == 2 + k
        spark.createDataFrame([("b",), ("c",)], "text string").write.mode("append").parquet(src)


def test_retries():
    waits, tries = [], iter([OSError, OSError, None])

    def action():
        if (e := next(tries)) is not None:
            raise e
        return 7

    assert ingest.with_retries(action, sleep=waits.append) == 7 and waits == [5.0, 10.0]


def stratified_interval(rows, resamples, rnd):
    groups = defaultdict(list)
    for _, s, x, y in rows:
        groups[s].append((x, y))
    ratios = []
    for _ in range(resamples):
        drawn = [p for g in groups.values() for p in rnd.choices(g, k=len(g))]
        ratios.append(sum(x for x, _ in drawn) / sum(y for _, y in drawn))
    ratios.sort()
    at = lambda q: (lambda p: ratios[math.floor(p)] * (1 - p % 1) + ratios[math.ceil(p)] * (p % 1))(q * (resamples - 1))
    return at(0.025), at(0.975)


@pytest.mark.parametrize("block", [16, 4096])
def test_bootstrap_within_strata(spark, block):
    rnd = random.Random(12)
    rows = [(f"d{i:04}", s, rnd.randint(90, 110) * level, 100) for i, (s, level) in enumerate([("hot", 1)] * 300 + [("rare", 9)] * 40 + [("one", 50), (None, 20)])]
    schema = "document_id string, source_id string, characters long, tokens long"
    got = M.bootstrap(spark.createDataFrame(rows, schema), "characters", "tokens", "source_id", 2000, block=block).first()
    low, high = stratified_interval(rows, 2000, random.Random(13))
    assert abs(got["low"] - low) < 0.1 * (high - low) and abs(got["high"] - high) < 0.1 * (high - low)
    # equal documents in each source: every resample has the same sums
    even = [(i, s, {"hot": 100, "rare": 900}.get(s, 5000), 100) for i, s, _, _ in rows]
    got = M.bootstrap(spark.createDataFrame(even, schema), "characters", "tokens", "source_id", 50, block=block).first()
    assert got["low"] == got["high"] == sum(r[2] for r in even) / sum(r[3] for r in even)
    assert M.bootstrap(spark.createDataFrame([], schema), "characters", "tokens", "source_id", 5, block=block).first()["low"] is None


def test_permutation_of_any_size(spark):
    for n in (1, 2, 3, 7, 100, 1023):
        rows = S.permuted(spark.range(n).withColumnRenamed("id", "position"), n, 5, 1).orderBy("position").collect()
        assert sorted(r["dataset_index"] for r in rows) == list(range(n))
    one = [r[1] for r in S.permuted(spark.range(50).withColumnRenamed("id", "position"), 50, 5, 1).orderBy("position").collect()]
    other = [r[1] for r in S.permuted(spark.range(50).withColumnRenamed("id", "position"), 50, 5, 2).orderBy("position").collect()]
    assert one != other and one != list(range(50))


def test_target_counts_lack_nothing():
    for n in range(60):
        counts = P.target_counts(n, {"a": 0.5, "b": 0.25, "c": 0.25})
        assert sum(counts.values()) == n and all(abs(c - n * r) < 1 for c, r in zip(counts.values(), (0.5, 0.25, 0.25), strict=True))
    assert P.target_counts(1, {"a": 0.5, "b": 0.5}) == {"a": 1, "b": 0}


def test_repetition_over_its_upper_budget_is_an_error(spark):
    rows = spark.createDataFrame([(1, 10), (2, 30)], "block int, n int")
    assert [(r["epoch"], r["block"], r["running"]) for r in S.repeated_until(rows, 45, 60, "block", "n").orderBy("running").collect()] == [(0, 1, 10), (0, 2, 40), (1, 1, 50)]
    with pytest.raises(Exception, match="upper budget"):
        S.repeated_until(rows, 45, 49, "block", "n").collect()


def test_discarded_tables_are_gone(spark, tmp_path):
    from corpusloom.storage import discard, recorded, stored

    paths = []
    with recorded(paths):
        held = stored(spark.range(3).toDF("x"), "three")
    assert paths == [held._stored_path] and held.count() == 3
    discard(held)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.schema("x long").parquet(paths[0]).count()


def test_small_pipeline_writes_no_texts(spark, monkeypatch):
    from corpusloom import catalog
    from corpusloom.operators import splitting
    from corpusloom.plans import pipelines

    docs_ = catalog.documents(spark, "/root/testdata/sf0.001")
    clean = pipelines.cleaned(docs_).cache()
    exact = D.exact_clusters(clean).select(F.explode("members").alias("b"), F.col("representative").alias("a")).where("a <> b")
    prints = D.fingerprints(clean.join(D.exact_representatives(clean).select("document_id"), "document_id", "left_semi")).cache()
    want = splitting.assign(clean, D.near_components(exact.select("a", "b").unionByName(D.near_pairs(prints).select("a", "b"))))
    written, keep = [], pipelines.stored
    monkeypatch.setattr(pipelines, "stored", lambda df, name: written.append(df.columns) or keep(df, name))
    got = pipelines.small_pipeline(docs_)
    assert exact.count() and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert written and not any("text" in columns for columns in written)
