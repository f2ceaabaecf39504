"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from corpusloom.llm import bpe, chat, language_id, line_dedup, media, mixing, ngram_join, quality, substring, token_counts  # noqa: E402
from corpusloom.llm.fm_index import repeated_windows  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def corpus(seed=1, n=60):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 6))) for _ in range(400)]
    text = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    passage, line = text(45), text(9)
    rows = [(0, None, "en", "a"), (1, "", "en", None), (2, " \n\t ", None, "a"), (3, "one two", "fr", "b"), (4, "one two", "fr", "b"), (4, "one two", "fr", "b"), (None, text(50), "en", "a"), (5, "Des. " * 90, "en", "a"), (6, "A b c d " * 40, "en", "hot"), (7, text(4000), "en", "hot")]
    base = [text(rnd.randint(5, 160)) for _ in range(12)]
    for i in range(10, 10 + n):
        t = rnd.choice(base) if rnd.random() < 0.5 else text(rnd.randint(3, 150))
        words = t.split()
        if rnd.random() < 0.4 and len(words) > 20:
            words[rnd.randrange(len(words))] = "edit" + str(i)
        t = " ".join(words)
        if rnd.random() < 0.3:
            t = t + "\n" + passage + "\n" + text(20)
        if rnd.random() < 0.3:
            t = line + "\n" + t
        rows.append((i, t, rnd.choice(["en", "fr", None]), "hot" if rnd.random() < 0.4 else rnd.choice(["a", "b", None])))
    return rows


@pytest.fixture(scope="module")
def docs(docs_of):
    return docs_of(corpus())


@pytest.fixture(scope="module")
def empty(docs_of):
    return docs_of([])


def table_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- substring dedup ----------------------------------------------------------------------------------------------


def substring_brute(rows, width):
    seqs = [WORD.findall(t or "") for _, t, _, _ in rows]
    count = Counter(tuple(s[i : i + width]) for s in seqs for i in range(len(s) - width + 1))
    out = []
    for (i, *_), s in zip(rows, seqs, strict=True):
        gone = {j for k in range(len(s) - width + 1) if count[tuple(s[k : k + width])] > 1 for j in range(k, k + width)}
        out.append((i, len(s), len(gone), sha(" ".join(w for j, w in enumerate(s) if j not in gone).encode())))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("width", "hot"), [(35, 2_000), (35, 1), (12, 1)])
def test_substring_dedup(docs, monkeypatch, width, hot):
    monkeypatch.setattr(substring, "HOT_SEGMENTS", hot)
    got = table_of(substring.substring_dedup(docs, width), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == substring_brute(corpus(), width)
    assert any(r[2] for r in got)


def test_hot_windows_are_searched(docs_of, monkeypatch):
    monkeypatch.setattr(substring, "HOT_SEGMENTS", 0)
    asked = []
    cut = substring._cut
    monkeypatch.setattr(substring, "_cut", lambda active, pieces, width: asked.append(pieces) or cut(active, pieces, width))
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [(1, "one two " + passage, "en", "a"), (2, "three " + passage + " four five", "en", "a"), (3, "six", "en", "a")]
    got = table_of(substring.substring_dedup(docs_of(rows), 12), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == substring_brute(rows, 12)
    # no window goes to the index as two copies of one place where it stands in two
    places = Counter(r["id1"] for r in asked[-1].select("id1", "row", "start").distinct().collect())
    assert places and all(r["copies"] == 1 and places[r["id1"]] == 2 for r in asked[-1].collect())


def test_substring_dedup_empty_and_text(empty, docs):
    assert substring.substring_dedup(empty).count() == 0
    r = substring.substring_dedup(docs, with_text=True).where("n_removed > 0").head()
    assert sha(r["kept"].encode()) == r["kept_sha256"]


def test_fm_index_against_counting():
    rng = np.random.default_rng(5)
    for _ in range(60):
        width = int(rng.integers(2, 6))
        segments = [rng.integers(1, int(rng.integers(2, 5)), int(rng.integers(1, 20))) for _ in range(int(rng.integers(1, 9)))]
        copies = [int(rng.integers(1, 3)) for _ in segments]
        count = Counter()
        for s, c in zip(segments, copies, strict=True):
            for i in range(len(s) - width + 1):
                count[tuple(s[i : i + width])] += c
        want = [[count[tuple(s[i : i + width])] > 1 for i in range(len(s) - width + 1)] for s in segments]
        assert [list(map(bool, x)) for x in repeated_windows(segments, copies, width)] == want


# --- language identification --------------------------------------------------------------------------------------


def test_language_id(spark, docs_of):
    rnd = random.Random(2)
    words = {"en": "the of and ing tion with from".split(), "de": "der und schen lich keit für ein".split(), "fr": "le que ment eaux tion pour dans".split()}
    rows = [(i, " ".join(rnd.choices(words[lang], k=40)), lang, "s") for i, lang in enumerate(rnd.choices(list(words), k=300))]
    df = docs_of([*rows, (900, None, "en", "s"), (901, "12 34 !!", "en", "s"), (902, "", "de", "s"), (903, "der und", None, "s")])
    model = language_id.fit([(t, lang) for _, t, lang, _ in rows[:200]])
    out = {r["doc_id"]: r for r in language_id.predict(df, model).collect()}
    assert sum(out[i]["lang_pred"] == lang for i, _, lang, _ in rows[200:]) >= 97
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert [out[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert out[903]["lang_pred"] == "de"
    assert language_id.predict(df, language_id.fit([])).where("lang_pred <> 'und' OR score <> 0").count() == 0
    assert language_id.predict(docs_of([]), model).count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/documents.parquet"), reason="the generated tables are absent")
def test_language_id_on_held_out_documents(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    rows = language_id.op2_language_id(spark, "/root/testdata/sf0.01").where("held_out").collect()
    known = [r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["lang_pred"] != "und" and truth[r["doc_id"]]]
    assert len(known) > 150 and sum(known) / len(known) >= 0.97


def test_held_out_is_crc32_of_the_id(docs):
    got = {(r[0], r[1]) for r in docs.select("doc_id", language_id.held_out()).collect()}
    assert got == {(i, i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in corpus()}


def test_training_sample_is_bounded(docs):
    assert len(language_id.training_rows(docs, 7, 10_000, "doc_id", "text", "lang")) <= 7
    # rows that are repeated count once
    assert len(language_id.training_rows(docs.union(docs).union(docs), 30, 10_000, "doc_id", "text", "lang")) == len(language_id.training_rows(docs, 30, 10_000, "doc_id", "text", "lang"))


# --- byte-level BPE and counts ------------------------------------------------------------------------------------


def reference_encoding():
    import public_tokenizers
    import tiktoken

    path, pattern = bpe.default_vocabulary()
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


ODD = [None, "", " ", "\n\n", "a  b\t c", "I'm we've 'S", "é中文😀 x", "<|endoftext|>", "ananana " * 30, "    indent\n\n\n  x ", "  a", "a" * 5000]


def test_bpe_round_trip(spark, docs_of):
    own = reference_encoding()
    df = docs_of([(1000 + i, t, "en", "s") for i, t in enumerate(ODD)] + corpus()[7:30])
    texts = [t or "" for t in ODD] + [r[1] or "" for r in corpus()[7:30]]
    ids = [1000 + i for i in range(len(ODD))] + [r[0] for r in corpus()[7:30]]
    want = sorted((i, len(e), sha(",".join(map(str, e)).encode()), sha(t.encode())) for i, t, e in zip(ids, texts, map(own.encode_ordinary, texts), strict=True))
    assert table_of(bpe.encode_digests(df, *bpe.default_vocabulary()), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    coded = bpe.encode(df, *bpe.default_vocabulary(), offsets=True)
    assert {r["doc_id"]: r["decoded"] for r in bpe.decode(coded, *bpe.default_vocabulary()).collect()}[1006] == ODD[6].encode()
    r = coded.where("doc_id = 1006").head()
    assert r["char_offsets"][0] == 0 and all(ODD[6].encode()[b:].decode("utf-8", "ignore")[:1] in ODD[6] for b in r["byte_offsets"])
    assert bpe.encode_digests(docs_of([]), *bpe.default_vocabulary()).count() == 0


def test_token_counts(spark):
    lengths = [3, 3, 5, 9, 5000, 9000, 0, None, 5]
    df = spark.createDataFrame([(x,) for x in lengths], "n_tokens long")
    known = [x for x in lengths if x is not None]
    limits = token_counts.context_limits(token_counts.length_histogram(df))
    for r in limits.collect():
        at = r["length"]
        assert (r["n_docs"], r["docs_over"], r["tokens_over"]) == (known.count(at), sum(x > at for x in known), sum(x for x in known if x > at))
        assert r["truncated_tokens"] == sum(min(x, at) for x in known) and r["lost_tokens"] == sum(known) - r["truncated_tokens"]
        assert math.isclose(r["quantile"], sum(x <= at for x in known) / len(known), abs_tol=1e-9)
    got = {r["context"]: (r["docs_over"], r["truncated_tokens"]) for r in token_counts.totals_at(limits, [4, 4096, 100_000]).collect()}
    assert got == {c: (sum(x > c for x in known), sum(min(x, c) for x in known)) for c in (4, 4096, 100_000)}
    assert token_counts.context_limits(token_counts.length_histogram(df.limit(0))).count() == 0


def test_encoded_lengths(docs):
    own = reference_encoding()
    want = sorted(((i, len(own.encode_ordinary(t or ""))) for i, t, _, _ in corpus()), key=repr)
    assert table_of(bpe.encoded_lengths(docs, *bpe.default_vocabulary(), keep=["doc_id"]), "doc_id", "n_tokens") == want


# --- mixing -------------------------------------------------------------------------------------------------------


def test_mixing_meets_the_margins(docs, empty):
    rows = mixing.mixed(docs).collect()
    assert len(rows) == len(corpus())
    cells, total = defaultdict(float), sum(r["n_tokens"] for r in rows)
    for r in rows:
        cells[r["source"], r["lang"], r["topic"]] += r["n_tokens"]
    target = {}
    for k, d in enumerate(mixing.DIMENSIONS):
        own = defaultdict(float)
        for c, n in cells.items():
            own[c[k]] += n / total
        norm = sum(v ** mixing.FLATTENING[d] for v in own.values())
        target[k] = {c: v ** mixing.FLATTENING[d] / norm for c, v in own.items()}
    share = {c: n / total for c, n in cells.items()}
    for _ in range(mixing.SWEEPS):
        for k in range(3):
            sums = defaultdict(float)
            for c, v in share.items():
                sums[c[k]] += v
            share = {c: min(v * target[k][c[k]] / sums[c[k]], cells[c] / mixing.BUDGET / total) for c, v in share.items()}
    for r in rows:
        c = r["source"], r["lang"], r["topic"]
        p = min(1.0, mixing.BUDGET * share[c] * total / cells[c])
        assert math.isclose(r["weight"], p, abs_tol=2e-6)
        u = int(hashlib.md5(str(r["doc_id"] if r["doc_id"] is not None else "").encode()).hexdigest()[:8], 16) / 2**32
        assert r["sampled"] == (u < p)
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["sampled"] for r in rows)
    assert mixing.mixed(empty).count() == 0


def test_mixing_to_given_targets(docs_of):
    rows = [(i, "ab " * (100 + i), "en" if i % 3 else "de", "abc"[i % 4 % 3]) for i in range(80)]
    targets = {"source": {"a": 1, "b": 2, "c": 1}, "lang": {"en": 3}}
    got = mixing.mixed(docs_of(rows), budget=0.1, targets=targets).collect()
    share = Counter()
    for r in got:
        share[r["source"]] += r["weight"] * r["n_tokens"]
        assert r["weight"] < 1 and (r["weight"] > 0) == (r["lang"] == "en")
    total = sum(share.values())
    assert math.isclose(total, 0.1 * sum(r["n_tokens"] for r in got), rel_tol=1e-3)
    assert all(math.isclose(share[c] / total, w / 4, abs_tol=1e-3) for c, w in targets["source"].items())


# --- line dedup ---------------------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def lines_brute(rows, edits):
    key = lambda i: (i is not None, i or 0)
    places = sorted({(key(i), p, x) for i, t, _, _ in rows for p, x in enumerate((t or "").split("\n")) if WORD.search(x)})
    first = {}
    for i, p, x in places:
        first.setdefault(x, (i, p))
    near = {x for x in first for y in first if first[y] < first[x] and abs(len(x) - len(y)) <= edits and distance(x, y) <= min(edits, min(len(x), len(y)) // line_dedup.CHARS_PER_EDIT)}
    out = []
    for i, t, _, _ in rows:
        own = [(p, x) for p, x in enumerate((t or "").split("\n")) if WORD.search(x)]
        gone = [p for p, x in own if x in near or first[x] != (key(i), p)]
        out.append((i, len(own), len(gone), ",".join(map(str, gone))))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("edits", "group", "small"), [(1, 64, 500_000), (2, 64, 0), (1, 3, 0), (2, 3, 500_000), (2, 0, 500_000)])
def test_line_dedup(docs_of, monkeypatch, edits, group, small):
    monkeypatch.setattr(line_dedup, "GROUP", group)
    monkeypatch.setattr(line_dedup, "SMALL_KEYS", small)
    rnd = random.Random(4)
    rows = [r for r in corpus(7, 25) if r[0] != 7]
    base = "abcd efgh ijkl mnop qrst uvwx"
    for i in range(200, 230):  # a family of variants of one line, and lines that share a segment
        line = list(base if i % 2 else base[:14] + "".join(rnd.choice("xyz ") for _ in range(15)))
        for _ in range(rnd.randint(0, 3)):
            k = rnd.randrange(len(line))
            line[k : k + 1] = rnd.choice([[], ["é"], [line[k], "q"]])
        rows.append((i, "".join(line) + "\n\n  \nlast " + str(i), "en", "a"))
    got = table_of(line_dedup.line_report(docs_of(rows), edits=edits), "doc_id", "n_lines", "n_removed", "removed")
    assert got == lines_brute(rows, edits)


def test_line_dedup_texts(docs, empty):
    out = line_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    assert line_dedup.line_report(out).where("n_removed > 0").count() <= 2  # a line may be near one that is only now first
    assert line_dedup.line_report(empty).count() == 0 and line_dedup.without_repeats(empty).count() == 0


def test_lines_with_a_long_common_part(docs_of, monkeypatch):
    made = {}
    keep = line_dedup.stored

    def counted(df, name):
        out = keep(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(line_dedup, "stored", counted)
    rnd = random.Random(8)
    common = "2024-03-01 12:00:00 INFO worker: the request has been handled by the service, and its number is "[:90]
    lines = [common + "".join(rnd.choice("abcdefghijklmnop") for _ in range(30)) for _ in range(300)]
    lines += [x[:100] + "?" + x[101:] for x in lines[:20]]
    rows = [(i, x, "en", "a") for i, x in enumerate(lines)]
    got = table_of(line_dedup.line_report(docs_of(rows)), "doc_id", "n_lines", "n_removed", "removed")
    assert [r[0] for r in got if r[2]] and sorted(r[0] for r in got if r[2]) == list(range(300, 320))
    assert max(made.values()) < 30 * len(rows)


def test_line_dedup_moves_no_text_for_each_key(docs_of, monkeypatch):
    """With more shared segments than are broadcast, a text is shuffled once at most, not once for each of its substrings."""
    draw = random.Random(3)
    lines = ["".join(draw.choices("0123456789abcdefghijklmnopqrstuvwxyz", k=3000)) for _ in range(400)]
    rows = [(i, x, "en", "a") for i, x in enumerate([*lines, lines[7][:-1] + "#", lines[8] + "#"])]
    df = docs_of(rows)
    monkeypatch.setattr(line_dedup, "SMALL_KEYS", 0)
    executors = df.sparkSession.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(executors.executorList(False).apply(k).totalShuffleWrite() for k in range(executors.executorList(False).size()))
    before = written()
    spark = df.sparkSession
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of some size
    try:
        got = table_of(line_dedup.line_report(df), "doc_id", "n_lines", "n_removed", "removed")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [r[0] for r in got if r[2]] == [400, 401]
    assert written() - before < 3 * sum(map(len, lines))


def test_line_dedup_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "one line of some words\nanother", 7, 8, "x"), (2, "one line of some words\nthird", 9, 1, "y")], "doc_id long, text string, removed int, row int, h string").withColumn("Row_", F.lit(0)).withColumn("a.b", F.lit(1))
    out = line_dedup.without_repeats(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"], r["text"], r["removed"], r["row"]) for r in out.collect()) == [(1, "one line of some words\nanother", 7, 8), (2, "third", 9, 1)]
    assert line_dedup.line_report(df).count() == 2


def test_banded_distance(spark):
    rnd = random.Random(3)
    rows = []
    for _ in range(300):
        a = [rnd.choice("abé𝄞") for _ in range(rnd.randint(0, 14))]
        b = list(a)
        for _ in range(rnd.randint(0, 4)):
            k = rnd.randint(0, len(b))
            b[k : k + rnd.randint(0, 1)] = rnd.choice([[], ["a"], ["é"]])
        rows.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    for edits in (1, 2, 3):
        got = df.select("a", "b", line_dedup.banded_distance(F.col("a"), F.col("b"), edits).alias("d")).collect()
        assert all(r["d"] == min(distance(r["a"], r["b"]), edits + 1) for r in got)


# --- chat ---------------------------------------------------------------------------------------------------------


def legal(roles):
    body = roles[1:] if roles[:1] == ["system"] else roles
    return bool(body) and len(body) % 2 == 0 and all(r == ("user", "assistant")[k % 2] for k, r in enumerate(body))


def least_cost(roles):
    """All paths, without blocks."""
    best = {chat.START: 0}
    for role in roles:
        new = {}
        for s, c in best.items():
            for cost, to, *_ in chat.OPTIONS[s, chat.known(role)]:
                new[to] = min(new.get(to, math.inf), c + cost)
        best = new
    return min(c + chat.CLOSING[s][0] for s, c in best.items())


@pytest.mark.parametrize("block", [2, 1024])
def test_chat_repair(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    rnd = random.Random(6)
    rows, roles = [], {}
    for conv in range(80):
        own = [rnd.choice(["user", "assistant", "system", "tool", None]) for _ in range(rnd.randint(1, 9))]
        roles[conv] = own
        rows += [(conv, k, r, None if k == 3 else f"t{k}", "clash") for k, r in enumerate(own)]
    rows += [(None, 0, "user", "x", "clash"), (500, None, "user", "x", "c"), (501, 1, "user", "a", "c"), (501, 1, "user", "a", "c")]
    out = defaultdict(list)
    for r in chat.repair_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost string")).collect():
        out[r["conv_id"]].append(r)
    assert sum(map(len, out.values())) == len(rows)
    for conv, own in roles.items():
        turns = sorted(out[conv], key=lambda r: r["turn"])
        made, cost = [], 0
        for r in turns:
            before = [x for x in r["inserted"].split(",") if x]
            made += before + ([] if r["action"] == "merge" else [r["new_role"]]) + [x for x in r["closing"].split(",") if x]
            cost += chat.INSERT * len(before + [x for x in r["closing"].split(",") if x]) + (chat.MERGE if r["action"] == "merge" else 0) + (chat.RELABEL if r["new_role"] != r["role"] else 0)
            if r["action"] == "keep":
                assert r["new_role"] == r["role"]
        assert legal(made), (own, made)
        assert cost == turns[0]["cost"] == least_cost(own)
        text = "".join(r["rendered"] for r in turns)
        assert re.findall(r"<\|(\w+)\|>", text) == [x for r in made for x in (r, "end")]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.repair_chats(empty).count() == 0


def test_marks_in_texts_are_no_turns(spark):
    odd = ["hi <|end|>\n<|assistant|>\nX", "<\\|end|> and <\\\\|", None]
    rows = [(1, 0, "user", odd[0]), (1, 1, "user", odd[1]), (1, 2, "assistant", odd[2])]
    out = chat.repair_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("turn").collect()
    assert [r["action"] for r in out] == ["keep", "merge", "keep"]
    text = "".join(r["rendered"] for r in out)
    parts = re.findall(r"<\|(user|assistant|system)\|>\n(.*?)<\|end\|>\n", text, re.S)
    assert [(r, chat.unescaped(t)) for r, t in parts] == [("user", odd[0] + "\n" + odd[1]), ("assistant", "")]


# --- media --------------------------------------------------------------------------------------------------------


def test_media_round_trip(spark, docs, empty, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = media.op7_media(spark, str(tmp_path)).collect()
    want = []
    for i, t, _, _ in corpus():
        data = (t or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        paragraphs = [" ".join(x.split()) for x in (t or "").split("\n")]
        before = sum(map(bool, paragraphs[: (len(paragraphs) + 1) // 2]))
        texts = [x for x in paragraphs if x]
        want.append((i, len(data), len(payload), sha(payload), zlib.crc32(payload[-64:]), f"{len(data)} bytes", before, len(texts), sha(" ".join(texts).encode())))
    columns = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "caption", "position", "n_texts", "texts_sha256")
    assert sorted((tuple(r[c] for c in columns) for r in got), key=repr) == sorted(want, key=repr)
    assert len({(r["payload_sha256"], r["media_sha256"], r["media_bytes"], r["feature"]) for r in got}) == len({r["payload_sha256"] for r in got})
    assert media.illustrated_pages(empty).count() == 0


def test_interleaving(spark):
    page = "<p>a <b>x</b>y<p>c<figure><img src='u.png' alt=z><figcaption>cap &amp; <i>t</i></figcaption></figure>tail<script>no</script><video src=sha256:ff>"
    items = media.parse_sequence(page)
    assert [(x["kind"], x["text"] or x["caption"]) for x in items] == [("text", "a xy"), ("text", "c"), ("media", "cap & t"), ("text", "tail"), ("media", None)]
    assert items[-1]["digest"] == "ff" and [x["position"] for x in items] == list(range(5))
    early = media.parse_sequence("<figure><figcaption>both</figcaption><img src=a><img data-src=b></figure><picture><source srcset='c 1x, d 2x'></picture><figure><figcaption>alone</figcaption></figure>end")
    assert [(x["kind"], x["src"] or x["text"], x["caption"]) for x in early] == [("media", "a", "both"), ("media", "b", "both"), ("media", "c", None), ("text", "alone", None), ("text", "end", None)]
    assert media.parse_sequence(None) == [] and media.parse_sequence("") == []
    df = spark.createDataFrame([(1, page, "k"), (1, page, "k"), (2, None, "k")], "page_id long, html string, items string")
    refs = media.references(media.interleave(df))
    assert refs.count() == 4
    assert media.resolve(refs, spark.createDataFrame([("ff", 1)], "digest string, payload_bytes long")).where("payload_bytes IS NULL").count() == 2


def test_damaged_media_are_an_error():
    data = bytearray(media.write_png(bytes(128)))
    assert media.read_png(bytes(data)) == bytes(128)
    data[-20] ^= 1
    with pytest.raises(ValueError):
        media.read_png(bytes(data))


# --- quality rules ------------------------------------------------------------------------------------------------


def quality_facts(t):
    words = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    count = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if count[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_measures(docs, empty):
    got = quality.quality_rules(docs)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for i, t, _, _ in corpus():
        f = quality_facts(t)
        want.append((i, *f, f[0] < 20 or 100 * f[4] > 30 * f[0]))
    assert table_of(got, *names) == sorted(want, key=repr)
    assert got.where("base_failed AND kept").count() == 0
    assert quality.quality_rules(empty).count() == 0
    assert quality.quality_filter(docs).columns == docs.columns and quality.quality_filter(docs).count() == got.where("kept").count()


def test_quality_fences(docs_of):
    rnd = random.Random(8)
    clean = [(i, " ".join("".join(rnd.choice("abcdef") for _ in range(rnd.randint(3, 7))) for _ in range(80)), "en", "s") for i in range(150)]
    junk = [(500 + i, " ".join("ab%%%$$$" + str(k) for k in range(60)), "en", "s") for i in range(5)]
    out = {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs_of(clean + junk)).collect()}
    assert all(out[i] for i, *_ in clean) and not any(out[i] for i, *_ in junk)


# --- n-gram join --------------------------------------------------------------------------------------------------


def components_brute(rows, k, percent):
    sets = []
    for _, t, _, _ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if rows[a][0] is None or rows[b][0] is None:
            continue
        both = len(sets[a] & sets[b])
        if rows[a][0] == rows[b][0] or (both and 100 * both >= percent * len(sets[a] | sets[b])):
            up[top(a)] = top(b)
    out = []
    for x, (i, *_) in enumerate(rows):
        own = [rows[y][0] for y in range(len(rows)) if top(y) == top(x)]
        out.append((i, len(sets[x]), None if i is None else min(own)))
    return sorted(out, key=repr)


def family_rows(seed, n, ids=None):
    """Edited copies of a few texts. With ids, several texts of different families share one."""
    rnd = random.Random(seed)
    bases = [[rnd.choice("abcdefghijklmnop") + str(rnd.randint(0, 50)) for _ in range(rnd.randint(5, 120))] for _ in range(n // 4)]
    out = []
    for i in range(n):
        words = list(rnd.choice(bases))
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(len(words))] = f"e{rnd.randint(0, 9)}"
        out.append((rnd.randint(0, ids) if ids else i, " ".join(words), "en", "a"))
    return out


@pytest.mark.parametrize(("k", "percent", "common", "tile"), [(4, 85, 24, 1024), (5, 80, 0, 8), (4, 85, 2, 8)])
@pytest.mark.parametrize("rows", [corpus(), family_rows(1, 240), family_rows(2, 240, 401), family_rows(3, 240, 151)], ids=["odd", "unique", "some ids repeat", "most ids repeat"])
def test_ngram_components(docs_of, monkeypatch, rows, k, percent, common, tile):
    monkeypatch.setattr(ngram_join, "COMMON", common)
    monkeypatch.setattr(ngram_join, "TILE_DOCS", tile)
    got = table_of(ngram_join.ngram_components(docs_of(rows), k, percent), "doc_id", "n_shingles", "component_id")
    assert got == components_brute(rows, k, percent)


def test_overlaps_against_sets():
    rng = np.random.default_rng(1)
    for _ in range(100):
        rows = [np.unique(rng.integers(0, 60, rng.integers(0, 30)).astype(np.uint64)) for _ in range(int(rng.integers(1, 40)))]
        want = [[len(np.intersect1d(a, b)) if i != j else 0 for j, b in enumerate(rows)] for i, a in enumerate(rows)]
        assert ngram_join.overlaps(rows).tolist() == want


def test_a_large_family_puts_out_no_pairs(docs_of, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE_DOCS", 16)
    counts = []
    keep = ngram_join.stored
    monkeypatch.setattr(ngram_join, "stored", lambda df, name: counts.append((name, (out := keep(df, name)).count())) or out)
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w if rnd.random() > 0.01 else f"x{rnd.randint(0, 99)}" for w in base), "en", "a") for i in range(150)]
    got = table_of(ngram_join.ngram_components(docs_of(rows), 4, 85), "doc_id", "n_shingles", "component_id")
    assert got == components_brute(rows, 4, 85)
    assert max(n for name, n in counts if name == "found") < 2 * len(rows)


def test_one_of_each_with_clashing_names_and_repeated_ids(spark):
    rows = [(1, "a b c d e f", 7, "x"), (1, "g h i", 8, "y"), (2, "a b c d e f", 9, "z"), (None, "a b c d e f", 1, "n"), (3, None, 2, "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, own long, _id string").withColumn("place", F.lit(0)).withColumn("OWN_", F.lit(1)).withColumn("component_id", F.lit(5))
    out = ngram_join.one_of_each(df)
    assert out.columns == df.columns
    assert sorted(((r["doc_id"], r["text"], r["own"]) for r in out.collect()), key=repr) == sorted([(1, "a b c d e f", 7), (None, "a b c d e f", 1), (3, None, 2)], key=repr)


def test_one_of_each(docs, empty):
    out = ngram_join.one_of_each(docs, 4, 85)
    ids = [r["doc_id"] for r in out.collect()]
    assert out.columns == docs.columns
    assert sorted(i for i in ids if i is not None) == sorted({c for _, _, c in components_brute(corpus(), 4, 85) if c is not None}) and ids.count(None) == 1
    assert ngram_join.ngram_components(empty).count() == 0 and ngram_join.one_of_each(empty).count() == 0


@pytest.fixture
def shuffled(spark):
    """What it yields gives the bytes shuffled so far; no table counts as small."""
    executors = spark.sparkContext._jsc.sc().statusStore()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield lambda: sum(executors.executorList(False).apply(k).totalShuffleWrite() for k in range(executors.executorList(False).size()))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def unlike(spark, n=60, words=3000):
    """Texts that share nothing, two of which have a copy, and a row without an id."""
    rnd = random.Random(3)
    texts = ["\n".join(" ".join("".join(rnd.choices("abcdefghij", k=6)) for _ in range(100)) for _ in range(words // 100)) for _ in range(n)]
    rows = [*enumerate(texts), (n, texts[0]), (n + 1, texts[1]), (None, texts[2])]
    return texts, spark.createDataFrame(rows, "doc_id long, text string").withColumn("_word", F.lit(1))


def test_columns_are_exchanged_one_step_at_a_time(spark, shuffled, monkeypatch):
    texts, df = unlike(spark)
    keep, steps = ngram_join.stored, []

    def counted(table, name):
        before = shuffled()
        out = keep(table, name)
        steps.append(shuffled() - before)
        return out

    monkeypatch.setattr(ngram_join, "stored", counted)
    ngram_join.ngram_components(df, 5, 80)
    columns = sum(ngram_join.prefix_length(len(t.split()) - 4, 80) for t in texts)
    assert max(steps) < 18 * columns  # 24 where both exchanges run in one step


def test_texts_that_stay_whole_are_not_shuffled(spark, shuffled, tmp_path):
    texts, df = unlike(spark)
    for step, want in ((ngram_join.one_of_each, [None, *range(60)]), (line_dedup.without_repeats, [None, *(i for i in range(60) if i != 2)])):
        out = step(df)
        before = shuffled()
        out.write.parquet(path := f"{tmp_path}/{step.__name__}")
        assert shuffled() - before < 0.2 * sum(map(len, texts))
        got = spark.read.parquet(path)
        assert got.columns == df.columns
        assert sorted((r["doc_id"] for r in got.collect()), key=lambda x: -1 if x is None else x) == want
        assert sorted(r["text"] for r in got.collect()) == sorted(texts + [texts[2]] * (step is ngram_join.one_of_each))
