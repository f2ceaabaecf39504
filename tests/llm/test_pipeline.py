"""run() and each stage of the pipeline against a brute-force version on a small table."""

import hashlib
from collections import defaultdict

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from corpusloom.llm import line_dedup, mixing, quality  # noqa: E402
from test_operators import WORD, components_brute, corpus, lines_brute, quality_facts, reference_encoding, sha  # noqa: E402


def low_bits(v):
    shift = max(0, len(bin(v)[2:]) - quality.PRECISION)
    return v >> shift << shift


def quality_brute(rows):
    facts = []
    for i, t, lang, source in rows:
        n, chars, symbols, dup, repeat = quality_facts(t)
        lines = sum(bool(WORD.search(x)) for x in (t or "").split("\n"))
        values = (chars * 100 // n if n else 0, symbols * 1000 // chars if chars else 0, dup * 1000 // lines if lines else 0)
        facts.append(((i, t, lang, source), n < 20 or 100 * repeat > 30 * n, [low_bits(v) for v in values]))
    groups = defaultdict(list)
    for (_, _, lang, source), failed, values in facts:
        if not failed:
            for key in ((lang, source), (lang,), ()):
                groups[key].append(values)

    def marks(key, k):
        own = sorted(v[k] for v in groups[key])
        at = [own[-(-j * len(own) // 10) - 1] for j in (2, 5, 8)]
        return at if key == () else [(len(own) * q + quality.PRIOR_DOCS * other) // (len(own) + quality.PRIOR_DOCS) for q, other in zip(at, marks(key[:-1], k), strict=True)]

    def fence(lang, source, k):
        q20, q50, q80 = marks((lang, source), k)
        _, weight, least = quality.FENCES[k]
        return q20 - max(weight * (q50 - q20), least), q80 + max(weight * (q80 - q50), least)

    return [row for row, failed, values in facts if not failed and all(lo <= v <= hi for k, v in enumerate(values) for lo, hi in [fence(row[2], row[3], k)])]


def lines_stage(rows):
    gone = {r[0]: {int(p) for p in r[3].split(",") if p} for r in lines_brute(rows, line_dedup.EDITS)}
    out = []
    for i, t, lang, source in rows:
        kept = "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i])
        if not gone[i] or WORD.search(kept):
            out.append((i, kept, lang, source))
    return out


def mixing_stage(rows):
    def cell(t, lang, source):
        n = len(t)
        form = "long" if n >= 8000 else "short" if n < 400 else "list" if n < 100 * len(t.split("\n")) else "prose"
        return source, lang, form

    tokens = lambda t: max(1, len(t.encode()) // 4)
    sums = defaultdict(float)
    for _, t, lang, source in rows:
        sums[cell(t, lang, source)] += tokens(t)
    total = sum(sums.values())
    share = {c: n / total for c, n in sums.items()}
    targets = []
    for k, d in enumerate(mixing.DIMENSIONS):
        own = defaultdict(float)
        for c, v in share.items():
            own[c[k]] += v
        norm = sum(v ** mixing.FLATTENING[d] for v in own.values())
        targets.append({c: v ** mixing.FLATTENING[d] / norm for c, v in own.items()})
    for _ in range(mixing.SWEEPS):
        for k in range(3):
            own = defaultdict(float)
            for c, v in share.items():
                own[c[k]] += v
            share = {c: min(v * targets[k][c[k]] / own[c[k]], sums[c] / mixing.BUDGET / total) for c, v in share.items()}
    draw = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) / 2**32
    return [r for r in rows if draw(r[0]) < min(1.0, mixing.BUDGET * share[cell(*r[1:])] * total / sums[cell(*r[1:])])]


def brute(rows):
    stages = [quality_brute(rows)]
    stages.append(lines_stage(stages[-1]))
    stay = {c for _, _, c in components_brute(stages[-1], 5, 80)}
    stages.append([r for r in stages[-1] if r[0] in stay])
    stages.append(mixing_stage(stages[-1]))
    own = reference_encoding()
    coded = [(i, own.encode_ordinary(t), t) for i, t, _, _ in stages[-1]]
    return stages, sorted((i, len(e), sha(",".join(map(str, e)).encode()), sha(t.encode())) for i, e, t in coded)


def test_pipeline(spark, tmp_path):
    rows = [r for r in corpus(11, 120) if r[0] is not None and r[0] != 4] + [(5000 + k, " ".join(f"ab%%%$$$&{k}x{j}" for j in range(40)), "en", "hot") for k in range(3)]
    df = spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t, lang, source in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    stages, want = brute(rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, ((name, stage), kept) in enumerate(zip(corpus_pipeline.STAGES, stages, strict=False)):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns, name
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in docs.collect()) == sorted((i, t, len(t)) for i, t, _, _ in kept), name
    assert 0 < len(want) < len(stages[0]) < len(rows)
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want


def test_pipeline_on_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_lines_of_two_edits(spark):
    line = "the invoice of 12 March names a sum of 4711 crowns and is due in thirty days"
    rows = [(1, line + "\nfirst"), (2, line.replace("12", "13").replace("4711", "4712") + "\nsecond"), (3, line.replace("12", "27").replace("4711", "9999") + "\nthird")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_lines(spark, docs, "").collect()}
    assert out == {1: rows[0][1], 2: "second", 3: rows[2][1]}
