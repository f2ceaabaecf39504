"""Language identification: averaged hashed subword embeddings and a linear softmax, trained in numpy, with calibrated rejection."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table

UNKNOWN = "und"
#: Subwords: byte n-grams of these lengths, case of A-Z folded, white space read as one kind of mark.
ORDERS = (3, 4)
BUCKETS = 1 << 15
#: Bytes of text in one numpy step.
STEP_BYTES = 400_000


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # (len(ORDERS) * BUCKETS, langs): embeddings times weights
    bias: np.ndarray
    temperature: float
    threshold: float


def _folding() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint32)
    fold[ord("A") : ord("Z") + 1] += 32
    fold[[0, *range(9, 14)]] = 32
    return fold


_FOLD = _folding()
_PAD = max(ORDERS)


def subwords(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each subword of all texts, one row an order; first position of each text). A text is read with a space before and after it."""
    joined = b"".join([b" " + t + b" " * _PAD for t in texts])
    codes = _FOLD[np.frombuffer(joined, np.uint8)]
    size = np.array([len(t) + 1 + _PAD for t in texts])
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    n = len(codes) - _PAD + 1
    rows = []
    gram = codes[:n].copy()
    shift = 32 - int(math.log2(BUCKETS))
    for k in range(1, _PAD):
        gram |= codes[k : k + n] << np.uint32(8 * k)
        if k + 1 in ORDERS:
            mixed = gram * np.uint32(2654435761)
            mixed ^= mixed >> np.uint32(15)
            rows.append(((mixed * np.uint32(2246822519)) >> np.uint32(shift)).astype(np.int64) + ORDERS.index(k + 1) * BUCKETS)
    return np.array(rows), start


def averaged(texts: list[bytes], scores: np.ndarray) -> np.ndarray:
    """The mean row of scores over all subwords of each text; every text is read to its end."""
    out = np.zeros((len(texts), scores.shape[1]))
    k = 0
    while k < len(texts):
        part, size = [], 0
        first = k
        while k < len(texts) and (not part or size + len(texts[k]) <= STEP_BYTES):
            part.append(texts[k])
            size += len(texts[k])
            k += 1
        buckets, start = subwords(part)
        total = sum(np.add.reduceat(scores[row], start, axis=0, dtype=np.float64) for row in buckets)
        count = np.diff([*start, buckets.shape[1]]) * len(ORDERS)
        out[first:k] = total / np.maximum(count, 1)[:, None]
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, str]], dim: int = 16, epochs: int = 6, rate: float = 20.0, seed: int = 7) -> Model:
    """Stochastic gradient descent on (text, lang) rows in the order given; every fifth row is left for calibration.

    The temperature is the one of a grid that gives the least loss on the rows left; the rejection threshold is the
    score that 1 % of those of them that are predicted rightly don't reach. Rows without lang are an error of the caller.
    """
    langs = sorted({lang for _, lang in rows})
    width = len(ORDERS) * BUCKETS
    if not langs:
        return Model([], np.zeros((width, 0), np.float32), np.zeros(0), 1.0, 0.0)
    number = {lang: i for i, lang in enumerate(langs)}
    bags = []
    for text, lang in rows:
        buckets, _ = subwords([text.encode("utf-8", "replace")])
        ids, counts = np.unique(buckets, return_counts=True)
        bags.append((ids, (counts / counts.sum()).astype(np.float32), number[lang]))
    left = [b for i, b in enumerate(bags) if i % 5 == 4] or bags
    used = [b for i, b in enumerate(bags) if i % 5 != 4]
    rng = np.random.default_rng(seed)
    embedding = (rng.standard_normal((width, dim)) / dim).astype(np.float32)
    weights = (rng.standard_normal((dim, len(langs))) / math.sqrt(dim)).astype(np.float32)
    bias = np.zeros(len(langs), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(used)):
            ids, share, y = used[i]
            mean = share @ embedding[ids]
            error = softmax((mean @ weights + bias)[None])[0]
            error[y] -= 1
            back = weights @ error
            weights -= 0.02 * step * np.outer(mean, error)
            bias -= 0.002 * step * error
            embedding[ids] -= step * share[:, None] * back
    scores = (embedding @ weights).astype(np.float32)
    logits = np.array([share @ scores[ids] + bias for ids, share, _ in left])
    y = np.array([b[2] for b in left])
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean()
    temperature = min((0.05 * 1.25**k for k in range(24)), key=loss)
    p = softmax(logits / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    return Model(langs, scores, bias, float(temperature), float(np.quantile(right, 0.01)) if len(right) else 0.0)


def training_rows(df: DataFrame, max_docs: int, max_bytes: int, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """At most max_docs labelled rows of at most max_bytes each: for each language those with the lowest hashes of their ids.

    The bound is a parameter and the sample the same at every partitioning.
    """
    from pyspark.sql import Window

    known = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.octet_length(text_col) <= max_bytes) & F.col(text_col).rlike(r"\p{L}"))
    order = F.xxhash64(F.col(id_col).cast("string"))
    content = F.xxhash64(text_col)
    ids = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), order.alias("order"), content.alias("content")).distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order", "id", "content"))
    # a top-k in each language keeps k rows a task before the shuffle
    best = ids.withColumn("rank", rank).where(F.col("rank") <= max_docs).orderBy("rank", "lang").limit(max_docs).select("id", "content")
    pair = lambda i, c: F.concat_ws(":", i.cast("string"), c.cast("string"))
    keys = [r[0] for r in best.select(pair(F.col("id"), F.col("content"))).collect()]
    if not keys:
        return []
    picked = known.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), order.alias("order"), F.col(id_col).alias("id"), content.alias("content"))
    # a row for each of the keys and its languages at most, however often a row is repeated
    rows = picked.where(pair(F.col("id"), F.col("content")).isin(keys)).dropDuplicates(["id", "content", "lang"]).limit(max_docs).collect()
    return [(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["order"], str(r["id"]), r["text"], r["lang"]))]


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, kept columns, lang_pred, score, rejected) of each row, from its text alone.

    A null text, an empty one and one without a letter give `und`, score 0 and rejected. Otherwise the prediction is
    always a learned language, score its calibrated probability, and rejected tells that it is below the threshold.
    With no learned language everything is `und`. Repeated rows each get their own row.
    """
    keep = keep or []
    held = df.sparkSession.sparkContext.broadcast(model)  # of fixed size: buckets times languages

    def run(parts):
        m = held.value
        for batch in parts:
            ok, texts = batch.column(batch.num_columns - 1).to_pylist(), batch.column(batch.num_columns - 2)
            n = batch.num_rows
            lang, score = [UNKNOWN] * n, np.zeros(n)
            if m.langs and (at := [i for i in range(n) if ok[i]]):
                raw = texts.cast(pa.binary())
                p = softmax((averaged([raw[i].as_py() for i in at], m.scores) + m.bias) / m.temperature)
                for i, k, s in zip(at, p.argmax(axis=1), p.max(axis=1), strict=True):
                    lang[i], score[i] = m.langs[k], s
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array((score < m.threshold) | (np.array(lang) == UNKNOWN), pa.bool_())], [f"k{i}" for i in range(len(keep) + 1)] + ["lang_pred", "score", "rejected"])

    kinds = dict(df.dtypes)
    own = [id_col, *keep]
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    out = df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(own)), F.col(text_col).alias("text"), letters.alias("letters"))
    return out.mapInArrow(run, ", ".join([*(f"k{i} {kinds[c]}" for i, c in enumerate(own)), "lang_pred string, score double, rejected boolean"])).toDF(*own, "lang_pred", "score", "rejected")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str, max_docs: int = 4_000, max_bytes: int = 8_192) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = fit(training_rows(docs.where(~F.col("held_out")), max_docs, max_bytes, "doc_id", "text", "lang"))
    return predict(docs.drop("lang"), model, keep=["held_out"])
