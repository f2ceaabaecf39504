"""Substring dedup: repeated word windows of a corpus, found by compressed FM-indexes, one for each shard.

Windows are sent to shards by content: consecutive windows with the same minimizer (the least hash of their 8-word grams)
form a segment, and the minimizer names its shard, so equal windows always meet and each word goes to a few shards
only. Segments whose minimizer occurs once hold no repeated window. The others are streamed through the index of their
shard: backward search over a wavelet matrix gives the matching statistics, and intervals of the window's width or more
are reported. Windows of a minimizer that very many different segments share are dealt by their own hashes instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table
from corpusloom.llm.fm_index import repeated_windows
from corpusloom.llm.wordhash import grams, hash_words, mix, steps
from corpusloom.storage import stored

GRAM = 8
#: Different segments of one minimizer beyond which its windows are dealt one by one.
HOT_SEGMENTS = 2_000
#: Words in one index; a shard is a run of whole minimizers of about so many words.
SHARD_WORDS = 1_000_000


def _window_hash(words: np.ndarray, g: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window of width words, from the grams that cover it."""
    n = len(words) - width + 1
    gram = min(GRAM, width)
    cover = [*range(0, width - gram, gram), width - gram]
    out = np.zeros(n, np.uint64)
    for at in cover:
        out = out * np.uint64(0xD6E8FEB86659FD93) + g[at : at + n]
    return mix(out)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, k = values, 1
    while 2 * k <= width:
        out = np.minimum(out[: len(out) - k], out[k:])
        k *= 2
    return np.minimum(out[: len(out) - (width - k)], out[width - k :]) if width > k else out


def segments_of(df: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, row, n_words, plain_sha256, segs array<struct<h, s, start, k, c>>) of each text: its windows cut into segments.

    h: the minimizer; s: a hash of the segment's words; start: its first word; k: its windows;
    c: 2 if it may hold one window twice, else 1.
    """
    gram = min(GRAM, width)
    most = width - gram + 1  # windows of a segment: its first and last one cover it

    def run(parts):
        for batch in parts:
            raw = batch.column(2).cast(pa.binary())
            n_words, plain, sizes, columns = [], [], [], [[], [], [], [], []]
            for base, data, offsets in steps(batch.column(2)):
                words, _, _, first = hash_words(data, offsets)
                g = grams(words, gram)
                whole = len(words) - width + 1
                count = np.diff(first)
                if whole > 0:
                    low = _sliding_min(g, most)[:whole]
                    own = _window_hash(words, g, width)
                    doc = np.repeat(np.arange(len(count)), count)[:whole]
                    inside = np.arange(whole) + width <= first[doc + 1]
                    change = np.ones(whole, bool)
                    change[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]
                    # long runs of one minimizer are cut at even distances from their start
                    start = np.maximum.accumulate(np.where(change, np.arange(whole), 0))
                    cut = inside & ((np.arange(whole) - start) % most == 0)
                    at = np.flatnonzero(cut)
                    ends = np.flatnonzero(inside & np.concatenate([cut[1:] | ~inside[1:], [True]]))
                    k = ends - at + 1
                    # a window equal to a near one of its text: the segment may repeat itself
                    near = np.zeros(whole, np.int64)
                    for d in range(1, min(most, whole)):
                        near[:-d] |= own[:-d] == own[d:]
                    columns[4].append((1 + np.maximum.reduceat(near, at) if len(at) else at).astype(np.int32))
                    columns[0].append(low[at].view(np.int64))
                    columns[1].append(mix(own[at] * np.uint64(3) + own[ends] * np.uint64(5) + k.astype(np.uint64)).view(np.int64))
                    columns[2].append((at - first[doc[at]]).astype(np.int32))
                    columns[3].append(k.astype(np.int32))
                    sizes.append(np.bincount(doc[at], minlength=len(count)))
                else:
                    sizes.append(np.zeros(len(count), np.int64))
                n_words.append(count)
                for i in range(base, base + len(count)):
                    plain.append(hashlib.sha256(b" ".join((raw[i].as_py() or b"").split())).hexdigest())
            join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
            offsets_ = np.concatenate([[0], np.cumsum(join(sizes, np.int64))]).astype(np.int32)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            inner = pa.StructArray.from_arrays([pa.array(join(c, np.int64), t) for c, t in zip(columns, kinds, strict=True)], ["h", "s", "start", "k", "c"])
            segs = pa.ListArray.from_arrays(pa.array(offsets_), inner)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(join(n_words, np.int64), pa.int64()), pa.array(plain, pa.string()), segs], ["id", "row", "n_words", "plain_sha256", "segs"])

    kind = dict(df.dtypes)[id_col]
    return _rows(df, id_col, text_col).mapInArrow(run, f"id {kind}, row long, n_words long, plain_sha256 string, segs array<struct<h:long,s:long,start:int,k:int,c:int>>")


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("row"), text.alias("text"))


def _packed(rows: DataFrame) -> DataFrame:
    def run(parts):
        press = zstandard.ZstdCompressor(level=1).compress
        for batch in parts:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([press(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()], pa.binary())], ["row", "blob"])

    return rows.select("row", "text").mapInArrow(run, "row long, blob binary")


_CUT = "key long, id1 long, id2 long, copies int, words binary"


def _cut(active: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The words of the wanted pieces (row, key, id1, id2, copies, start, k) as (key, id1, id2, copies, words)."""
    pieces = wanted.groupBy("row").agg(F.collect_list(F.struct("key", "id1", "id2", "copies", "start", "k")).alias("pieces"))

    def run(parts):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in parts:
            out = [[], [], [], [], []]
            for blob, pieces_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = unpack(blob).split()
                for p in pieces_:
                    for column, value in zip(out, (p["key"], p["id1"], p["id2"], p["copies"], b" ".join(words[p["start"] : p["start"] + p["k"] + width - 1])), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["key", "id1", "id2", "copies", "words"])

    return active.join(pieces, "row").select("blob", "pieces").mapInArrow(run, _CUT)


def search_shards(pieces: DataFrame, width: int) -> DataFrame:
    """(id1, id2, mask): bit i of mask tells that the window at word i of the piece occurs twice or more among the pieces of its key."""

    def run(parts):
        held: list[tuple] = []
        size, last = 0, None

        def searched():
            coded: dict[bytes, int] = {}
            segments = [np.array([coded.setdefault(w, len(coded) + 1) for w in words.split()], np.int64) for _, _, _, words in held]
            found = repeated_windows(segments, [c for _, _, c, _ in held], width)
            masks = [int(np.sum(np.int64(1) << np.flatnonzero(f).astype(np.int64))) if f.any() else 0 for f in found]
            keep = [i for i, m in enumerate(masks) if m]
            return pa.RecordBatch.from_arrays([pa.array([held[i][0] for i in keep], pa.int64()), pa.array([held[i][1] for i in keep], pa.int64()), pa.array([masks[i] for i in keep], pa.int64())], ["id1", "id2", "mask"])

        for batch in parts:
            for key, id1, id2, copies, words in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if size >= SHARD_WORDS and key != last:
                    yield searched()
                    held, size = [], 0
                held.append((id1, id2, copies, words))
                size += words.count(b" ") + 1
                last = key
        if held:
            yield searched()

    return pieces.repartition("key").sortWithinPartitions("key").mapInArrow(run, "id1 long, id2 long, mask long")


def repeated_masks(marked: DataFrame, docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """((row, blob) of the documents that share a minimizer, (row, start, mask) of their pieces with repeated windows)."""
    segs = marked.select("row", F.explode("segs").alias("x")).select("row", "x.h", "x.s", "x.start", "x.k", "x.c")
    shared = segs.groupBy("h").agg(F.sum("c").alias("n")).where("n > 1").select("h")
    hits = stored(segs.drop("c").join(shared, "h"), "hits")
    different = hits.groupBy("h", "s").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "start", "k")).alias("at"), F.max(F.struct("row", "start", "k")).alias("last")).select("h", "s", "n", "at.*", "last")
    different = stored(different, "segments")
    hot = different.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > HOT_SEGMENTS).select("h")
    active = stored(_packed(docs).join(hits.select("row").distinct(), "row", "left_semi"), "active")
    copies = F.least("n", F.lit(2)).cast("int").alias("copies")
    plain = different.join(hot, "h", "left_anti").select("row", F.col("h").alias("key"), F.col("h").alias("id1"), F.col("s").alias("id2"), copies, "start", "k")
    masks = stored(search_shards(_cut(active, plain, width), width), "masks")
    # windows of hot minimizers: of those that occur twice by hash, two places are cut, each as one copy, so that the search decides
    spots = F.array_distinct(F.array(F.struct("row", "start", "k"), "last"))
    twofold = different.join(hot, "h", "left_semi").select("h", "s", "n", F.explode(spots).alias("at"), F.size(spots).alias("spots"))
    loose = stored(_windows(active, twofold.select("h", "s", F.when(F.col("spots") == 1, F.col("n")).otherwise(1).alias("n"), "at.*"), width), "windows")
    place = F.struct("row", "at")
    ends = loose.groupBy("w").agg(F.sum("n").alias("n"), F.min(place).alias("p"), F.max(place).alias("q")).where("n > 1")
    # only where equal rows are one place is it two copies
    places = ends.select("w", F.when(F.col("p") == F.col("q"), 2).otherwise(1).alias("copies"), F.explode(F.array_distinct(F.array("p", "q"))).alias("p"))
    again = places.select("p.row", F.col("w").alias("key"), F.col("w").alias("id1"), F.lit(0).cast("long").alias("id2"), F.col("copies").cast("int").alias("copies"), F.col("p.at").alias("start"), F.lit(1).alias("k"))
    twice = search_shards(_cut(active, again, width), width).where("mask <> 0").select(F.col("id1").alias("w")).distinct()
    from_hot = loose.join(twice, "w").groupBy("h", "s").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("i"))).alias("mask"))
    every = masks.select(F.col("id1").alias("h"), F.col("id2").alias("s"), "mask").unionByName(from_hot)
    return active, hits.select("row", "h", "s", "start").join(every, ["h", "s"]).select("row", "start", "mask")


def _windows(active: DataFrame, segments: DataFrame, width: int) -> DataFrame:
    """(w, h, s, i, n, row, at): each window of the segments, with its hash."""
    pieces = segments.groupBy("row").agg(F.collect_list(F.struct("h", "s", "n", "start", "k")).alias("pieces"))

    def run(parts):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in parts:
            out = [[] for _ in range(7)]
            for row, blob, pieces_ in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = np.frombuffer(unpack(blob), np.uint8)
                words, _, _, _ = hash_words(data, np.array([0, len(data)]))
                own = _window_hash(words, grams(words, min(GRAM, width)), width).view(np.int64)
                for p in pieces_:
                    for i in range(p["k"]):
                        for column, value in zip(out, (int(own[p["start"] + i]), p["h"], p["s"], i, p["n"], row, p["start"] + i), strict=True):
                            column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["w", "h", "s", "i", "n", "row", "at"])

    return active.join(pieces, "row").select("row", "blob", "pieces").mapInArrow(run, "w long, h long, s long, i int, n long, row long, at int")


def spans(starts: list[int], masks: list[int], width: int, n: int) -> np.ndarray:
    """Which of n words lie in a repeated window."""
    change = np.zeros(n + 1, np.int64)
    for start, mask in zip(starts, masks, strict=True):
        i = 0
        while mask >> i:
            if mask >> i & 1:
                change[start + i] += 1
                change[start + i + width] -= 1
            i += 1
    return np.cumsum(change[:n]) > 0


def substring_dedup(df: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept]) of each row: without the words in a window of width words that starts anywhere else too.

    Windows lie in one text and are judged on the input, so all copies of a repeated passage go. kept: the other words
    joined by one space; kept_sha256: of its UTF-8 bytes. Null and empty texts have no words. Repeated rows count as
    occurrences and each get their own row. Other columns are ignored, whatever their names. An empty table gives no
    rows. width is 2 at least, and less than 64 + 8. Rows are told apart by 64-bit hashes of id and text.
    """
    marked = stored(segments_of(df, width, id_col, text_col), "segs")
    active, found = repeated_masks(marked, _rows(df, id_col, text_col), width)
    marks = found.groupBy("row").agg(F.collect_list("start").alias("starts"), F.collect_list("mask").alias("masks"))

    def run(parts):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in parts:
            gone, digest, text = [], [], []
            for blob, starts, masks in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                words = unpack(blob).split()
                out = spans(starts, masks, width, len(words))
                kept = b" ".join([w for w, o in zip(words, out.tolist(), strict=True) if not o])
                gone.append(int(out.sum()))
                digest.append(hashlib.sha256(kept).hexdigest())
                text.append(kept.decode("utf-8", "replace") if with_text else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(text, pa.string())], ["row", "n_removed", "digest", "kept"])

    cut = active.dropDuplicates(["row"]).join(marks, "row").select("row", "blob", "starts", "masks").mapInArrow(run, "row long, n_removed long, digest string, kept string")
    out = marked.select("id", "row", "n_words", "plain_sha256").join(cut, "row", "left")
    columns = [F.col("id").alias(id_col), F.col("n_words"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("digest", "plain_sha256").alias("kept_sha256")]
    return out.select(*columns, *([F.col("kept")] if with_text else []))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS MATERIALIZED (SELECT r, i, md5(list_aggregate(w[i:i + 34], 'string_agg', ' ')) AS k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY k) > 1),
gone AS MATERIALIZED (SELECT r, list(DISTINCT p) AS ps FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM rep) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
    sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_select(w, list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(ps, i))) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN gone USING (r)
"""
