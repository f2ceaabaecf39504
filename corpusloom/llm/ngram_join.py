"""N-gram Jaccard join: a blocked sparse product of the document by n-gram matrix with itself.

A document's row of the matrix is its set of shingles. All rows are read in one order of the columns, in which columns
that many documents hold come last; a row's prefix in that order is long enough that two documents that link share a
column in it. Columns of prefixes name the blocks: all documents that hold a column go to the block of the column's
least document, so each pair that shares one meets in a block.

1. In each block the prefix rows are multiplied. A pair whose accumulated overlap is below the least that its sizes
   allow is discarded; the pairs that stay tie documents into families.
2. In each family the whole rows are multiplied, and the pairs that reach the threshold are links. A task puts out links
   that span what it has connected, never its pairs.
3. A block too large for a task is cut into tiles: each tile with itself first, then, of the documents that are still
   outside the block's main component, each tile of them with each tile of the block.

Tables of pairs are never made: what is shuffled is a row for each column of a prefix, a row for each document and block,
and the texts of documents in families.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import table, unused
from corpusloom.llm.wordhash import grams, hash_words, mix, steps
from corpusloom.operators.filters import parted
from corpusloom.operators.graph import connected
from corpusloom.storage import discard, released, stored

#: Documents beyond which a column counts as common. Any order of the columns gives the same links; this one is cheap.
COMMON = 24
#: Bits of the filter of common columns and of that of wanted ids: 2 MB each, whatever the corpus.
FILTER_BITS = 24
#: Documents, and shingles of their whole sets, in a tile.
TILE_DOCS, TILE_SHINGLES = 1_024, 2_000_000
#: Hashes that a task holds while it looks for columns that repeat.
CHUNK = 4_000_000
#: Sets that a task remembers, so as to send copies once; beyond them it sends some again, which is harmless.
_REMEMBERED = 200_000
#: Entries of a dense piece of the matrix.
_DENSE = 8_000_000
_TOP = np.uint64(1 << 63)
_LOW = np.uint64((1 << FILTER_BITS) - 1)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text in turn its distinct k-word shingles as sorted hashes: all words as one if they are fewer, none if there are none."""
    for _, data, offsets in steps(column):
        words, _, _, first = hash_words(data, offsets, fold=True)
        all_ = grams(words, k)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= k:
                yield np.unique(all_[a : b - k + 1])
            elif b > a:
                yield mix(grams(words[a:b], int(b - a)) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def digest_of(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def prefix_length(n, percent: int):
    """n less the least overlap with any partner, plus one."""
    return n - -(-n * percent // 100) + 1


# --- the product, in numpy ----------------------------------------------------------------------------------------


def overlaps(rows: list[np.ndarray]) -> np.ndarray:
    """The product of the incidence matrix with its transpose: how many columns each two rows share, 0 for a row with itself.

    Columns that one row alone holds add nothing and are left out. Columns that few rows hold add their pairs; the
    others are multiplied as dense pieces.
    """
    b = len(rows)
    _, column = np.unique(np.concatenate(rows), return_inverse=True)
    row = np.repeat(np.arange(b), [len(r) for r in rows])
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    start = np.flatnonzero(np.diff(column, prepend=-1))
    count = np.diff(start, append=len(column))
    out = np.zeros((b, b), np.int64)
    few = max(4, b // 24)
    for c in np.unique(count[(count > 1) & (count <= few)]):
        held = row[start[count == c][:, None] + np.arange(c)]
        i, j = np.triu_indices(c, 1)
        out += np.bincount((held[:, i] * b + held[:, j]).ravel(), minlength=b * b).reshape(b, b)
    out += out.T
    many = np.flatnonzero(count > few)
    wide = max(1, _DENSE // b)
    for k in range(0, len(many), wide):
        part = many[k : k + wide]
        size = count[part]
        entry = np.repeat(start[part] - np.cumsum(size) + size, size) + np.arange(size.sum())
        dense = np.zeros((b, len(part)), np.float32)
        dense[row[entry], np.repeat(np.arange(len(part)), size)] = 1
        out += (dense @ dense.T).astype(np.int64)
    np.fill_diagonal(out, 0)
    return out


def component_of(linked: np.ndarray) -> np.ndarray:
    """The least row that each row of a symmetric matrix of links reaches."""
    b = len(linked)
    linked = linked | np.eye(b, dtype=bool)
    label = np.arange(b)
    while True:
        new = np.where(linked, label[None, :], b).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _sizes(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return n[:, None], n[None, :]


def may_link(n: np.ndarray, last: np.ndarray, shared: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs can still link, by their sizes, the ends of their prefixes and the overlap of the prefixes.

    Of the document whose prefix ends first, all of the prefix that the other one holds is in the other one's prefix; so
    what it lacks there it lacks altogether, and it may lack no more than its size less the overlap needed.
    """
    a, b = _sizes(n)
    needed = -(-percent * (a + b) // (100 + percent))
    spare = prefix_length(n, percent) - n
    spare_a, spare_b = _sizes(spare)
    least = np.where(last[:, None] <= last[None, :], spare_a, spare_b) + needed
    return (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (shared >= np.maximum(least, 1))


def links(n: np.ndarray, shared: np.ndarray, percent: int) -> np.ndarray:
    a, b = _sizes(n)
    return (shared > 0) & (100 * shared >= percent * (a + b - shared))


# --- from texts to rows -------------------------------------------------------------------------------------------


def signatures(df: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, n, c1, c2): the size of the set and a 128-bit digest of it, a row a row of df; and, in rows of their own
    whose c1 is null, (common, docs): the columns that several sets of a task hold, and how many."""

    def summary(held):
        x, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        columns = [pa.nulls(1, pa.int64()), pa.array([0], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())]
        lists = [pa.array([v], kind) for v, kind in (((x[n > 1]).view(np.int64), pa.list_(pa.int64())), (n[n > 1].astype(np.int32), pa.list_(pa.int32())))]
        return pa.RecordBatch.from_arrays([*columns, *lists], ["doc", "n", "c1", "c2", "common", "docs"])

    def run(parts):
        seen: set[bytes] = set()
        held, size = [], 0
        for batch in parts:
            ns, c1, c2 = [], [], []
            for own in shingle_sets(batch.column(1), k):
                digest = digest_of(own)
                ns.append(len(own))
                c1.append(_key(digest))
                c2.append(_key(digest[8:]))
                if digest not in seen and len(own):
                    held.append(own)
                    size += len(own)
                if len(seen) < _REMEMBERED:
                    seen.add(digest)
                if size > CHUNK:
                    yield summary(held)
                    held, size = [], 0
            none = [pa.nulls(batch.num_rows, pa.list_(pa.int64())), pa.nulls(batch.num_rows, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int32()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), *none], ["doc", "n", "c1", "c2", "common", "docs"])
        yield summary(held)

    rows = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc long, n int, c1 long, c2 long, common array<long>, docs array<int>")


def bit_filter(values: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS bits, of fixed size: a bit is set for the low bits of each value. It passes all values, and some others."""
    bit = F.col("v").bitwiseAND(F.lit(int(_LOW)))
    words = values.toDF("v").select(F.shiftright(bit, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int")).alias("bits"))
    found = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # 2^18 rows at most
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def passes(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values & _LOW
    return ((bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def prefixes(df: DataFrame, common: np.ndarray, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(c1, n, last, ys): the columns of each set's prefix, common ones last, and the last of them. Copies within a task are sent once."""
    held = df.sparkSession.sparkContext.broadcast(common)  # of fixed size

    def run(parts):
        bits = held.value
        seen: set[bytes] = set()
        for batch in parts:
            c1, ns, lasts, ys = [], [], [], []
            for own in shingle_sets(batch.column(0), k):
                n = len(own)
                if not n or (digest := digest_of(own)) in seen:
                    continue
                if len(seen) < _REMEMBERED:
                    seen.add(digest)
                late = passes(bits, own)
                # the top bit tells a common column, so that numbers stand in the order of the columns
                y = np.concatenate([own[~late] >> np.uint64(1), own[late] >> np.uint64(1) | _TOP])[: prefix_length(n, percent)]
                y = (y ^ _TOP).view(np.int64)
                c1.append(_key(digest))
                ns.append(n)
                lasts.append(int(y[-1]))
                ys.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(c1, pa.int64()), pa.array(ns, pa.int32()), pa.array(lasts, pa.int64()), pa.array(ys, pa.list_(pa.int64()))], ["c1", "n", "last", "ys"])

    return df.where(F.col(id_col).isNotNull()).select(F.col(text_col).alias("text")).mapInArrow(run, "c1 long, n int, last long, ys array<long>")


def members_of(prefix: DataFrame) -> DataFrame:
    """(pivot, c1, n, last, ys), stored: for each document the blocks it goes to, and the columns of its prefix that others hold.

    The columns are exchanged once to find those that are shared, and, once these shuffle files are gone, again with
    their documents: both at a time would be most of the disk that the join takes.
    """
    postings = prefix.select("c1", F.explode("ys").alias("y"))
    shared = postings.groupBy("y").agg(F.min("c1").alias("pivot"), F.max("c1").alias("most")).where("pivot <> most").select("y", "pivot")
    shared = stored(shared, "shared")
    released(prefix.sparkSession)
    # as many rows as the document's prefix has columns
    own = postings.join(shared, "y").groupBy("c1").agg(F.collect_set("y").alias("ys"), F.collect_set("pivot").alias("pivots"))
    sizes = prefix.select("c1", "n", "last").distinct()
    out = stored(own.join(sizes, "c1").select(F.explode("pivots").alias("pivot"), "c1", "n", "last", "ys"), "members")
    discard(shared)
    return out


def wanted_texts(df: DataFrame, ids: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(c1, blob): the packed texts, and the first half of their sets' digests, of rows whose id passes a filter of ids. Others pass too."""
    held = df.sparkSession.sparkContext.broadcast(bit_filter(ids.select(F.xxhash64("doc"))))

    def run(parts):
        press = zstandard.ZstdCompressor(level=3).compress
        seen: set[bytes] = set()
        for batch in parts:
            batch = batch.filter(pa.array(passes(held.value, batch.column(0).to_numpy().view(np.uint64))))
            keys, blobs = [], []
            texts = batch.column(1)
            for i, own in enumerate(shingle_sets(texts, k)):
                digest = digest_of(own)
                if digest not in seen:
                    keys.append(_key(digest))
                    blobs.append(press((texts[i].as_py() or "").encode()))
                if len(seen) < _REMEMBERED:
                    seen.add(digest)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], ["c1", "blob"])

    rows = df.where(F.col(id_col).isNotNull()).select(F.xxhash64(F.col(id_col).cast("long")).alias("h"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "c1 long, blob binary")


# --- blocks and families ------------------------------------------------------------------------------------------


def _groups(parts, keys: int) -> Iterator[list[tuple]]:
    """The rows of each group, of batches sorted by their first `keys` columns, as tuples."""
    held: list[tuple] = []
    for batch in parts:
        for row in zip(*(_values(c) for c in batch.columns), strict=True):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _values(column: pa.Array) -> list:
    if pa.types.is_list(column.type):
        flat, at = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
        return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    return column.to_pylist()


def _mixed(*numbers: int) -> int:
    return _key(hashlib.blake2b(repr(numbers).encode(), digest_size=8).digest())


def families(rows: DataFrame, percent: int) -> DataFrame:
    """(family, c1): the documents of each tile that pairs which may link tie together. rows: (pivot, tile, left, c1, n,
    last, ys, comp): left tells the documents that are compared with all others of the tile; two of one comp are not compared."""

    def run(parts):
        for group in _groups(parts, 2):
            # a document may be on both sides of a tile, and sent by several tasks
            rows_ = {}
            for _, _, left, c1, n, last, ys, comp in group:
                known = rows_.get((c1, n, last))
                rows_[c1, n, last] = (left or bool(known and known[0]), c1, n, last, ys, comp)
            if len(rows_) < 2:
                continue
            left, c1, n, last, ys, comp = (list(x) for x in zip(*rows_.values(), strict=True))
            left = np.array(left)
            maybe = may_link(np.array(n, np.int64), np.array(last, np.int64), overlaps(ys), percent) & (left[:, None] | left[None, :])
            np.fill_diagonal(maybe, False)
            code = {x: i for i, x in enumerate(dict.fromkeys(comp))}
            known = np.array([code[x] for x in comp])
            told = np.array([x is not None for x in comp])
            maybe &= ~((known[:, None] == known[None, :]) & told[:, None] & told[None, :])
            if not maybe.any():
                continue
            label = component_of(maybe)
            size = np.bincount(label, minlength=len(label))
            pivot, tile = group[0][:2]
            names = {}
            for i in np.flatnonzero(size[label] > 1):
                names.setdefault(label[i], []).append(c1[i])
            out = [((min(own) if tile == "" else _mixed(min(own), pivot, tile)), c) for own in names.values() for c in own]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in out], pa.int64()), pa.array([c for _, c in out], pa.int64())], ["family", "c1"])

    dealt = rows.select("pivot", "tile", "left", "c1", "n", "last", "ys", "comp").repartition("pivot", "tile").sortWithinPartitions("pivot", "tile")
    return dealt.mapInArrow(run, "family long, c1 long").distinct()


def verified_links(found: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links between digests of sets, enough to connect what the links within each family connect."""

    def run(parts):
        unpack = zstandard.ZstdDecompressor().decompress
        for group in _groups(parts, 1):
            texts_ = pa.array([unpack(blob).decode() for _, blob in group], pa.large_string()).cast(pa.string())
            sets = {digest_of(own): own for own in shingle_sets(texts_, k) if len(own)}
            if len(sets) < 2:
                continue
            digests, rows = list(sets), list(sets.values())
            linked = links(np.array([len(r) for r in rows], np.int64), overlaps(rows), percent)
            label = component_of(linked)
            out = [(digests[i], digests[j]) for i, j in enumerate(label) if i != j]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], ["a", "b"])

    rows = found.join(texts, "c1").select("family", "blob")
    return rows.repartition("family").sortWithinPartitions("family").mapInArrow(run, "a binary, b binary")


def _node() -> Column:
    """The digest of a set as it stands in links."""
    return F.unhex(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in ("c1", "c2"))))


def _of(hash_: Column, tiles: Column) -> Column:
    return F.pmod(F.xxhash64(hash_), tiles).cast("string")


def links_of(members: DataFrame, classes: DataFrame, df: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> list[DataFrame]:
    """Tables of links (a, b) between digests, which together connect what all links connect."""
    tiles = F.greatest(F.ceil(F.count(F.lit(1)) / TILE_DOCS), F.ceil(F.sum("n") / TILE_SHINGLES))
    large = stored(members.groupBy("pivot").agg(tiles.cast("long").alias("tiles")).where("tiles > 1"), "large")
    some_large = not large.isEmpty()
    rows = members.select("*", F.lit(True).alias("left"), F.lit(None).cast("binary").alias("comp"))
    if some_large:
        cut = rows.join(large, "pivot", "left")
        every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda i: i.cast("string"))
        # the pivot is in each of its block's tiles, so that they hang together
        tile = F.when(F.col("tiles").isNull(), F.array(F.lit(""))).when(F.col("c1") == F.col("pivot"), every).otherwise(F.array(_of(F.col("c1"), F.col("tiles"))))
        rows = cut.withColumn("tile", F.explode(tile))
    else:
        rows = rows.withColumn("tile", F.lit(""))
    found = stored(families(rows, percent), "families")
    wanted = found.select("c1")
    if some_large:
        in_large = stored(members.join(large, "pivot"), "in_large")
        wanted = wanted.union(in_large.select("c1"))
    ids = classes.join(wanted.distinct(), "c1", "left_semi").select("doc")
    texts = stored(wanted_texts(df, ids, k, id_col, text_col), "texts")
    out = [stored(verified_links(found, texts, k, percent), "found")]
    if some_large:
        found2 = stored(families(_rest(in_large, classes, connected(out[0])), percent), "families")
        out.append(stored(verified_links(found2, texts, k, percent), "found"))
        discard(found2, in_large)
    discard(found, texts, large)
    return out


def _rest(in_large: DataFrame, classes: DataFrame, comps: DataFrame) -> DataFrame:
    """The rows of the second round: of each large block the documents outside its main component, in tiles, with all tiles of the block."""
    known = classes.select("c1", "node").join(comps, "node", "left").groupBy("c1").agg(F.min(F.coalesce("comp", "node")).alias("comp"), F.count(F.lit(1)).alias("sets"))
    # two sets of one c1 are taken for unconnected with anything
    rows = in_large.join(known.select("c1", F.when(F.col("sets") == 1, F.col("comp")).alias("comp")), "c1")
    main = rows.where("comp IS NOT NULL").groupBy("pivot", "comp").count().groupBy("pivot").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"))
    rows = rows.join(main, "pivot", "left").withColumn("left", ~F.coalesce(F.col("comp") == F.col("main"), F.lit(False)))
    halves = F.greatest(F.ceil(F.sum(F.col("left").cast("int")) / TILE_DOCS), F.ceil(F.sum(F.when(F.col("left"), F.col("n")).otherwise(0)) / TILE_SHINGLES))
    open_ = rows.groupBy("pivot").agg(halves.cast("long").alias("parts")).where("parts > 0")
    rows = stored(rows.join(open_, "pivot"), "open")
    upto = lambda n: F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), lambda i: i.cast("string"))
    i, j = _of(F.concat(F.lit("i"), F.col("c1").cast("string")), F.col("parts")), _of(F.concat(F.lit("j"), F.col("c1").cast("string")), F.col("tiles"))
    lefts = rows.where("left").withColumn("other", F.explode(upto("tiles"))).withColumn("tile", F.concat_ws("/", i, "other"))
    rights = rows.withColumn("left", F.lit(False)).withColumn("other", F.explode(upto("parts"))).withColumn("tile", F.concat_ws("/", "other", j))
    return lefts.union(rights.select(lefts.columns))


def ngram_components(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of each row: documents link when the Jaccard similarity of their sets of k-word shingles is percent / 100 or more.

    A-Z count as a-z. Fewer than k words count as one shingle. Texts that are null or without words have an empty set
    and link with nothing. Equal sets always link. component_id is the least id that links reach. A row with a null id
    has a null component_id and links nothing; rows that share an id share a component, whatever their texts. Ids are
    whole numbers. Other columns of df are ignored, whatever their names. An empty table gives no rows. Shingles are
    told apart by 64-bit hashes, sets by 128-bit digests.
    """
    every = stored(signatures(df, k, id_col, text_col), "signatures")
    sig = every.where("c1 IS NOT NULL").select("doc", "n", "c1", "c2")
    columns = every.where("common IS NOT NULL").select(F.explode(F.arrays_zip("common", "docs")).alias("x"))
    common = bit_filter(columns.groupBy("x.common").agg(F.sum("x.docs").alias("held")).where(F.col("held") > COMMON).select("common"))
    prefix = stored(prefixes(df, common, k, percent, id_col, text_col), "prefix")
    members = members_of(prefix)
    discard(prefix)
    ids = sig.where(F.col("doc").isNotNull() & (F.col("n") > 0))
    classes = stored(ids.groupBy("c1", "c2").agg(F.min("doc").alias("doc")).withColumn("node", _node()), "classes")
    found = links_of(members, classes, df, k, percent, id_col, text_col)
    discard(members)
    # documents of one id belong together even where their sets differ
    again = ids.groupBy("doc").agg(F.min(F.struct("c1", "c2")).alias("least"), F.max(F.struct("c1", "c2")).alias("most")).where("least <> most").select("doc", _node_of("least").alias("a"))
    same_id = ids.join(again, "doc").select("a", _node().alias("b")).where("a <> b").distinct()
    all_links = same_id
    for x in found:
        all_links = all_links.unionByName(x)
    comps = connected(all_links)
    discard(*found)
    named = classes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("doc").alias("component_id"))
    known = named.join(least, "comp").select("c1", "c2", "component_id")
    rows = sig.select("doc", F.col("n").cast("long").alias("n_shingles"), "c1", "c2").join(known, ["c1", "c2"], "left")
    component = F.when(F.col("doc").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc")).otherwise(F.col("component_id"))
    return rows.select(F.col("doc").alias(id_col), "n_shingles", component.cast("long").alias("component_id"))


def _node_of(column: str) -> Column:
    return F.unhex(F.concat(*(F.lpad(F.hex(f"{column}.{c}"), 16, "0") for c in ("c1", "c2"))))


def one_of_each(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, whose id is the least of its component; see ngram_components().

    Of rows that share an id one stays, the least by its text and then its other columns; rows with a null id all stay.
    Texts that are null or without words stay, one an id. Column names don't matter; an empty table gives no rows.
    """
    found = stored(ngram_components(df, k, percent, id_col, text_col), "components")
    own, place = unused(df, "own"), unused(df, "place")
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).cast("long").alias(own)).distinct()
    # most rows stay, and those that a filter tells to are not shuffled
    some, rest = parted(df.where(F.col(id_col).isNotNull()), F.xxhash64(F.col(id_col).cast("long")), gone.select(F.xxhash64(own)))
    out = rest.unionByName(some.join(gone, F.col(id_col).cast("long") == F.col(own), "left_anti"))
    if not found.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty():
        # the least text of an id, so that each run keeps the same row
        order = Window.partitionBy(id_col).orderBy(text_col, *(c for c in df.columns if c not in (id_col, text_col)))
        out = out.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place)
    return out.unionByName(df.where(F.col(id_col).isNull()))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), k=4, percent=85)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, list_aggregate(w[i:i + 3], 'string_agg', ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS MATERIALIZED (SELECT doc_id, x FROM s QUALIFY count(*) OVER (PARTITION BY x) > 1),
pairs AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS hits FROM shared a JOIN shared b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * hits >= 85 * (na.n + nb.n - hits)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)
"""
