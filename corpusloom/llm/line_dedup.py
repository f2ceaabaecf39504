"""Line dedup: a segment-partition edit join of all distinct lines.

Lines within `edits` edits of each other share, unedited, one of the edits + 1 segments of the shorter line. So each line
is indexed by its own segments, and probes the segments of lines of its length and up to `edits` shorter ones by the
substrings that can match them (the multi-match-aware positions). Candidates are verified by a banded bit-parallel edit
distance.

Of any edits + 1 disjoint parts of a line one stays unedited. So lines that share a segment with very many others, as
headings or log lines do, are cut again into more and shorter parts, and each is indexed by the rarest edits + 1 of
these: a common beginning then brings no pairs, whatever the size of the family. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import bound, table, unused
from corpusloom.operators.filters import maybe_among, parted
from corpusloom.storage import discard, released, stored

EDITS = 2
#: A pair of lines may differ by one edit for each so many characters of the shorter one, and by `edits` at most.
CHARS_PER_EDIT = 12
#: Different lines of one segment beyond which they are indexed by rarer parts.
GROUP = 16
#: Shared segments up to which they are sent to all tasks (16 bytes each); beyond, a filter of fixed size is, and what passes is shuffled.
SMALL_KEYS = 500_000
_SPACE = " \t\n\x0b\x0c\r"
_LOW = 15


def allowed(a: Column, b: Column, edits: int) -> Column:
    """The edits by which lines of a and b characters may differ."""
    return F.least(F.lit(edits), F.floor(F.least(a, b) / CHARS_PER_EDIT).cast("int"))


def segment(length: Column, i: Column, parts: Column) -> tuple[Column, Column]:
    """(first character from 1, characters) of part i of a line of that length: even parts, the longer ones last."""
    base, longer = F.floor(length / parts), F.pmod(length, parts)
    short = parts - longer
    return (1 + i * base + F.greatest(F.lit(0), i - short)).cast("int"), (base + F.when(i >= short, 1).otherwise(0)).cast("int")


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(difference of lengths, segment, shift) of the substrings to look up; difference 0 and shift 0 are the line's own segments, first."""
    own = [(0, i, 0) for i in range(edits + 1)]
    rest = [(d, i, s) for d in range(edits + 1) for i in range(edits + 1) for s in range(max(-i, d - (edits - i)), min(i, d + (edits - i)) + 1)]
    return own + [p for p in rest if p not in own]


def entries_of(lines: DataFrame, edits: int) -> DataFrame:
    """lines (..., line) with code and key: a row for each substring to look up that lies within the line; code is the number of the probe.

    Four bytes a character, so that no substring has to be searched for; and a row a substring rather than an array
    of them, whose code would be too long a method for the JVM to compile.
    """
    numbers = F.array(*(F.struct(F.lit(c).alias("code"), F.lit(d).alias("less"), F.lit(i).alias("i"), F.lit(s).alias("shift")) for c, (d, i, s) in enumerate(probes(edits))))
    units = lines.select("*", F.encode("line", "UTF-32").alias("units")).select("*", F.expr("CAST(octet_length(units) DIV 4 AS INT)").alias("chars"))
    each = units.where(F.col("chars") >= CHARS_PER_EDIT).select("*", F.explode(numbers).alias("p")).select("*", "p.*", F.expr("chars - p.less").alias("of"))
    base, longer = F.expr(f"CAST(of DIV {edits + 1} AS INT)").alias("base"), (edits + 1 - F.col("of") % (edits + 1)).alias("longer")
    placed = each.select("*", base, longer).select("*", F.expr("1 + i * base + greatest(0, i - longer) + shift").alias("first"), F.expr("base + if(i >= longer, 1, 0)").alias("size"))
    inside = placed.where("of >= 0 AND first >= 1 AND first + size - 1 <= chars")
    return inside.select(*lines.columns, "code", F.expr("xxhash64(of, i, substring(units, 4 * first - 3, 4 * size))").alias("key"))


def _fine(length: Column, edits: int) -> Column:
    """The number of parts into which a line of that length is cut again."""
    return F.greatest(F.lit(edits + 1), F.least(F.lit(8 * (edits + 1)), F.floor(length / 4))).cast("int")


def fine_keys(line: Column, length: Column, less: int, shift: int, edits: int) -> Column:
    """The keys of all parts of a line `less` characters shorter, as they would stand in this one, moved by shift; null where they would leave it."""

    def key(i: Column) -> Column:
        first, chars = segment(length - less, i, _fine(length - less, edits))
        inside = (first + shift >= 1) & (first + shift + chars - 1 <= length)
        return F.when(inside, F.xxhash64(length - less, i, F.substring(line, first + shift, chars)))

    return F.transform(F.sequence(F.lit(0), _fine(length - less, edits) - 1), key)


def banded_distance(a: Column, b: Column, edits: int) -> Column:
    """The edit distance of two strings if it is edits at most, else edits + 1: bit-parallel in a band of 2 * edits + 1 diagonals.

    Bit k of a word stands for row column + k - edits; the vertical differences of a column are held as bits, and the
    score follows the lowest diagonal down and then the last row.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    top = 1 << (width - 1)

    def with_chars(c: Column) -> Column:
        p, t = c["p"], c["t"]
        m, n = F.size(p), F.size(t)

        def step(acc: Column, j: Column) -> Column:
            ch = F.get(t, j)
            match = F.lit(0)
            for k in range(width):
                match = match + F.when((j + (k - edits) >= 0) & (F.get(p, F.greatest(j + (k - edits), F.lit(0))) == ch), 1 << k).otherwise(0)

            def rest(x: Column) -> Column:
                vp, vn = acc["vp"], acc["vn"]
                d0 = (((x.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(x).bitwiseOR(vn)).bitwiseAND(F.lit(full))

                def after(d: Column) -> Column:
                    hp = vn.bitwiseOR(F.bitwise_not(d.bitwiseOR(vp))).bitwiseAND(F.lit(full))
                    hn = d.bitwiseAND(vp)
                    down = F.shiftright(d, 1)
                    # the bit of the last row, once the band has reached it; before that the lowest diagonal
                    row = m - 1 - j + edits
                    at = F.when(row >= width - 1, F.lit(0)).otherwise(F.call_function("shiftleft", F.lit(1), F.greatest(row, F.lit(0))))
                    on = lambda bits, mask: F.when(bits.bitwiseAND(mask) != 0, 1).otherwise(0)
                    score = acc["score"] + F.when(row >= width - 1, 1 - on(d, F.lit(top))).otherwise(on(hp, at) - on(hn, at))
                    return F.struct(hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)).bitwiseAND(F.lit(full))).alias("vp"), down.bitwiseAND(hp).alias("vn"), score.alias("score"))

                return bound(d0, after)

            return bound(match.cast("int"), rest)

        # the score at the start is that of the lowest diagonal's first row
        init = F.struct(F.lit(full & ~((1 << edits) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("score"))
        run = F.aggregate(F.sequence(F.lit(0), n - 1), init, step, lambda acc: acc["score"])
        least = F.least(F.levenshtein(a, b), F.lit(edits + 1))  # strings no longer than the band
        return F.when(F.abs(m - n) > edits, F.lit(edits + 1)).when((m <= edits) | (n == 0), least).otherwise(F.least(run, F.lit(edits + 1)))

    chars = lambda x: F.split(x, "")
    longer = F.length(a) >= F.length(b)
    return bound(F.struct(chars(F.when(longer, a).otherwise(b)).alias("p"), chars(F.when(longer, b).otherwise(a)).alias("t")), with_chars)


def _blank(line: Column) -> Column:
    return F.btrim(line, F.lit(_SPACE)) == ""


def _place(df: DataFrame) -> Column:
    """One value in the order of (id, pos), null ids first. For whole numbers one number, whose least is kept without a sort."""
    kind = dict(df.dtypes)["id"]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        return F.struct("id", "pos")
    null = F.lit("-1" + "0" * 30).cast("decimal(38,0)")
    return (F.coalesce(F.col("id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(12,0)"), null) + F.col("pos")).cast("decimal(38,0)")


def _lines(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(*(c for c in docs.columns if c != "text"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return own.where(~_blank(F.col("line")))


def lines_of(docs: DataFrame) -> DataFrame:
    """(row, pos, at, h, line) of each line with a word. row stands for an (id, text) pair, h for the line's text, at for its place."""
    own = _lines(docs)
    return own.select("row", "pos", _place(own).alias("at"), _text_id(F.col("line")).alias("h"), "line")


def _text_id(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _candidates(lines: DataFrame, edits: int) -> DataFrame:
    """(key, h, code, line): the entries of keys that two different lines or more share."""
    every = entries_of(lines.select("line"), edits)
    # equal lines meet map-side, so that a very common line is a row a key and task; a few bits less of the line's hash
    # than it has, and its lowest code in their place, make one number of each entry
    number = F.xxhash64("line").bitwiseAND(F.lit(~_LOW)).bitwiseOR(F.col("code").cast("long"))
    spread = every.select("key", number.alias("v")).groupBy("key").agg(F.min("v").alias("least"), F.max("v").alias("most"))
    shared = stored(spread.where(F.shiftright("least", 4) != F.shiftright("most", 4)).select("key"), "keys")
    released(lines.sparkSession)
    if shared.limit(SMALL_KEYS + 1).count() <= SMALL_KEYS:
        held = every.join(F.broadcast(shared), "key").withColumn("h", _text_id(F.col("line")))
        out = stored(held.groupBy("key", "h").agg(F.min("code").alias("code"), F.first("line").alias("line")), "entries")
    else:
        # a line has some dozen entries: what is shuffled for each of them is its hash, and each text that is needed once
        held = maybe_among(every, "key", shared).select("key", _text_id(F.col("line")).alias("h"), "code").join(shared, "key")
        held = stored(held.groupBy("key", "h").agg(F.min("code").alias("code")).withColumn("short", F.xxhash64("h")), "held")
        released(lines.sparkSession)
        texts = maybe_among(lines.select("h", "line", F.xxhash64("h").alias("short")), "short", held.select("short"))
        out = stored(held.drop("short").join(texts.groupBy("h").agg(F.first("line").alias("line")), "h").select("key", "h", "code", "line"), "entries")
        discard(held)
    discard(shared)
    return out


def _late(entries: DataFrame, others: DataFrame, on: str, needs: Column, edits: int) -> DataFrame:
    """(late) of each two lines that meet and are near: columns a_... of entries and b_... of others.

    Pairs are verified where they meet, and never written: the compiled distance, which stops beyond the threshold, is
    part of the join; the few pairs that it leaves go through the bit-parallel one, with the threshold of their lengths.
    """
    maybe = F.levenshtein("a_line", "b_line", edits) >= 0
    both = entries.join(others, on).where((F.col("a_h") != F.col("b_h")) & needs & maybe)
    near = banded_distance(F.col("a_line"), F.col("b_line"), edits) <= allowed(F.length("a_line"), F.length("b_line"), edits)
    return both.where(near).select(F.when(F.col("a_at") < F.col("b_at"), F.col("b_h")).otherwise(F.col("a_h")).alias("late")).distinct()


def _side(df: DataFrame, on: str, prefix: str) -> DataFrame:
    return df.select(on, *(F.col(c).alias(prefix + c) for c in df.columns if c != on))


def near_lines(lines: DataFrame, first: DataFrame, edits: int) -> DataFrame:
    """(h) of the lines that are within the edits allowed of a line whose first place is earlier. first: (h, at), the first places."""
    found = _candidates(lines, edits)
    entries = stored(found.select("key", "h", "line", (F.col("code") <= edits).alias("own")).join(first, "h"), "entries")
    discard(found)
    groups = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("at", "h", "line")).alias("lead")).where("n > 1")
    groups = stored(groups, "groups")
    # all pairs of a small group; of a large one each line with the earliest, which settles most of a family of variants
    small = entries.join(groups.where(F.col("n") <= GROUP).select("key"), "key")
    earlier = (F.col("a_at") < F.col("b_at")) & (F.col("a_own") | F.col("b_own"))
    pairs = _late(_side(small, "key", "a_"), _side(small, "key", "b_"), "key", earlier, edits)
    large = groups.where(F.col("n") > GROUP)
    star = _late(_side(entries, "key", "a_"), _side(large.select("key", "lead.*"), "key", "b_"), "key", F.lit(True), edits)
    settled = stored(pairs.union(star).distinct(), "settled")
    if not large.isEmpty():
        hot = entries.join(large.select("key"), "key").groupBy("h").agg(F.first("at").alias("at"), F.first("line").alias("line"))
        hot = stored(hot.join(settled.select(F.col("late").alias("h"), F.lit(True).alias("done")), "h", "left"), "hot")
        settled = settled.union(stored(_rare_late(hot, edits), "settled")).distinct()
    discard(groups)
    return settled.withColumnRenamed("late", "h")


def _rare_late(hot: DataFrame, edits: int) -> DataFrame:
    """(late) of hot lines that share one of the rarest edits + 1 parts of the shorter one and are near, where the later one isn't settled."""
    # dealt anew: each line becomes a few hundred rows, which the few files of hot would leave to a few tasks
    sized = hot.repartition("h").select("h", "line", F.length("line").alias("length"))
    line, length = F.col("line"), F.col("length")
    own = sized.select("h", F.explode(fine_keys(line, length, 0, 0, edits)).alias("part"))
    counts = own.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # as many rows as a line has parts
    ranked = own.join(counts, "part").groupBy("h").agg(F.sort_array(F.collect_list(F.struct("n", "part"))).alias("parts"))
    index = stored(ranked.select("h", F.explode(F.slice("parts", 1, edits + 1)).alias("p")).select("h", F.col("p.part").alias("part")), "parts")
    moves = [(d, s) for d in range(edits + 1) for s in range(-edits, edits + 1) if abs(s) + abs(d - s) <= edits]
    every = F.array_distinct(F.flatten(F.array(*(F.array_compact(fine_keys(line, length, d, s, edits)) for d, s in moves))))
    probe = sized.select("h", F.explode(every).alias("part")).join(index.select("part").distinct(), "part", "left_semi")
    unsettled = F.when(F.col("a_at") < F.col("b_at"), F.col("b_done")).otherwise(F.col("a_done")).isNull()
    return _late(_side(index.join(hot, "h"), "part", "a_"), _side(probe.join(hot, "h"), "part", "b_"), "part", unsettled, edits)


def removals(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """(row, removed array<int>): the positions of the lines to remove. docs: (id, row, text)."""
    lines = lines_of(docs)
    every = lines.groupBy("h").agg(F.min("at").alias("at"), F.max("at").alias("last"))
    every = stored(every.select("h", "at", (F.col("at") != F.col("last")).alias("again")), "first")
    near = near_lines(lines, every.select("h", "at"), edits)
    gone = every.join(near.withColumn("near", F.lit(True)), "h", "left").where("again OR near").select("h", F.col("at").alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    out = lines.select("row", "pos", "at", "h").join(gone, "h").where(F.col("near") | (F.col("at") != F.col("first")))
    return out.groupBy("row").agg(F.array_sort(F.collect_set("pos")).alias("removed"))


def _row(id_col: str, text_col: str) -> Column:
    """128 bits that stand for an (id, text) pair."""
    return _text_id(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\n"), F.coalesce(F.col(text_col), F.lit(""))))


def _own(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), _row(id_col, text_col).alias("row"), F.col(text_col).alias("text"))


def line_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS) -> DataFrame:
    """(id, n_lines, n_removed, removed) of each row: removed are the positions, from 0, of the lines that repeat an earlier one.

    Lines are the parts between line feeds; those without a word stay. A line goes if an equal line stands earlier, by
    (id, position), or one within some edits whose first place is earlier: one edit for each CHARS_PER_EDIT characters
    of the shorter line, `edits` at most. Equal rows with equal ids are one place and share their fate. Null ids come
    first; null and empty texts have no lines to remove. Other columns are ignored, whatever their names. An empty table
    gives no rows. Texts and lines are told apart by 128-bit hashes.
    """
    docs = _own(df, id_col, text_col)
    gone = removals(docs, edits)
    n_lines = F.size(F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x: ~_blank(x))).cast("long")
    out = docs.select("id", "row", n_lines.alias("n_lines")).join(gone, "row", "left")
    none = F.array().cast("array<int>")
    return out.select(F.col("id").alias(id_col), "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.array_join(F.coalesce("removed", none).cast("array<string>"), ",").alias("removed"))


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS) -> DataFrame:
    """df with the lines that line_report() names taken out of the text. Rows of which no line with a word is left go, if they had one.

    Rows with null or empty texts stay as they are. Columns may have any names; an empty table gives no rows.
    """
    row, removed = unused(df, "row"), unused(df, "removed")
    gone = stored(removals(_own(df, id_col, text_col), edits).toDF(row, removed), "removed")
    # texts of which nothing goes are not shuffled
    some, rest = parted(df.withColumn(row, _row(id_col, text_col)), F.xxhash64(F.col(row)), gone.select(F.xxhash64(row)))
    joined = some.join(gone, row, "left")
    kept = F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains(F.col(removed), i))
    out = joined.withColumn(text_col, F.when(F.col(removed).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")))
    own = [F.col(f"`{c}`") for c in df.columns]
    return out.where(F.col(removed).isNull() | ~_blank(F.col(text_col))).select(*own).unionByName(rest.select(*own))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def _sql_part(less: int, i: int, shift: int) -> str:
    """The select of one probe: the substrings of all lines that stand for segment i of lines `less` characters shorter."""
    n, parts = f"(n - {less})", EDITS + 1
    short = f"({parts} - {n} % {parts})"
    first = f"(1 + {i} * ({n} // {parts}) + greatest(0, {i} - {short}) + {shift})"
    chars = f"({n} // {parts} + CASE WHEN {i} >= {short} THEN 1 ELSE 0 END)"
    return f"SELECT line, p, n, {n} AS m, {i} AS i, substr(line, {first}, {chars}) AS x FROM f WHERE n >= {CHARS_PER_EDIT} AND {n} >= 0 AND {first} >= 1 AND {first} + {chars} - 1 <= n"


ORACLE_SQL = f"""
WITH l AS MATERIALIZED (SELECT doc_id, pos, line FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents) WHERE NOT regexp_full_match(line, '[\\x20\\x09-\\x0D]*')),
f AS MATERIALIZED (SELECT line, min((doc_id, pos)) AS p, length(line) AS n FROM l GROUP BY line),
k AS MATERIALIZED ({" UNION ALL ".join(_sql_part(*x) for x in probes(EDITS)[: EDITS + 1])}),
g AS MATERIALIZED ({" UNION ALL ".join(_sql_part(*x) for x in probes(EDITS))}),
near AS (SELECT DISTINCT CASE WHEN k.p < g.p THEN g.line ELSE k.line END AS line FROM k JOIN g ON k.x = g.x AND k.i = g.i AND k.n = g.m AND k.line <> g.line WHERE levenshtein(k.line, g.line) <= least({EDITS}, k.n // {CHARS_PER_EDIT})),
r AS (SELECT l.doc_id, l.pos FROM l JOIN f ON f.line = l.line LEFT JOIN near ON near.line = l.line WHERE near.line IS NOT NULL OR (l.doc_id, l.pos) <> f.p),
rr AS (SELECT doc_id, count(*) AS n, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS removed FROM r GROUP BY doc_id), nl AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id)
SELECT d.doc_id, coalesce(nl.n, 0) AS n_lines, coalesce(rr.n, 0) AS n_removed, coalesce(removed, '') AS removed FROM documents d LEFT JOIN nl ON nl.doc_id = d.doc_id LEFT JOIN rr ON rr.doc_id = d.doc_id
"""
