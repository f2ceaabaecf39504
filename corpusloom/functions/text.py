"""Text functions: normalisation with an ordered list of changes, warnings, repetition, buckets, alerts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the cleaning rules.
MIN_CHARS = 200
MAX_CHARS = 50_000
REPEATED_CHARS = 20
REPETITION_RATIO = 0.2
MIN_PARAGRAPH_CHARS = 20
MIN_PARAGRAPHS = 5
CONTENT_TYPES = ("general", "code", "math", "science", "encyclopedia", "conversation")
KNOWN_LANGUAGES = ("zh-Hans", "zh-Hant", "en", "code")
DENSE_LANGUAGES = ("zh-Hans", "zh-Hant", "ja")
LENGTH_EDGES = (256, 512, 1024, 2048, 4096, 8192)

#: White space as Python's str methods see it, for Java's regular expressions.
SPACE = r"[\s\x1c-\x1f]"


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Spark has no Unicode normalisation; ASCII texts pass unchanged."""
    return text.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    """NFKC and full case folding; Spark's lower() leaves ß and the like."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


CHANGES = ("unicode_nfc", "line_endings", "trailing_whitespace", "excess_blank_lines", "outer_whitespace")


def normalize(df, text_col: str = "text", out: str = "clean_text", changes: str = "changes"):
    """df with the normalised text and the labels of the steps that changed it, in order. Each step is a column, so none is computed twice."""
    names = [(label, f"_{label}", before) for label, before in zip(CHANGES, [text_col, *(f"_{c}" for c in CHANGES)], strict=False)]
    last = names[-1][1]
    step = df.withColumn("_unicode_nfc", nfc(F.col(text_col)))
    step = step.withColumn("_line_endings", F.regexp_replace("_unicode_nfc", r"\r\n?", "\n"))
    step = step.withColumn("_trailing_whitespace", F.regexp_replace("_line_endings", r"(?U)[\s\x1c-\x1f&&[^\n]]+(?=\n|\z)", ""))
    step = step.withColumn("_excess_blank_lines", F.regexp_replace("_trailing_whitespace", r"\n{3,}", "\n\n"))
    step = step.withColumn("_outer_whitespace", F.regexp_replace("_excess_blank_lines", rf"(?U)\A{SPACE}+|{SPACE}+\z", ""))
    labels = F.array_compact(F.array(*(F.when(F.col(c) != F.col(before), F.lit(label)) for label, c, before in names)))
    return step.withColumn(out, F.col(last)).withColumn(changes, labels).drop(*(c for _, c, _ in names))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def message_text(text: Column) -> Column:
    """Outer white space and that at line ends removed; null gives an empty string."""
    return stripped(F.regexp_replace(stripped(F.coalesce(text, F.lit(""))), rf"(?U){SPACE}*(\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ])", "\n"))


def repeated_paragraph_ratio(text: Column) -> Column:
    """The share of characters in stripped lines, of 20 characters or more, that repeat an earlier one; 0 below five such lines."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), stripped), lambda x: F.length(x) >= MIN_PARAGRAPH_CHARS)
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.length(x))
    return F.get(F.transform(F.array(lines), lambda a: F.when(F.size(a) < MIN_PARAGRAPHS, F.lit(0.0)).otherwise(1 - total(F.array_distinct(a)) / total(a))), F.lit(0))


def quality_warnings(text: Column, language: Column) -> Column:
    """The warnings of a text in their fixed order."""
    run = text.rlike(rf"(?s)(.)\1{{{REPEATED_CHARS - 1},}}")
    tests = [("too_short", F.length(text) < MIN_CHARS), ("too_long", F.length(text) > MAX_CHARS), ("decode_replacement", text.contains("�")), ("high_repetition", run | (repeated_paragraph_ratio(text) >= REPETITION_RATIO)), ("low_language_confidence", language == "zh")]
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests)))


def language_bucket(language: Column) -> Column:
    return F.when(language.isin(*KNOWN_LANGUAGES), language).otherwise("other")


def estimated_tokens(text: Column, language: Column) -> Column:
    return F.greatest(F.lit(1), F.when(language.isin(*DENSE_LANGUAGES), F.length(text)).otherwise(F.floor(F.octet_length(text) / 4))).cast("long")


def length_bucket(chars: Column) -> Column:
    out = F.lit(None).cast("string")
    for edge in reversed(LENGTH_EDGES):
        out = F.when(chars < edge, f"lt-{edge}").otherwise(out)
    return F.coalesce(out, F.lit(f"gte-{LENGTH_EDGES[-1]}"))


def has_email(text: Column) -> Column:
    return text.rlike(r"(?U)(?<![\w.+-])[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}")


def has_phone(text: Column) -> Column:
    return text.rlike(r"(?<!\d)(?:\+?86[- ]?)?1[3-9]\d{9}(?!\d)")


def four_gram_repetition(text: Column, n: int = 4) -> Column:
    """1 less distinct n-grams over n-grams of the words; 0 with fewer than n words."""
    words = F.filter(F.split(text, rf"(?U){SPACE}+"), lambda x: x != "")

    def ratio(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) < n, F.lit(0.0)).otherwise(F.get(F.transform(F.array(grams), lambda g: 1 - F.size(F.array_distinct(g)) / F.size(g)), F.lit(0)))

    return F.get(F.transform(F.array(words), ratio), F.lit(0))


def strict_integer(text: Column) -> Column:
    """The whole number that a string is, else null."""
    return F.when(text.rlike(r"^\s*[+-]?\d{1,18}\s*$"), F.trim(text).cast("long"))


def bare_answer(text: Column) -> Column:
    """Without white space and closing marks."""
    return F.regexp_replace(text, r"(?U)[\s。.!！]+", "")


def meets(response: Column, kind: Column, expected: Column) -> Column:
    """A response rubric: contains, equals or any-of (expected: array)."""
    low, wanted = F.lower(response), F.transform(expected, F.lower)
    contains = F.forall(wanted, lambda e: F.contains(low, e))
    return F.when(kind == "contains", contains).when(kind == "equals", bare_answer(low) == bare_answer(F.get(wanted, F.lit(0)))).when(kind == "any", F.exists(wanted, lambda e: F.contains(low, e)))


def script_class(text: Column, to_traditional: dict[str, str], to_simplified: dict[str, str]) -> Column:
    """zh-Hans, zh-Hant or zh, by which of two character maps changes more characters. The maps are parameters; phrases are not looked at."""
    changed = lambda table: F.length(text) - F.length(F.translate(text, "".join(k for k, v in table.items() if k != v), ""))
    simple, traditional = changed(to_traditional), changed(to_simplified)
    return F.when(simple > traditional, "zh-Hans").when(traditional > simple, "zh-Hant").otherwise("zh")


def matches_glob(path: Column, patterns: list[str]) -> Column:
    """Whether a path matches one of the shell patterns, case and all; `*` passes slashes, too."""
    import fnmatch

    out = F.lit(False)
    for p in patterns:
        out |= path.rlike("^" + fnmatch.translate(p).removeprefix("(?s:").removesuffix(")\\z").removesuffix(")\\Z") + "$")
    return out
