"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches."""

from __future__ import annotations

import base64
import hashlib
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 ones stand for themselves, the rest follow U+0100 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def merge_list(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """Every pair of tokens whose concatenation is a token, by the rank of the concatenation.

    Pairs of one token are ordered so that of two overlapping occurrences the left one merges first: they overlap
    where a suffix of the token is also its prefix (length b), and the left one is then split at len - b.
    """
    pairs = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        n = len(token)
        cuts = [i for i in range(1, n) if token[:i] in ranks and token[i:] in ranks]
        late = {b for b in range(1, n) if token[-b:] == token[:b]}
        cuts.sort(key=lambda i: (i in late and (n - i) not in late, i in late and i > n - i, i))
        pairs += [(token[:i], token[i:]) for i in cuts]
    return pairs


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str):
    """(tokenizer, bytes of each id). The file is read once in each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks = read_ranks(path)
    shown = byte_characters()
    name = lambda token: "".join(shown[b] for b in token)
    model = models.BPE(vocab={name(t): r for t, r in ranks.items()}, merges=[(name(a), name(b)) for a, b in merge_list(ranks)], ignore_merges=True)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    # the bytes of an id, by reversing the byte table over the vocabulary that the library holds
    back = {c: b for b, c in enumerate(shown)}
    vocabulary = tokenizer.get_vocab()
    table_ = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for token, i in vocabulary.items():
        table_[i] = bytes(back[c] for c in token)
    return tokenizer, table_


def decode_bytes(ids: list[int], table_: list[bytes]) -> bytes:
    """Tokens may end inside a character: bytes are joined first and only the whole may be read as UTF-8."""
    return b"".join([table_[i] for i in ids])


def token_offsets(ids: list[int], table_: list[bytes]) -> tuple[list[int], list[int]]:
    """(byte offset, character offset) at which each token begins; a token that begins inside a character has the offset of that character."""
    at, chars, byte_at, char_at = 0, 0, [], []
    for i in ids:
        piece = table_[i]
        byte_at.append(at)
        char_at.append(chars - (piece[:1] != b"" and 0x80 <= piece[0] < 0xC0))
        at += len(piece)
        chars += sum(b < 0x80 or b >= 0xC0 for b in piece)
    return byte_at, char_at


#: A space or line feed beside more white space; texts without any are cut the fast way.
_RUNS = re.compile(r"\s[ \n]|[ \n]\s")
_CUTS = re.compile(r"(?<=\S)(?= \S)")


def units(text: str) -> list[str]:
    """Parts of a text that the pattern splits alike alone and in the text.

    A single space between two other characters always starts a match, and a single line feed between two is one.
    So a match never spans the cuts, and as words recur, most parts are found in a cache.
    """
    if _RUNS.search(text):
        return _CUTS.split(text)
    out: list[str] = []
    for k, line in enumerate(text.split("\n")):
        first, *rest = line.split(" ")
        out += ["\n", first] if k else [first]
        out += [" " + x for x in rest]
    return out


#: A word of Latin letters, alone one match of the pattern, with a mark after it that is a match of its own.
_WORD = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]?)")


class Encoder:
    """The library's ids of texts, by way of a two-generation cache of the ids of parts, packed as 32-bit numbers."""

    def __init__(self, path: str, pattern: str, cached: int = 400_000):
        self.tokenizer, self.table = encoder(path, pattern)
        self.model = self.tokenizer.model
        self.shown = str.maketrans(dict(enumerate(byte_characters())))
        # one row for each id: its bytes, and its decimal form with a comma
        self.bytes_of, self.decimal_of = _Pieces(self.table), _Pieces([b"%d," % i for i in range(len(self.table))])
        self.cached, self.young, self.old = cached, {}, {}

    def _word(self, word: str) -> bytes:
        return array("i", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.shown))]).tobytes()

    def _fill(self, missing: list[str]) -> None:
        rest = []
        for unit in missing:
            if (m := _WORD.fullmatch(unit)) is None:
                rest.append(unit)
            else:
                self.young[unit] = self._word(m[1]) + (self._word(m[2]) if m[2] else b"")
        for start in range(0, len(rest), 4096):
            part = rest[start : start + 4096]
            for unit, encoding in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.young[unit] = array("i", encoding.ids).tobytes()

    def packed(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        cut = units(text)
        found = list(map(self.young.get, cut))
        if None in found:
            missing = []
            for u in dict.fromkeys([u for u, f in zip(cut, found, strict=True) if f is None]):
                if (held := self.old.get(u)) is not None:
                    self.young[u] = held
                else:
                    missing.append(u)
            self._fill(missing)
            found = list(map(self.young.get, cut))
            if len(self.young) > self.cached:
                self.old, self.young = self.young, {}
        return np.frombuffer(b"".join(found), np.int32)

    def ids(self, text: str) -> list[int]:
        return self.packed(text).tolist()

    def length(self, text: str) -> int:
        return len(self.packed(text))

    def digests(self, text: str) -> tuple[int, str, str]:
        ids = self.packed(text)
        return len(ids), hashlib.sha256(self.decimal_of.joined(ids)[:-1]).hexdigest(), hashlib.sha256(self.bytes_of.joined(ids)).hexdigest()


class _Pieces:
    """Byte strings by number, joined for many numbers at once."""

    def __init__(self, pieces: list[bytes]):
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]]) if len(pieces) else self.size
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[ids] - (ends - size), size)].tobytes()


@lru_cache(maxsize=2)
def held_encoder(path: str, pattern: str) -> Encoder:
    """One for each Python worker, which Spark uses again for later tasks."""
    return Encoder(path, pattern)


def _shared(column: pa.Array) -> tuple[list[str], list[int]]:
    """The distinct texts of a batch (null: empty), and for each row the number of its text."""
    coded = column.fill_null("").dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.dictionary.to_pylist(), coded.indices.to_pylist()


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """(id, ids array<int>[, byte_offsets, char_offsets]) of every text.

    A null text counts as empty and has no tokens. Special tokens are never added, and their strings are ordinary text.
    Repeated rows each get their own row; other columns of df are ignored, whatever their names.
    """
    extra = ", byte_offsets array<int>, char_offsets array<int>" if offsets else ""

    def run(parts):
        held = held_encoder(path, pattern)
        for batch in parts:
            texts, index = _shared(batch.column(1))
            ids = [held.ids(x) for x in texts]
            columns = [batch.column(0), pa.array([ids[i] for i in index], pa.list_(pa.int32()))]
            if offsets:
                at = [token_offsets(x, held.table) for x in ids]
                columns += [pa.array([at[i][k] for i in index], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "byte_offsets", "char_offsets"][: len(columns)])

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>{extra}").withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary) of every array of ids; null arrays give empty bytes. Ids outside the vocabulary are an error."""

    def run(parts):
        _, table_ = encoder(path, pattern)
        for batch in parts:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode_bytes(x or [], table_) for x in batch.column(1).to_pylist()], pa.binary())], ["id", "decoded"])

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)


def encode_digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass, so that ids never leave the worker. Nulls as in encode()."""

    def run(parts):
        held = held_encoder(path, pattern)
        for batch in parts:
            texts, index = _shared(batch.column(1))
            made = [held.digests(x) for x in texts]
            rows = [made[i] for i in index]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.string()) for k in (1, 2))], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def encoded_lengths(df: DataFrame, path: str, pattern: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns in keep, and n_tokens of the text of each row. Nulls as in encode()."""

    def run(parts):
        held = held_encoder(path, pattern)
        for batch in parts:
            texts, index = _shared(batch.column(batch.num_columns - 1))
            lengths = [held.length(x) for x in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([lengths[i] for i in index], pa.int64())], [f"k{i}" for i in range(len(keep))] + ["n_tokens"])

    kinds = dict(df.dtypes)
    out = df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text_col).alias("text")).mapInArrow(run, ", ".join([*(f"k{i} {kinds[c]}" for i, c in enumerate(keep)), "n_tokens long"]))
    return out.toDF(*keep, "n_tokens")


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), *default_vocabulary())
