"""Media columns: interleaved sequences of text and media references, and media stored losslessly and resolved by digest."""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table
from corpusloom.storage import stored

WIDTH = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_MEDIA = {"img", "audio", "video", "source", "embed"}
_SILENT = {"script", "style", "noscript", "template"}
_INLINE = {"a", "abbr", "b", "em", "i", "small", "span", "strong", "sub", "sup", "u", "code", "q", "s", "mark"}
#: Digests of payloads that a task remembers, so as not to store copies again; beyond them it stores some again, which is harmless.
_REMEMBERED = 200_000
#: Rows that a worker handles at once.
_SLICE = 256


def padded(data: bytes) -> bytes:
    """data with bytes 0 up to a positive multiple of WIDTH."""
    return data + bytes(max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(payload: bytes) -> bytes:
    """8-bit grey samples, WIDTH a row; losslessly packed."""
    rows = len(payload) // WIDTH
    raw = np.zeros((rows, WIDTH + 1), np.uint8)  # each row begins with filter type 0
    raw[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + _chunk(b"IEND", b"")


def read_png(data: bytes) -> bytes:
    """The samples of what write_png() wrote. A wrong signature, checksum or size is an error."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, head = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    width, rows = head[:2]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(rows, width + 1)
    if raw[:, 0].any():
        raise ValueError("only filter type 0 is written here")
    return raw[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """size, mean, deviation and a 64-bit difference hash of an 8 x 9 reduction of the samples."""
    a = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    rows = np.array_split(np.arange(len(a)), 8) if len(a) >= 8 else [np.array([i % len(a)]) for i in range(8)]
    columns = np.array_split(np.arange(WIDTH), 9)
    sums = a.astype(np.int64)
    small = [[int(sums[r][:, c].sum()) * 1_000_000 // (len(r) * len(c)) for c in columns] for r in rows]
    bits = "".join("1" if row[k + 1] > row[k] else "0" for row in small for k in range(8))
    mean = int(sums.sum()) / a.size
    deviation = (int((sums * sums).sum()) / a.size - mean * mean) ** 0.5
    return f"{WIDTH}x{len(a)};mean={mean:.3f};dev={deviation:.3f};dhash={int(bits, 2):016x}"


class _Interleaver(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.silent, self.figure, self.said = 0, None, ""

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "src": None, "caption": None, "n_bytes": None})

    @staticmethod
    def source(at: dict) -> str | None:
        """Where a medium lies: src, or where that is left out the place to load it from later or the first of a set."""
        of_set = (at.get("srcset") or "").split(",")[0].split()
        return at.get("src") or at.get("data-src") or (of_set[0] if of_set else None)

    def close_figure(self) -> None:
        """A figure's caption belongs to all of its media, before and after it; without media it is text."""
        self.flush()
        if self.figure is not None and self.said:
            media = [x for x in self.items[self.figure :] if x["kind"] == "media"]
            for x in media:
                x["caption"] = self.said
            if not media:
                self.text.append(self.said)
                self.flush()
        self.figure, self.said = None, ""

    def handle_starttag(self, tag, attrs):
        at = dict(attrs)
        if tag in _SILENT:
            self.silent += 1
        elif tag == "figure":
            self.close_figure()
            self.figure = len(self.items)
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in _MEDIA and (src := self.source(at)):
            self.flush()
            digest = src[7:] if src.startswith("sha256:") else hashlib.sha256(src.encode("utf-8", "replace")).hexdigest()
            size = at.get("data-bytes") or ""
            self.items.append({"kind": "media", "text": None, "digest": digest, "src": src, "caption": at.get("alt") or None, "n_bytes": int(size) if size.isdecimal() else None})
        elif tag not in _INLINE:
            self.text.append(" ") if self.caption is not None else self.flush()

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            said = " ".join("".join(self.caption).split())
            self.caption = None
            if self.figure is not None:
                self.said = f"{self.said} {said}".strip()
            elif said:
                self.text.append(said)
                self.flush()
        elif tag == "figure":
            self.close_figure()
        elif tag not in _INLINE:
            self.flush()

    def handle_data(self, data):
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)


def parse_sequence(page: str | None) -> list[dict]:
    """The texts and media references of a page in document order; an empty list for null and empty pages. Broken markup is read as far as it goes."""
    parser = _Interleaver()
    parser.feed(page or "")
    parser.close()
    if parser.caption:
        parser.text += parser.caption
    parser.close_figure()
    return [x | {"position": i} for i, x in enumerate(parser.items)]


_ITEM = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("src", pa.string()), ("caption", pa.string()), ("n_bytes", pa.int64())])


def _slices(parts):
    """The batches in slices of few rows, so that a worker holds few texts and pictures at once."""
    for batch in parts:
        for start in range(0, batch.num_rows, _SLICE):
            yield batch.slice(start, _SLICE)


def interleave(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, items, kept columns): for each page its ordered texts and media references. One row a row of pages; see parse_sequence()."""

    def run(parts):
        for batch in _slices(parts):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([parse_sequence(x) for x in batch.column(1).to_pylist()], pa.list_(_ITEM)), *batch.columns[2:]], ["id", "items", *batch.schema.names[2:]])

    kinds = dict(pages.dtypes)
    names = {c: f"keep_{c}" for c in keep}
    own = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"), *(F.col(c).alias(n) for c, n in names.items()))
    schema = [f"id {kinds[id_col]}", "items array<struct<position:int,kind:string,text:string,digest:string,src:string,caption:string,n_bytes:long>>", *(f"{n} {kinds[c]}" for c, n in names.items())]
    return own.mapInArrow(run, ", ".join(schema)).withColumnsRenamed({"id": id_col} | {n: c for c, n in names.items()})


def references(sequences: DataFrame, id_col: str = "page_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a media reference, with its position in the sequence, its caption and the columns to keep."""
    return sequences.select(id_col, *keep, F.explode(F.expr("filter(items, x -> x.kind = 'media')")).alias("item")).select(id_col, *keep, "item.position", "item.digest", "item.caption", "item.n_bytes")


def read_back(media: DataFrame, digest_col: str = "digest", media_col: str = "media") -> DataFrame:
    """A row a digest: what the stored bytes hold, and features of them. A stored form that doesn't match its digest is an error."""

    def run(parts):
        for batch in _slices(parts):
            rows = []
            for digest, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                payload, own = read_png(data), hashlib.sha256(data).hexdigest()
                if own != digest:
                    raise ValueError(f"the media stored under {digest} have digest {own}")
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), own, feature_of(payload)))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    found = media.where(F.col(media_col).isNotNull()).select(F.col(digest_col).alias("digest"), F.col(media_col).alias("media"))
    return found.mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").dropDuplicates(["digest"])


def resolve(refs: DataFrame, resolved: DataFrame) -> DataFrame:
    """References with what their digests lead to; a reference whose digest isn't stored keeps its row, with nulls. Only descriptions are joined, never payloads."""
    return refs.join(resolved, "digest", "left")


def illustrated(text: str, digest: str, n_bytes: int) -> str:
    """A page of a paragraph a line of the text, with a figure amid them."""
    lines = [f"<p>{html.escape(x, quote=False)}</p>" for x in text.split("\n")]
    middle = (len(lines) + 1) // 2
    figure = f'<figure><img src="sha256:{digest}" data-bytes="{n_bytes}"><figcaption>{n_bytes} bytes</figcaption></figure>'
    return "".join(["<article>", *lines[:middle], figure, *lines[middle:], "</article>"])


def illustrated_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, html, digest, media): a page a document, of its whole text and a reference by digest to its bytes, stored as a picture.

    media is null where the same task has stored the same bytes before. A null text is an empty one.
    """

    def run(parts):
        seen: set[str] = set()
        for batch in _slices(parts):
            pages, digests, media = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                data = text or b""
                picture = write_png(padded(data))
                digest = hashlib.sha256(picture).hexdigest()
                pages.append(illustrated(data.decode("utf-8", "replace"), digest, len(data)))
                digests.append(digest)
                media.append(None if digest in seen else picture)
                if len(seen) < _REMEMBERED:
                    seen.add(digest)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pages, pa.string()), pa.array(digests, pa.string()), pa.array(media, pa.binary())], ["id", "html", "digest", "media"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, html string, digest string, media binary").withColumnRenamed("id", id_col)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the contract's columns: where the picture stands in its sequence, its caption, and how many texts the sequence has, with the digest of them joined by one space."""
    sequences = interleave(illustrated_pages(table(spark, sf_dir, "documents")), "doc_id", keep=("digest", "media"))
    texts = F.expr("transform(filter(items, x -> x.kind = 'text'), x -> x.text)")
    # the texts' digest is all that is kept of them: payloads are stored once, pages and texts not at all
    kept = stored(sequences.select("doc_id", F.size(texts).cast("long").alias("n_texts"), F.sha2(F.array_join(texts, " "), 256).alias("texts_sha256"), F.expr("filter(items, x -> x.kind = 'media')").alias("items"), "digest", "media"), "media")
    refs = references(kept, "doc_id", keep=("n_texts", "texts_sha256"))
    columns = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "n_texts", "texts_sha256"]
    return resolve(refs, read_back(kept)).select(*columns)
