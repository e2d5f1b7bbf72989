"""Media columns as interleaved sequences: ordered text and media references from HTML, payloads joined by digest.

A payload is stored losslessly as an 8-bit mono WAV file. The store holds (digest, media) rows and is written without a
shuffle, so a payload that many documents share may be stored more than once; features read back are grouped by digest
before the join, and a reference meets one row. Position and caption stay on the reference all the way.

Null texts count as empty; a payload has at least one block of 64 samples. References that no stored payload answers keep
null features. In broken HTML no text is lost: captions end with their figure or the body, elements that hide their content
hide nothing without an end tag; only scripts and styles without one run to the end of the page, as browsers have it.
Repeated rows stay repeated; rows with null ids stay. Empty tables give no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, shared_path

RATE = 8000
BLOCK = 64
ITEMS = "array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"
FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_MEDIA = {"img", "audio", "video", "source", "embed"}
_SKIP = {"script", "style"}
_HIDDEN = {"noscript", "template"}
#: How many open hidden elements an end tag looks back over.
_DEEPEST = 64
_BREAK = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "article", "section", "figure", "ul", "ol", "table", "nav", "body"}


class _Pairs(HTMLParser):
    """Which openings of hidden elements have an end, by number: an opening without one hides nothing."""

    def __init__(self) -> None:
        super().__init__()
        self.open: list[tuple[str, int]] = []
        self.seen = 0
        self.closed: set[int] = set()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _HIDDEN:
            self.open.append((tag, self.seen))
            self.seen += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in _HIDDEN and (own := [k for k, (t, _) in enumerate(self.open[-_DEEPEST:], max(0, len(self.open) - _DEEPEST)) if t == tag]):
            self.closed.add(self.open[own[-1]][1])
            del self.open[own[-1] :]


class _Reader(HTMLParser):
    """Text runs and media references in the order of the page.

    A caption belongs to the media of its own figure, whichever comes first. One without a figure or whose figure shows
    nothing is text, where it stood.
    """

    def __init__(self, closed: set[int]) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.caption: list[str] | None = None
        self.figures: list[dict] = []
        self.script = False
        self.closed, self.seen, self.hidden = closed, 0, []

    def add(self, kind: str, text: str | None, ref: str | None = None, alt: str | None = None) -> dict:
        self.items.append({"position": 0, "kind": kind, "text": text, "ref": ref, "caption": alt})
        return self.items[-1]

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.add("text", text)

    def end_caption(self) -> None:
        if self.caption is None:
            return
        text = " ".join("".join(self.caption).split())
        self.caption = None
        if text:
            self.figures[-1]["captions"].append(self.add("text", text))

    def end_figure(self) -> None:
        self.end_caption()
        figure = self.figures.pop()
        if figure["media"] and figure["captions"]:
            text = " ".join(x["text"] for x in figure["captions"])
            for x in figure["media"]:
                x["caption"] = text
            for x in figure["captions"]:
                x["kind"] = "caption"

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = dict(attrs)
        if tag in _SKIP:
            self.script = True
        elif tag in _HIDDEN:
            if self.seen in self.closed:
                self.hidden.append(tag)
            self.seen += 1
        elif self.hidden:
            return
        elif tag == "figure":
            self.end_caption()
            self.flush()
            self.figures.append({"media": [], "captions": []})
        elif tag == "figcaption":
            self.end_caption()
            self.flush()
            self.caption = [] if self.figures else None
        elif tag in _MEDIA and given.get("src"):
            self.flush()
            item = self.add("media", None, given["src"], given.get("alt") or None)
            if self.figures:
                self.figures[-1]["media"].append(item)
        elif tag in _BREAK:
            self.breaks()

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIP:
            self.script = False
        elif tag in _HIDDEN:
            if tag in self.hidden:
                while self.hidden.pop() != tag:
                    pass
        elif self.hidden:
            return
        elif tag == "figcaption":
            self.flush()
            self.end_caption()
        elif tag == "figure" and self.figures:
            self.flush()
            self.end_figure()
        elif tag == "body":
            self.end()
        elif tag in _BREAK:
            self.breaks()

    def breaks(self) -> None:
        if self.caption is None:
            self.flush()
        else:
            self.caption.append(" ")

    def handle_data(self, data: str) -> None:
        if not self.script and not self.hidden:
            (self.run if self.caption is None else self.caption).append(data)

    def end(self) -> None:
        self.flush()
        while self.figures:
            self.end_figure()


def _items(html: str | None) -> list[dict]:
    pairs = _Pairs()
    pairs.feed(html or "")
    pairs.close()
    reader = _Reader(pairs.closed)
    reader.feed(html or "")
    reader.close()
    reader.end()
    shown = [x for x in reader.items if x["kind"] != "caption"]
    return [x | {"position": at} for at, x in enumerate(shown)]


def interleaved(pages: DataFrame, *keys: str) -> DataFrame:
    """The key columns and ``items``: text and media references of ``html`` in order, with position and caption."""
    kinds = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), pa.array([_items(x) for x in batch["html"].to_pylist()], kind)], [*keys, "items"])

    return arrow_map(pages.select(*keys, "html"), run, f"{kinds}, items {ITEMS}")


def _little(n: Column) -> Column:
    return F.unhex(F.concat(*[F.substring(F.lpad(F.hex(n.cast("long")), 8, "0"), at, 2) for at in (7, 5, 3, 1)]))


def payload(text: Column) -> Column:
    """The text's UTF-8 bytes, filled with zeros up to a positive multiple of 64."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    size = F.octet_length(raw)
    return F.concat(raw, F.unhex(F.repeat(F.lit("00"), (F.greatest(F.ceil(size / BLOCK), F.lit(1)) * BLOCK - size).cast("int"))))


def wav(samples: Column) -> Column:
    """8-bit mono samples as a WAV file."""
    n, const = F.octet_length(samples), lambda b: F.lit(bytearray(b))
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    return F.concat(const(b"RIFF"), _little(n + 36), const(b"WAVE" + fmt + b"data"), _little(n), samples)


def _read_wav(media: bytes) -> bytes:
    riff, size, wave, tag, _, code, channels, _, _, _, bits, data, n = struct.unpack("<4sI4s4sIHHIIHH4sI", media[:44])
    if (riff, wave, tag, data, code, channels, bits) != (b"RIFF", b"WAVE", b"fmt ", b"data", 1, 1, 8) or size + 8 != len(media) or n + 44 != len(media):
        raise ValueError("not an 8-bit mono WAV file")
    return media[44:]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for digest, media in zip(batch["digest"].to_pylist(), batch["media"], strict=True):
            media = media.as_buffer()
            samples = _read_wav(media.to_pybytes())
            x = np.frombuffer(samples, dtype=np.uint8)
            bands = np.bincount(x >> 4, minlength=16)
            change = int(np.abs(np.diff(x.astype(np.int16))).sum()) * 16 // len(x)
            feature = f"{bytes((bands * 255 // len(x)).astype(np.uint8)).hex()}-{int(x.sum(dtype=np.int64)) * 16 // len(x):04x}-{change:04x}"
            rows.append((digest, len(x), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        names = [f.split()[0] for f in FEATURES.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names)


def store(payloads: DataFrame, path: str) -> None:
    """Writes rows (digest, payload) as (digest, media) under ``path``."""
    payloads.select("digest", wav(F.col("payload")).alias("media")).write.option("compression", "zstd").parquet(path)


def stored_features(spark, path: str) -> DataFrame:
    """One row for each digest, from the stored bytes."""
    found = arrow_map(spark.read.schema("digest string, media binary").parquet(path), _features, FEATURES)
    rest = [f.split()[0] for f in FEATURES.split(", ")][1:]
    return found.groupBy("digest").agg(F.first(F.struct(*rest)).alias("_f")).select("digest", "_f.*")


def resolved(sequences: DataFrame, features: DataFrame, *keys: str) -> DataFrame:
    """A row for each media reference ``sha256:...``: keys, position, caption and the features of its payload."""
    refs = sequences.select(*keys, F.inline("items")).where(F.col("kind") == "media")
    refs = refs.select(*keys, "position", "caption", F.regexp_replace("ref", "^sha256:", "").alias("digest"))
    return refs.join(features, "digest", "left")


def document_media(docs: DataFrame) -> DataFrame:
    """Each document's text as a stored payload, referenced by a page and resolved by digest."""
    spark, path = docs.sparkSession, shared_path(docs.sparkSession, "media")
    whole = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), payload(F.col("text")).alias("payload"))
    whole = whole.withColumn("digest", F.sha2("payload", 256))
    store(whole, path)
    page = F.concat(F.lit('<figure><img src="sha256:'), F.col("digest"), F.lit('"><figcaption>bytes '), F.col("n_bytes").cast("string"), F.lit("</figcaption></figure>"))
    sequences = interleaved(whole.select("doc_id", "n_bytes", page.alias("html")), "doc_id", "n_bytes")
    out = resolved(sequences, stored_features(spark, path), "doc_id", "n_bytes")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
