"""Media columns: interleaved documents of text and media references, and a store of media by digest.

HTML becomes an ordered array of structs (position, kind, text, reference, caption).
Media are stored once read as lossless 8-bit images under the SHA-256 of their payload;
what a reference needs of its media comes from a join on that digest, so positions and
captions stay with their sequence. Features are computed where the stored bytes are
read, before the join, so no payload is shuffled.

Null texts and pages are empty; an empty text is one row of padding; repeated rows give
repeated rows and equal texts equal values.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH = 576
#: Fixed value of the PNG format.
PNG_HEAD = b"\x89PNG\r\n\x1a\n"
SEQUENCE = "array<struct<position: int, kind: string, text: string, ref: string, caption: string>>"
#: Elements whose content is no text of the document, and those that have no end tag.
HIDDEN = ("script", "style", "head", "template", "noscript")
MEDIA = ("img", "video", "audio", "source", "embed")
BREAKS = ("p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "figure", "article", "section", "nav", "ul", "ol", "table", "blockquote", "pre")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 1) -> bytes:
    """A grey image with 8-bit samples, 576 wide, that holds ``payload`` (a positive multiple of 576 bytes)."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG_HEAD + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """Samples of an image that ``to_png`` made; a damaged one is an error."""
    if data[:8] != PNG_HEAD:
        raise ValueError("no PNG")
    at, packed, width = 8, [], 0
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            width = struct.unpack_from(">I", body)[0]
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(-1, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].tobytes()


def padded(text: str) -> bytes:
    raw = text.encode()
    return raw + b"\xff" * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))


def feature(payload: bytes) -> str:
    """Mean and spread of the samples, their distinct values, and which columns are above the mean (8 by 8 blocks, as hex)."""
    x = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    mean = x.mean(dtype=np.float64)
    bands = x.mean(axis=0, dtype=np.float64).reshape(64, -1).mean(axis=1)
    bits = int("".join("1" if b > mean else "0" for b in bands), 2)
    return f"mean={mean:.4f};sd={x.std(dtype=np.float64):.4f};values={len(np.unique(x))};bands={bits:016x}"


class _Interleave(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.held: list[str] = []
        self.hidden = 0
        self.caption: list[str] | None = None
        self.figure: int | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})
        self.held = []

    def end_caption(self) -> None:
        """Give the open caption to the last medium of its figure; without one it is text."""
        if self.caption is None:
            return
        text = " ".join("".join(self.caption).split())
        media = [i for i in self.items[self.figure or 0 :] if i["kind"] == "media"]
        if media:
            media[-1]["caption"] = text
        elif text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})
        self.caption = None

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in MEDIA:
            own = dict(attrs)
            if own.get("src"):
                self.flush()
                self.items.append({"kind": "media", "text": None, "ref": own["src"], "caption": own.get("alt")})
        elif tag == "figcaption":
            self.end_caption()
            self.flush()
            self.caption = []
        elif tag in BREAKS:
            if self.caption is not None:
                self.caption.append(" ")
            self.flush()
            if tag == "figure":
                self.figure = len(self.items)

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption":
            self.end_caption()
        elif tag in BREAKS:
            self.flush()
            if tag == "figure":
                self.end_caption()
                self.figure = None

    def handle_data(self, data):
        if not self.hidden:
            (self.held if self.caption is None else self.caption).append(data)


def sequence(html: str) -> list[dict]:
    """Ordered text and media references of a page. A caption that nothing closes ends with its figure or the page."""
    parser = _Interleave()
    parser.feed(html)
    parser.close()
    parser.end_caption()
    parser.flush()
    return [{"position": k} | item for k, item in enumerate(parser.items)]


def interleave(pages: DataFrame, column: str = "html") -> DataFrame:
    """All columns plus ``sequence``, the ordered structs of the page; a column of that name is replaced."""
    (html,) = common.free(pages, "_tm_html")
    rest = pages.drop("sequence")
    pages, names = pages.withColumn(html, F.col(column)).drop("sequence"), rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield {c: batch.column(c) for c in names} | {"sequence": [sequence(t) for t in common.text_rows(batch, html)]}

    return common.map_arrow(pages, run, common.widened(rest, sequence=SEQUENCE))


def resolve(sequences: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each media reference with what ``stored(ref, ...)`` has under its digest; null if it has nothing."""
    items = sequences.select(*keys, F.explode("sequence").alias("item")).where("item.kind = 'media'")
    refs = items.select(*keys, "item.position", "item.caption", F.col("item.ref").alias("_ref"))
    return refs.join(stored, F.col("_ref") == F.col("ref"), "left").drop("_ref")


def store_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Store every text's payload; returns pages that refer to it by digest, and the stored media as read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            ids, pages, refs, media = batch.column("doc_id").to_pylist(), [], [], []
            out = {"doc_id": [], "html": pages, "ref": refs, "n_bytes": [], "media": media}
            size = 0
            for id_, text in zip(ids, common.text_rows(batch), strict=True):
                payload = padded(text)
                ref = "sha256:" + hashlib.sha256(payload).hexdigest() + f":{len(text.encode())}"
                out["doc_id"].append(id_)
                pages.append(f'<article><figure><img src="{ref}"><figcaption>document {id_}</figcaption></figure></article>')
                refs.append(ref)
                out["n_bytes"].append(len(text.encode()))
                media.append(to_png(payload))
                size += len(media[-1])
                if size > 1 << 24:
                    yield out
                    pages, refs, media, size = [], [], [], 0
                    out = {"doc_id": [], "html": pages, "ref": refs, "n_bytes": [], "media": media}
            yield out

    kept = common.stash(common.map_arrow(docs.select("doc_id", "text"), run, "doc_id long, html string, ref string, n_bytes long, media binary"), "media")
    return kept.select("doc_id", "html"), kept.select("ref", "n_bytes", "media")


def features(media: DataFrame) -> DataFrame:
    """Read stored media: ``ref, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature``, one row for each digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out = {k: [] for k in ("ref", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for ref, n, cell in zip(batch.column("ref").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media"), strict=True):
                data = cell.as_py()
                payload = from_png(data)
                digest = hashlib.sha256(payload).hexdigest()
                if ref.split(":")[1] != digest:
                    raise ValueError(f"stored media fail their digest: {ref}")
                for name, value in zip(out, (ref, n, len(payload), digest, zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload)), strict=True):
                    out[name].append(value)
            yield out

    rows = common.map_arrow(media, run, "ref string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return rows.dropDuplicates(["ref"])


def document_media(docs: DataFrame) -> DataFrame:
    """Store all texts as media, parse the pages that refer to them, and resolve the references: one row for each document."""
    pages, media = store_documents(docs)
    sequences = interleave(pages).select("doc_id", "sequence")
    return resolve(sequences, features(media), ["doc_id"]).drop("ref")
