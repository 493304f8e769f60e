"""Media columns: documents as interleaved sequences of texts and media references, with payloads in a store of their own.

A document's HTML is parsed into an ordered list of structs: a text, or a reference to a medium by digest, with its caption. Media are kept once
for their digest in a table, losslessly; a join on the digest resolves references, and each keeps its document, position and caption.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._common import batched, materialize, rows
from plumbline.operators.skew import join_one

SIDE = 576  # samples in an image row
SCHEME = "media:"
SEGMENTS = "array<struct<position int, kind string, text string, digest string, caption string>>"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_BLOCKS = frozenset("p div article section h1 h2 h3 h4 h5 h6 ul ol li table tr blockquote pre figure figcaption header footer main aside body hr".split())


class _Interleaver(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[list] = []  # kind, text, digest, caption
        self.parts: list[str] = []
        self.caption: list[str] | None = None
        self.figure: list[list] | None = None  # the media of the open figure
        self.silent = 0

    def _text(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.found.append(["text", text, None, None])

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "template"):
            self.silent += 1
        if tag in _BLOCKS or tag == "img":
            self._text()
        if tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.caption = []
        elif tag in ("img", "audio", "video", "source"):
            held = dict(attrs)
            src = held.get("src") or ""
            if src:
                medium = ["media", None, src.removeprefix(SCHEME), " ".join((held.get("alt") or "").split()) or None]
                self.found.append(medium)
                if self.figure is not None:
                    self.figure.append(medium)
        elif tag == "br":
            (self.parts if self.caption is None else self.caption).append(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "template"):
            self.silent = max(0, self.silent - 1)
        if tag in ("figcaption", "figure") and self.caption is not None:
            caption = " ".join("".join(self.caption).split())
            for medium in self.figure or []:
                medium[3] = caption or medium[3]
            if caption and not self.figure:
                self.found.append(["text", caption, None, None])
            self.caption = None
        if tag in _BLOCKS:
            self._text()
        if tag == "figure":
            self.figure = None

    def handle_data(self, data):
        if not self.silent:
            (self.parts if self.caption is None else self.caption).append(data)


def interleave(html: str) -> list[dict]:
    """The document's texts and media references in order; a figure's caption, or else the alternative text, goes with each medium."""
    events = _Interleaver()
    events.feed(html)
    events.close()
    events._text()
    return [dict(zip(("position", "kind", "text", "digest", "caption"), (i, *x), strict=True)) for i, x in enumerate(events.found)]


def sequences(docs: DataFrame, id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    """(id, segments) for every row; null html counts as empty and has none; null ids and repeated rows each keep their row; an empty table gives an
    empty result; other columns are not looked at. A document of any length is one task's."""
    segment = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])
    schema = pa.schema([("id", pa.int64()), ("segments", pa.list_(segment))])

    def run(batches):
        return batched(schema, ((i, interleave(h)) for i, h in rows(batches, "id", "html")))

    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).mapInArrow(run, f"id long, segments {SEGMENTS}")


def resolve(sequences: DataFrame, store: DataFrame, copies: str | None = None) -> DataFrame:
    """One row for each segment with the columns of ``store`` (one row a digest) beside it; texts and references without a medium have nulls there.

    Columns of ``sequences`` beside ``segments`` stay; one that a segment or the store has, too, is an error, as is one that both of these have. Null and unknown
    digests match nothing; repeated rows each keep their segments; an empty table on either side gives no rows or nulls. Where ``store`` counts in ``copies`` how many segments refer to a digest, media that
    very many share are broadcast instead of bringing their references together.
    """
    held, named = [c for c in sequences.columns if c != "segments"], ["position", "kind", "text", "digest", "caption"]
    beside = [c for c in store.columns if c != "digest"]
    if clash := {c.lower() for c in held} & {c.lower() for c in (*named, *beside)} | {c.lower() for c in beside} & set(named):
        raise ValueError(f"columns of one name: {', '.join(sorted(clash))}")
    segments = sequences.select(*[c for c in sequences.columns if c != "segments"], F.explode("segments").alias("s")).select("*", "s.*").drop("s")
    return join_one(segments, store, "digest", copies, "left") if copies else segments.join(store, "digest", "left")


def illustrated(text: str, digest: str, size: int) -> str:
    """A text as HTML: a paragraph for each line that isn't blank, and in their middle a figure of its own medium."""
    blocks = [f"<p>{escape(line)}</p>" for line in text.split("\n") if line.strip()]
    blocks.insert(len(blocks) // 2, f'<figure><img src="{SCHEME}{digest}" alt="text"><figcaption>text of {size} bytes</figcaption></figure>')
    return "<article>" + "".join(blocks) + "</article>"


def to_payload(data: bytes) -> bytes:
    """The bytes followed by bytes 255, up to a positive multiple of 576."""
    return data + b"\xff" * (-len(data) % SIDE if data else SIDE)


def store_image(payload: bytes) -> bytes:
    """A greyscale PNG of 576 samples a row, 8 bits each, and as many rows as there are."""
    height = len(payload) // SIDE
    packer, raw, view = zlib.compressobj(1), [], memoryview(payload)
    for row in range(height):
        raw.append(packer.compress(b"\0") + packer.compress(view[row * SIDE : (row + 1) * SIDE]))
    raw.append(packer.flush())
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", SIDE, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", b"".join(raw)) + chunk(b"IEND", b"")


def load_image(media: bytes) -> bytes:
    """The samples of a PNG as ``store_image`` writes them; raises ValueError for anything else."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, parts, size = 8, [], None
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
            if body[8:] != b"\x08\0\0\0\0":
                raise ValueError("not 8-bit greyscale")
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    flat = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    if size is None or len(flat) != size[1] * (size[0] + 1):
        raise ValueError("rows are missing")
    lines = flat.reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered row")
    return lines[:, 1:].tobytes()


def feature(samples: np.ndarray) -> str:
    """Mean and deviation of the samples, and a 64-bit difference hash of their means over a grid of 8 by 9 stretches."""
    edges = np.arange(72) * len(samples) // 72
    sums = np.add.reduceat(samples.astype(np.int64), edges)
    means = (sums / np.diff(np.append(edges, len(samples)))).reshape(8, 9)
    bits = np.packbits((means[:, 1:] > means[:, :-1]).ravel()).tobytes().hex()
    return f"{samples.mean():.4f}:{samples.std():.4f}:{bits}"


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, position, n_segments, caption) for every row.

    A row's text, padded, becomes an image, and the row an HTML document of the text's own lines with a figure among them that refers to the
    image by digest. The document is parsed to its sequence, of which the reference is kept with its position and caption. Images are written to the
    shared folder, read back and measured; a join on the digest gives each reference its image's numbers. Null counts as
    empty; equal texts share a digest and hence all values; repeated rows and null ids stay; an empty table gives an empty result.
    """
    segment = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])
    made = pa.schema([("id", pa.int64()), ("n_segments", pa.int64()), ("segments", pa.list_(segment)), ("digest", pa.string()), ("media", pa.binary())])

    def build(batches) -> Iterator[tuple]:
        for i, data in rows(batches, "id", "data"):
            media = store_image(to_payload(data))
            digest = hashlib.sha256(media).hexdigest()
            found = interleave(illustrated(data.decode(), digest, len(data)))
            yield i, len(found), [s for s in found if s["kind"] == "media"], digest, media

    measured = pa.schema([("digest", pa.string()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def measure(batches) -> Iterator[tuple]:
        for digest, media in rows(batches, "digest", "media"):
            payload = load_image(media)
            yield digest, len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(np.frombuffer(payload, np.uint8))

    held = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    stored = materialize(held.mapInArrow(lambda b: batched(made, build(b), limit=512), f"id long, n_segments long, segments {SEGMENTS}, digest string, media binary"), "media")
    numbers = stored.select("digest", "media").mapInArrow(lambda b: batched(measured, measure(b)), "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    # one row a digest: its copies have equal numbers. UTF-8 has no byte 255, so the text's length can be told from the image
    store = materialize(numbers.groupBy("digest").agg(*(F.first(c).alias(c) for c in numbers.columns[1:]), F.count("*").alias("copies")), "media-numbers")
    return resolve(stored.select("id", "n_segments", "segments"), store, "copies").select("id", *numbers.columns[1:], "position", "n_segments", "caption")
