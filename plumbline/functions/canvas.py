"""Pictures with box outlines, and PNG files put together from bands of rows that are compressed apart from each other."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable

import numpy as np

from plumbline.functions.raster import resample, triangle

TRUTH, FOUND = (0x00, 0x88, 0xFF), (0xFF, 0x3B, 0x30)  # fixed values: colours of true and predicted boxes,
STROKE = 3  # the width of their outlines,
HEADER = 24  # and the height of the white band above a pair
_ADLER = 65521


def outline(canvas: np.ndarray, box: tuple[float, float, float, float], colour: tuple[int, int, int], stroke: int = STROKE) -> None:
    """Draw the outline of (left, top, right, bottom), in pixels cut to whole ones, both ends included; it grows inwards, and what lies outside isn't drawn."""
    height, width = canvas.shape[:2]
    left, top, right, bottom = (int(x) for x in box)
    rows, columns = np.arange(height), np.arange(width)
    in_rows, in_columns = (rows >= top) & (rows <= bottom), (columns >= left) & (columns <= right)
    edge_rows = in_rows & ((rows < top + stroke) | (rows > bottom - stroke))
    edge_columns = in_columns & ((columns < left + stroke) | (columns > right - stroke))
    canvas[np.ix_(edge_rows, in_columns)] = colour
    canvas[np.ix_(in_rows, edge_columns)] = colour


def pair(picture: np.ndarray, truths: Iterable[tuple], found: Iterable[tuple]) -> np.ndarray:
    """The picture with its true boxes beside the picture with predicted ones, below a white band. Boxes are (left, top, right, bottom) in pixels."""
    height, width = picture.shape[:2]
    out = np.full((height + HEADER, 2 * width, 3), 255, np.uint8)
    for k, (boxes, colour) in enumerate(((truths, TRUTH), (found, FOUND))):
        half = picture.copy()
        for box in boxes:
            outline(half, box, colour)
        out[HEADER:, k * width : (k + 1) * width] = half
    return out


def scaled(picture: np.ndarray, width: int) -> np.ndarray:
    """The picture at another width, its height in proportion, one at least; halves go to the even number."""
    height = max(1, round(picture.shape[0] * width / picture.shape[1]))
    return np.stack([resample(picture[..., c], (width, height), triangle, 1) for c in range(3)], axis=2).astype(np.uint8)


def band(rows: np.ndarray, last: bool = False) -> tuple[bytes, int, int]:
    """(compressed, checksum, length) of some rows of a picture. Every band but the last ends on a whole byte, so that bands can follow each other."""
    raw = np.zeros((rows.shape[0], 1 + rows.shape[1] * 3), np.uint8)
    raw[:, 1:] = rows.reshape(rows.shape[0], -1)
    data = raw.tobytes()
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    return packer.compress(data) + packer.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH), zlib.adler32(data), len(data)


def together(first: int, second: int, n: int) -> int:
    """The Adler-32 of two stretches of bytes from that of each; the second has ``n`` bytes.

    The low half is one more than the sum of bytes; the high half sums the low halves, of which the second stretch's n lacked what came before.
    """
    low = ((first & 0xFFFF) + (second & 0xFFFF) - 1) % _ADLER
    high = ((first >> 16) + (second >> 16) + n * ((first & 0xFFFF) - 1)) % _ADLER
    return high << 16 | low


def png(width: int, height: int, bands: Iterable[tuple[bytes, int, int]]) -> Iterable[bytes]:
    """The pieces of a PNG file of bands in their order, the last of which ends the stream."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    yield b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", b"\x78\x9c")
    sum_ = 1
    for compressed, own, n in bands:
        sum_ = together(sum_, own, n)
        yield chunk(b"IDAT", compressed)
    yield chunk(b"IDAT", struct.pack(">I", sum_)) + chunk(b"IEND", b"")


def pixels(data: bytes) -> np.ndarray:
    """The picture (height, width, 3) in a file that ``png`` made; anything else is a ValueError."""
    at, parts, size = 8, [], None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    flat = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    if size is None or len(flat) != size[1] * (1 + 3 * size[0]):
        raise ValueError("rows are missing")
    rows = flat.reshape(size[1], -1)
    if rows[:, 0].any():
        raise ValueError("a filtered row")
    return rows[:, 1:].reshape(size[1], size[0], 3)
