"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized, written as NPY tiles.

``decode_image`` reads P1 to P6 Netpbm and uncompressed BMP of 1, 4, 8, 16, 24 or 32 bits, with bit masks
where these are given. Samples come back as uint8, or as uint16 where Netpbm tells of more than 255
levels, scaled to the whole range of their type; an image is a height x width array, with a third axis
of red, green and blue in colour. ``area_resize`` averages each target cell exactly: the integral
image, interpolated at the cells' bounds, gives cell sums as integers; it is built in bands of rows, so
memory does not grow with an image's height beyond the pixels. ``dhash`` compares neighbouring cells
of a 9 x 8 resize of the grey image.

Defined cases: a null or empty payload is one block of zeros; very long texts are stored whole; equal
payloads give equal values; bytes that are no such image raise a ValueError; an empty table gives an
empty result; columns other than the two named are not read.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OUT_BYTES, text_chunks, utf8

BLOCK = 64
TILE = 8
BAND = 1 << 20


def netpbm_header(data: bytes) -> tuple[bytes, list[int], int]:
    """(magic, numbers, where the samples begin); a # begins a comment."""
    magic, at, numbers = data[:2], 2, []
    need = 2 if magic in (b"P1", b"P4") else 3
    while len(numbers) < need:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("bad Netpbm header")
        numbers.append(int(data[at:end]))
        at = end
    return magic, numbers, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    magic, (width, height, *most), at = netpbm_header(data)
    bands = 3 if magic in (b"P3", b"P6") else 1
    n = width * height * bands
    if magic == b"P4":
        stride = -(-width // 8)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, stride * height, at).reshape(height, stride), axis=1)
        return (1 - bits[:, :width]) * np.uint8(255)
    if magic == b"P1":
        digits = np.frombuffer(data[at - 1 :], np.uint8)
        digits = digits[(digits == 48) | (digits == 49)][:n]
        return ((49 - digits) * np.uint8(255)).reshape(height, width)
    deep = most[0] > 255
    if not 0 < most[0] < 1 << 16:
        raise ValueError("bad Netpbm maximum")
    if magic in (b"P2", b"P3"):
        values = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[:n], dtype=np.int64)
    elif magic in (b"P5", b"P6"):
        if len(data) < at + n * (1 + deep):
            raise ValueError("Netpbm samples are missing")
        values = np.frombuffer(data, ">u2" if deep else np.uint8, n, at)
    else:
        raise ValueError(f"not Netpbm: {magic!r}")
    if len(values) < n:
        raise ValueError("Netpbm samples are missing")
    return scaled(values, most[0], np.uint16 if deep else np.uint8).reshape((height, width, 3) if bands == 3 else (height, width))


def scaled(values: np.ndarray, most: int, kind) -> np.ndarray:
    """Samples of 0 .. most over the whole range of their type, rounded to the nearest; larger ones are the most."""
    full = int(np.iinfo(kind).max)
    if most == full:
        return values.astype(kind)
    return ((np.minimum(values.astype(np.int64), most) * full + most // 2) // most).astype(kind)


def decode_bmp(data: bytes) -> np.ndarray:
    number = lambda at, size, signed=False: int.from_bytes(data[at : at + size], "little", signed=signed)
    start, header, width, height = number(10, 4), number(14, 4), number(18, 4, True), number(22, 4, True)
    bits, packing = number(28, 2), number(30, 4)
    if header < 40 or width < 1 or not height:
        raise ValueError("BMP header of another kind")
    if packing not in (0, 3) or packing == 3 and bits not in (16, 32):
        raise ValueError("compressed BMP")
    stride, rows = (width * bits + 31) // 32 * 4, abs(height)
    if len(data) < start + stride * rows:
        raise ValueError("BMP samples are missing")
    raw = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    raw = raw if height < 0 else raw[::-1]
    if bits == 16 or packing == 3:
        masks = [number(54 + 4 * k, 4) for k in range(3)] if packing == 3 else [31 << 10, 31 << 5, 31]
        if not all(masks):
            raise ValueError("BMP without colour masks")
        words = np.ascontiguousarray(raw[:, : width * bits // 8]).view("<u2" if bits == 16 else "<u4").astype(np.int64)
        low = [(m & -m).bit_length() - 1 for m in masks]
        return np.stack([scaled(words >> s & m >> s, m >> s, np.uint8) for m, s in zip(masks, low)], axis=2)
    if bits in (24, 32):
        return raw[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1]
    if bits not in (1, 4, 8):
        raise ValueError(f"BMP of {bits} bits")
    colours = number(46, 4) or 1 << bits
    palette = np.frombuffer(data, np.uint8, 4 * colours, 14 + header).reshape(colours, 4)[:, 2::-1]
    if bits < 8:
        per = 8 // bits
        shifts = np.arange(per - 1, -1, -1, dtype=np.uint8) * np.uint8(bits)
        raw = (raw[:, :, None] >> shifts & np.uint8((1 << bits) - 1)).reshape(rows, stride * per)
    return palette[raw[:, :width]]


def decode_image(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def grey(image: np.ndarray) -> np.ndarray:
    """Brightness of a colour image, in its own type; a grey one as it is."""
    if image.ndim == 2:
        return image
    return (image.astype(np.uint64) @ np.array([299, 587, 114], np.uint64) // np.uint64(1000)).astype(image.dtype)


def cell_sums(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Exact sums of rows x columns cells of a grey image, each scaled by rows * columns."""
    height, width = image.shape
    lines = np.arange(rows + 1) * height  # bounds in units of 1 / rows
    whole, part = lines // rows, lines % rows
    band = max(1, BAND // max(width, 1))
    above = np.zeros((rows + 1, width), np.int64)  # column sums above each bound, scaled by rows
    total = np.zeros(width, np.int64)
    for top in range(0, height, band):
        piece = image[top : top + band].astype(np.int64)
        sums = np.vstack([np.zeros((1, width), np.int64), np.cumsum(piece, axis=0)]) + total
        here = np.flatnonzero((whole >= top) & (whole < top + len(piece)))
        above[here] = sums[whole[here] - top] * rows + piece[whole[here] - top] * part[here, None]
        total = sums[-1]
    above[whole >= height] = total * rows
    integral = np.hstack([np.zeros((rows + 1, 1), np.int64), np.cumsum(above, axis=1)])
    across = np.arange(columns + 1) * width
    col, rest = across // columns, across % columns
    at = integral[:, col] * columns
    inner = rest > 0
    at[:, inner] += above[:, col[inner]] * rest[inner]
    return np.diff(np.diff(at, axis=0), axis=1)


def area_resize(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Cell means of each band in the image's own type, rounded down."""
    bands = image[:, :, None] if image.ndim == 2 else image
    pixels = max(1, image.shape[0] * image.shape[1])
    out = np.stack([cell_sums(bands[:, :, k], rows, columns) // pixels for k in range(bands.shape[2])], axis=2)
    return out.reshape((rows, columns) if image.ndim == 2 else out.shape).astype(image.dtype)


def dhash(image: np.ndarray) -> str:
    cells = cell_sums(grey(image), 8, 9)
    return np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(array), allow_pickle=False)
    return out.getvalue()


def as_pgm(payload: bytes) -> bytes:
    """The payload, a positive multiple of BLOCK bytes, as rows of a grey P5 image."""
    return b"P5\n%d %d\n255\n" % (BLOCK, len(payload) // BLOCK) + payload


def padded(data: bytes) -> bytes:
    return data + bytes(max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


SCHEMA = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, tile binary"


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as a P5 image, decoded again, and described; ``tile`` is the NPY of its 8 x 8 resize.

    ``n_bytes``, and of the samples read back: payload_bytes, payload_sha256 and tail_crc32 (the last
    BLOCK bytes); media_bytes and media_sha256 of the stored image; ``feature``, its difference hash.
    """
    kind = docs.schema[id_col].dataType

    def one(text) -> tuple:
        data = utf8(text)
        stored = as_pgm(padded(data))
        image = decode_image(stored)
        back = image.tobytes()
        return len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), dhash(image), npy(area_resize(image, TILE, TILE))

    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = ["id", *(x.split()[0] for x in SCHEMA.split(", "))]

    def run(batches):
        for batch in batches:
            for keys, texts in text_chunks(batch, 0, 1, OUT_BYTES):
                columns = list(zip(*map(one, texts)))
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return out.mapInArrow(run, f"id {kind.simpleString()}, {SCHEMA}").withColumnRenamed("id", id_col)
