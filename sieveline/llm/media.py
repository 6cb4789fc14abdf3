"""Operator 5: media columns. Netpbm and BMP images are decoded to numpy arrays, area-resized by
integral images, and written as NPY tiles with difference hashes.

Defined results: a null text counts as empty, so its payload is one row of spaces; equal bytes
give equal results; bytes that are no image of these formats raise ``ValueError`` in the codecs
and give nulls in :func:`decode_images`; an empty table gives an empty result; columns other
than those named are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bounded_batches, only

ROW = 192  # bytes of a row of 64 pixels of three samples
TILE_ROWS = 256
_SPACE = rb"(?:\s|#[^\n\r]*[\n\r])+"
_HEADER = re.compile(rb"P([1-6])" + _SPACE + rb"(\d+)" + _SPACE + rb"(\d+)")
_DEPTH = re.compile(_SPACE + rb"(\d+)")


def encode_netpbm(image: np.ndarray) -> bytes:
    """Binary PPM (height, width, 3) or PGM (height, width) of 8-bit samples."""
    kind = b"P6" if image.ndim == 3 else b"P5"
    return kind + b"\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + np.ascontiguousarray(image, np.uint8).tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as uint8 or uint16: (height, width) or (height, width, 3). Bitmaps: 0 is black, 255 white."""
    if not (m := _HEADER.match(data)):
        raise ValueError("no Netpbm image")
    kind, width, height, at, top = int(m[1]), int(m[2]), int(m[3]), m.end(), 1
    if kind not in (1, 4):
        if not (d := _DEPTH.match(data, at)):
            raise ValueError("no maximum")
        top, at = int(d[1]), d.end()
    channels = 3 if kind in (3, 6) else 1
    shape = (height, width, 3) if channels == 3 else (height, width)
    n = height * width * channels
    if kind <= 3:
        body = re.sub(rb"#[^\n\r]*", b" ", data[at:])
        values = np.array([c - 48 for c in re.sub(rb"\s", b"", body)[:n]] if kind == 1 else body.split()[:n], dtype=np.uint16)
    elif kind == 4:
        stride = (width + 7) // 8
        rows = np.frombuffer(data, np.uint8, stride * height, at + 1).reshape(height, stride)
        values = np.unpackbits(rows, axis=1)[:, :width].reshape(-1)
    else:
        values = np.frombuffer(data, ">u2" if top > 255 else np.uint8, n, at + 1)
    if len(values) != n:
        raise ValueError("samples are missing")
    if kind in (1, 4):
        return np.where(values == 0, 255, 0).astype(np.uint8).reshape(shape)
    return values.astype(np.uint16 if top > 255 else np.uint8).reshape(shape)


def encode_bmp(image: np.ndarray) -> bytes:
    """24-bit BMP of (height, width, 3) samples in the order red, green, blue."""
    height, width, _ = image.shape
    stride = (width * 3 + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * 3] = image[::-1, :, ::-1].reshape(height, width * 3)
    return struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8, 24 or 32 bits as (height, width, 3) uint8 in the order red, green, blue."""
    if len(data) < 54 or data[:2] != b"BM":
        raise ValueError("no BMP image")
    at, head, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError("a kind of BMP that is not supported")
    stride, lines = (width * bits // 8 + 3) // 4 * 4, abs(height)
    if len(data) < at + stride * lines:
        raise ValueError("samples are missing")
    rows = np.frombuffer(data, np.uint8, stride * lines, at).reshape(lines, stride)
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        colours = np.frombuffer(data, np.uint8, used * 4, 14 + head).reshape(used, 4)
        image = colours[rows[:, :width]][..., 2::-1]
    else:
        image = rows[:, : width * bits // 8].reshape(lines, width, bits // 8)[..., 2::-1]
    return np.ascontiguousarray(image[::-1] if height > 0 else image)


def decode_image(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def grey(image: np.ndarray) -> np.ndarray:
    """Luminance by fixed integer weights, as float."""
    return image.astype(np.float64) if image.ndim == 2 else image.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the (fractional) areas that the new pixels cover, read off an integral image."""
    h, w = image.shape
    whole = np.zeros((h + 1, w + 1))
    np.cumsum(image, axis=0, out=whole[1:, 1:])
    np.cumsum(whole[1:, 1:], axis=1, out=whole[1:, 1:])
    y, x = np.arange(height + 1) * (h / height), np.arange(width + 1) * (w / width)
    yi, xi = np.minimum(y.astype(int), h - 1), np.minimum(x.astype(int), w - 1)
    rows = whole[yi] + (y - yi)[:, None] * (whole[yi + 1] - whole[yi])
    at = rows[:, xi] + (x - xi)[None, :] * (rows[:, xi + 1] - rows[:, xi])
    return (at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]) / ((h / height) * (w / width))


def difference_hash(image: np.ndarray) -> str:
    """64 bits as hex: whether each of 8 x 9 area means is below its right neighbour (by more than rounding)."""
    small = area_resize(grey(image), 8, 9)
    return f"{int.from_bytes(np.packbits(small[:, 1:] > small[:, :-1] + 1e-6).tobytes(), 'big'):016x}"


def write_tiles(image: np.ndarray, rows: int = TILE_ROWS) -> bytes:
    """The image as NPY arrays of at most ``rows`` rows, one after another."""
    out = io.BytesIO()
    for top in range(0, len(image), rows):
        np.lib.format.write_array(out, np.ascontiguousarray(image[top : top + rows]), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def read_tiles(data: bytes) -> np.ndarray:
    """The image of :func:`write_tiles`."""
    source, tiles = io.BytesIO(data), []
    while source.tell() < len(data):
        tiles.append(np.lib.format.read_array(source, allow_pickle=False))
    return np.concatenate(tiles)


def text_image(text: str | None) -> tuple[int, bytes]:
    """Bytes of a text; the PPM whose samples are these bytes, filled up with spaces."""
    raw = (text or "").encode()
    payload = raw + b" " * (max(1, -(-len(raw) // ROW)) * ROW - len(raw))
    return len(raw), encode_netpbm(np.frombuffer(payload, np.uint8).reshape(-1, ROW // 3, 3))


def decode_images(frame: DataFrame, id_col: str, data_col: str, size: int = 64) -> DataFrame:
    """Id, height, width, tiles (NPY bytes of the whole image), thumb (NPY of a ``size`` x ``size`` grey area mean) and dhash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data in b.column(1).to_pylist():
                try:
                    image = decode_image(data or b"")
                    thumb = np.rint(area_resize(grey(image), size, size)).astype(np.uint8)
                    out.append((image.shape[0], image.shape[1], write_tiles(image), write_tiles(thumb), difference_hash(image)))
                except ValueError:
                    out.append((None,) * 5)
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string()), strict=True))], names=["id", "height", "width", "tiles", "thumb", "dhash"])

    bounded_batches(frame.sparkSession)
    kind = frame.schema[id_col].dataType.simpleString()
    return only(frame, id_col, data_col).mapInArrow(run, f"id {kind}, height int, width int, tiles binary, thumb binary, dhash string").withColumnRenamed("id", id_col)


def text_media(docs: DataFrame) -> DataFrame:
    """Each text as an image: stored as NPY tiles, read back, with digests and a difference hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                n, ppm = text_image(text)
                media = write_tiles(decode_image(ppm))
                image = read_tiles(media)
                payload = image.tobytes()
                out.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image)))
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", *(f.name for f in fields)])

    fields = [T.StructField(n, k) for n, k in (("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()))]
    bounded_batches(docs.sparkSession)
    return only(docs, "doc_id", "text").mapInArrow(run, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *fields]))
