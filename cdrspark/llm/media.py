"""Media columns: Netpbm and BMP files to numpy arrays, area resizing by integral images, NPY tiles.

``decode`` reads the raw Netpbm kinds (P4 bits, P5 grey, P6 colour, 8 or 16 bits a sample, comments in the
header) and the plain ones (P1 to P3), and uncompressed BMP (8 with palette, 24 and 32 bits, top-down or
bottom-up). ``area_resize`` gives each output pixel the exact mean of the input area under it, from a
summed-area table. ``npy`` writes a tile in the NPY format, ``difference_hash`` compares neighbours
of a 9 x 8 grey tile.

The corpus side stores a payload losslessly as the samples of such a file: grey or colour Netpbm or a
24-bit BMP, chosen by the payload's CRC, so both decoders run.

Defined results: a null text is the empty text, whose payload is 192 spaces; equal texts have equal
files and features; any text length works (a file's rows grow; of the summed-area table only BAND_ROWS rows are held at a time, so
memory is the payload, the file, its decoded copy and a band); files
that cannot be decoded raise ValueError in ``decode`` and give null columns in ``tiles``.
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
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cdrspark.llm.common import from_texts, slices, written

UNIT = 192
#: Rows of a picture whose summed-area table is held at once.
BAND_ROWS = 4096
TOKEN = re.compile(rb"(?:[ \t\r\n\x0b\x0c]|#[^\r\n]*[\r\n])*([^ \t\r\n\x0b\x0c#]+)")

# -- decoding -------------------------------------------------------------------------------


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, head = data[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = TOKEN.match(data, at)
        if not m or not m[1].isdigit():
            raise ValueError("bad Netpbm header")
        head.append(int(m[1]))
        at = m.end()
    width, height = head[:2]
    most = head[2] if len(head) == 3 else 1
    if not 0 < most < 65536 or width < 1 or height < 1:
        raise ValueError("bad Netpbm header")
    planes = 3 if kind in (3, 6) else 1
    shape = (height, width, planes) if planes == 3 else (height, width)
    if kind == 1:
        values = np.frombuffer(re.sub(rb"#[^\r\n]*|[^01]", b"", data[at:]), np.uint8)[: width * height] - 48
        samples = 1 - values
    elif kind in (2, 3):
        samples = np.array(re.sub(rb"#[^\r\n]*", b"", data[at:]).split()[: width * height * planes], dtype=np.int64)
    elif kind == 4:
        row = (width + 7) // 8
        bits = np.frombuffer(data, np.uint8, min(row * height, len(data) - at - 1), at + 1)
        if len(bits) < row * height:
            raise ValueError("the samples end early")
        samples = 1 - np.unpackbits(bits.reshape(height, row), axis=1)[:, :width].ravel()
    else:
        size = 2 if most > 255 else 1
        count = width * height * planes
        if len(data) - at - 1 < count * size:
            raise ValueError("the samples end early")
        samples = np.frombuffer(data, ">u2" if size == 2 else np.uint8, count, at + 1)
    if samples.size < width * height * planes:
        raise ValueError("the samples end early")
    if most != 255:
        samples = (samples.astype(np.int64) * 255 + most // 2) // most
    return samples.astype(np.uint8, copy=False).reshape(shape)


def _bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise ValueError("bad BMP header")
    offset, head, width, height, _, bits, packed = struct.unpack_from("<I", data, 10) + struct.unpack_from("<IiiHHI", data, 14)
    down, height = height < 0, abs(height)
    if bits not in (8, 24, 32) or packed not in (0, 3) or width < 1 or height < 1:
        raise ValueError("a BMP kind that is not supported")
    row = (width * bits // 8 + 3) // 4 * 4
    if len(data) < offset + row * height:
        raise ValueError("the samples end early")
    rows = np.frombuffer(data, np.uint8, row * height, offset).reshape(height, row)[:, : width * bits // 8]
    rows = rows if down else rows[::-1]
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.zeros((256, 4), np.uint8)
        palette[:used] = np.frombuffer(data, np.uint8, used * 4, 14 + head).reshape(-1, 4)
        return palette[rows][:, :, 2::-1]
    return rows.reshape(height, width, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    """The samples (0 to 255) of a Netpbm or BMP file: (height, width) if grey, else (height, width, 3)."""
    if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


# -- writing --------------------------------------------------------------------------------


def encode_netpbm(pixels: np.ndarray) -> bytes:
    kind = 6 if pixels.ndim == 3 else 5
    return b"P%d\n%d %d\n255\n" % (kind, pixels.shape[1], pixels.shape[0]) + pixels.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """A bottom-up 24-bit BMP."""
    height, width, _ = pixels.shape
    row = (width * 3 + 3) // 4 * 4
    body = np.zeros((height, row), np.uint8)
    body[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, width * 3)
    return b"BM" + struct.pack("<IHHI", 54 + body.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(tile), version=(1, 0), allow_pickle=False)
    return out.getvalue()


# -- features -------------------------------------------------------------------------------


def _between(sums: np.ndarray, at: np.ndarray, axis: int) -> np.ndarray:
    """A summed-area table at positions along an axis, between samples linearly."""
    low = np.minimum(at.astype(np.int64), sums.shape[axis] - 2)
    part = (at - low).reshape([-1 if a == axis else 1 for a in range(sums.ndim)])
    below, above = np.take(sums, low, axis), np.take(sums, low + 1, axis)
    return below + (above - below) * part


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mean of the area under each output pixel (float64), by a summed-area table that is made band by band: of a band only
    its last row, where the next one goes on, and the table at the output's rows and columns are kept."""
    rows, columns = pixels.shape[:2]
    at = np.arange(height + 1) * rows / height
    corners = np.zeros((height + 1, width + 1, *pixels.shape[2:]))
    last = np.zeros((columns + 1, *pixels.shape[2:]))
    for lo in range(0, rows, BAND_ROWS):
        band = pixels[lo : lo + BAND_ROWS]
        sums = np.zeros((len(band) + 1, columns + 1, *pixels.shape[2:]))
        np.cumsum(band, axis=0, dtype=np.float64, out=sums[1:, 1:])
        np.cumsum(sums[1:, 1:], axis=1, out=sums[1:, 1:])
        sums += last
        inside = (at >= lo) & (at <= lo + len(band))
        if inside.any():
            corners[inside] = _between(_between(sums, at[inside] - lo, 0), np.arange(width + 1) * columns / width, 1)
        last = sums[-1].copy()
    total = np.diff(np.diff(corners, axis=0), axis=1)
    return total * (height * width / (rows * columns))


def grey(pixels: np.ndarray) -> np.ndarray:
    """BT.601 luma."""
    return pixels if pixels.ndim == 2 else pixels @ np.array([0.299, 0.587, 0.114])


def difference_hash(pixels: np.ndarray) -> int:
    """64 bits: whether each of 8 x 8 places of a 9 x 8 tile is brighter than the one to its left, rows first."""
    small = grey(area_resize(pixels, 8, 9))
    # Rounded, so that a flat picture has no bits from the last digits of sums.
    small = np.round(small, 6)
    return int.from_bytes(np.packbits(small[:, 1:] > small[:, :-1]).tobytes(), "big")


def tile_and_hash(pixels: np.ndarray, side: int) -> tuple[bytes, int]:
    tile = np.clip(np.rint(area_resize(pixels, side, side)), 0, 255).astype(np.uint8)
    return npy(tile), difference_hash(pixels)


# -- tables ---------------------------------------------------------------------------------


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length of the text in UTF-8, and it with spaces up to a positive multiple of UNIT."""
    raw = (text or "").encode("utf-8")
    return len(raw), raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" ")


def as_media(payload: bytes) -> bytes:
    """The payload as the samples of a file: grey or colour Netpbm or a BMP, UNIT samples a row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    kind = zlib.crc32(payload) % 3
    if kind == 0:
        return encode_netpbm(rows)
    colour = rows.reshape(-1, UNIT // 3, 3)
    return encode_netpbm(colour) if kind == 1 else encode_bmp(colour)


def stored(docs: DataFrame) -> DataFrame:
    """docs (with text) with n_bytes and media, each text's file, in place of the text; written to the shared folder."""

    def start():
        def make(texts: list) -> dict[str, list]:
            both = [payload_of(t) for t in texts]
            return {"n_bytes": [n for n, _ in both], "media": [as_media(p) for _, p in both]}

        return make

    return written(from_texts(docs, {"n_bytes": "long", "media": "binary"}, start), "media")


def tiles(files: DataFrame, column: str = "media", side: int = 16) -> DataFrame:
    """files with columns width, height, planes (int), tile (an NPY file of side x side) and dhash (16 hex
    digits); null where the file is null or can't be decoded."""

    def start():
        def make(data: list) -> dict[str, list]:
            rows = []
            for x in data:
                try:
                    pixels = decode(x or b"")
                except ValueError:
                    rows.append((None,) * 5)
                    continue
                tile, bits = tile_and_hash(pixels, side)
                rows.append((pixels.shape[1], pixels.shape[0], 3 if pixels.ndim == 3 else 1, tile, f"{bits:016x}"))
            return {k: [r[i] for r in rows] for i, k in enumerate(("width", "height", "planes", "tile", "dhash"))}

        return make

    return from_texts(files, {"width": "int", "height": "int", "planes": "int", "tile": "binary", "dhash": "string"}, start, column=column, keep=True)


def read_back(table: DataFrame) -> DataFrame:
    """Payload facts and features of stored() files, from their decoded samples."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "media"):
                rows = []
                for data in piece.column("media").to_pylist():
                    pixels = decode(data)
                    payload = pixels.tobytes()
                    tile, bits = tile_and_hash(pixels, 16)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), f"{bits:016x}:{zlib.crc32(tile):08x}"))
                made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("n_bytes"), *made], names=names)

    return table.select(F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", "media").mapInArrow(run, schema)


def op3_media_netpbm_bmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(stored(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
