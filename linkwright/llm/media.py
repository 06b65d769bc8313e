"""Media columns: Netpbm and BMP images as arrays, area-resized tiles in NPY form, difference hashes.

``media_tiles(frame)`` decodes a binary column of PBM/PGM/PPM (P1-P6, 8 bit) or BMP (8 bit palette,
24 and 32 bit, not compressed) and adds width, height, an NPY tile of ``TILE`` x ``TILE`` pixels resized
by area over integral images, and a 64-bit difference hash. ``texts_as_media(frame)`` stores texts as
P6 images, one byte a sample. ``stored(frame)`` writes a table to the shared folder and reads it back.

Cases: a NULL or undecodable image (truncated, of no size, with samples out of its range) has NULLs
throughout; a NULL text is stored as the empty one; images of one pixel are stretched; input columns
named as an output column are replaced.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import text_bytes
from .frames import prepared

TILE = 32
ROW_BYTES = 192
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")


def decode_netpbm(raw: bytes) -> np.ndarray:
    """height x width x channels (1 or 3) of uint8 samples; samples of a smaller range stay as they are."""
    kind = raw[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    at, head = 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _TOKEN.match(raw, at)
        if not m:
            raise ValueError("bad header")
        head.append(int(m[1][:12]))
        at = m.end()
    width, height = head[:2]
    most = head[2] if len(head) == 3 else 1
    if not 0 < most < 256:
        raise ValueError("samples of over 8 bits")
    channels = 3 if kind in (b"P3", b"P6") else 1
    n = width * height * channels
    stored = height * -(-width // 8) if kind == b"P4" else n
    if not 0 < stored <= len(raw) - at:  # a sample takes a byte at least, or P4 a bit
        raise ValueError("truncated image, or one of no size")
    if kind in (b"P5", b"P6"):
        out = np.frombuffer(raw, np.uint8, n, at + 1)
    elif kind == b"P4":
        rows = np.frombuffer(raw, np.uint8, stored, at + 1).reshape(height, -1)
        out = 1 - np.unpackbits(rows, axis=1)[:, :width].ravel()
    elif kind == b"P1":
        digits = np.frombuffer(re.sub(rb"#[^\n]*|\s+", b"", raw[at:]), np.uint8)[:n]
        if not np.isin(digits, (48, 49)).all():
            raise ValueError("bits are 0 or 1")
        out = 49 - digits
    else:
        out = np.array([int(x[:4]) for x in re.sub(rb"#[^\n]*", b"", raw[at:]).split()[:n]], np.int64)
    if len(out) != n or out.min() < 0 or out.max() > most:
        raise ValueError("truncated image, or samples out of range")
    return (out * (255 if kind in (b"P1", b"P4") else 1)).astype(np.uint8).reshape(height, width, channels)


def decode_bmp(raw: bytes) -> np.ndarray:
    if raw[:2] != b"BM":
        raise ValueError("not a BMP image")
    start, head, width, height = struct.unpack_from("<IIii", raw, 10)
    bits, packed = struct.unpack_from("<HI", raw, 28)
    if packed not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError("this kind of BMP is not read")
    stride = (width * bits // 8 + 3) // 4 * 4
    if width <= 0 or not height or start + stride * abs(height) > len(raw):
        raise ValueError("truncated image, or one of no size")
    rows = np.frombuffer(raw, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : width * bits // 8]
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        palette = np.frombuffer(raw, np.uint8, max(0, start - 14 - head) // 4 * 4, 14 + head).reshape(-1, 4)
        return palette[rows][:, :, 2::-1]
    return rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1]


def decode(raw: bytes) -> np.ndarray:
    return decode_bmp(raw) if raw[:2] == b"BM" else decode_netpbm(raw)


def encode_ppm(samples: np.ndarray) -> bytes:
    height, width, _ = samples.shape
    return b"P6\n%d %d\n255\n" % (width, height) + samples.tobytes()


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas of the image, from its integral image read at fractional corners."""
    h, w, c = image.shape
    integral = np.zeros((h + 1, w + 1, c))
    integral[1:, 1:] = image
    np.cumsum(integral, axis=0, out=integral)
    np.cumsum(integral, axis=1, out=integral)
    for axis, (have, want) in enumerate(((h, height), (w, width))):
        at = np.arange(want + 1) * have / want
        low = np.minimum(at.astype(int), have - 1)
        part = (at - low).reshape((-1, 1, 1) if axis == 0 else (1, -1, 1))
        integral = integral.take(low, axis) * (1 - part) + integral.take(low + 1, axis) * part
    return np.diff(np.diff(integral, axis=0), axis=1) / (h * w / (height * width))


def difference_hash(image: np.ndarray) -> str:
    """64 bits, in hex: whether each of 8 x 9 grey areas is darker than the one to its right."""
    grey = area_resize(image.mean(axis=2, keepdims=True), 8, 9)[:, :, 0]
    return np.packbits(np.diff(np.round(grey, 9), axis=1) > 0).tobytes().hex()


def npy_tile(image: np.ndarray, size: int = TILE) -> bytes:
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(image, size, size)), 0, 255).astype(np.uint8))
    return out.getvalue()


_TILES = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("tile", T.BinaryType()), T.StructField("dhash", T.StringType())])
_STORED = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
_READ = T.StructType(
    [
        *(T.StructField(n, t) for n, t in (("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()))),
        *(T.StructField(n, t) for n, t in (("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("tile", T.BinaryType()))),
    ]
)


def _mapped(frame: DataFrame, column: str, new: T.StructType, values) -> DataFrame:
    """frame with the new columns that values(column) gives, batch by batch."""
    from pyspark.sql.pandas.types import to_arrow_schema

    prepared(frame.sparkSession)
    schema = T.StructType([*(f for f in frame.schema.fields if f.name not in new.names or f.name == column), *(f for f in new.fields if f.name != column)])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            got = values(batch.column(batch.schema.get_field_index(column)))
            made = {f.name: pa.array(v, arrow.field(f.name).type) for f, v in zip(new.fields, zip(*got, strict=True) if got else [()] * len(new), strict=True)}
            yield pa.RecordBatch.from_arrays([made[k] if k in made else batch.column(batch.schema.get_field_index(k)) for k in arrow.names], schema=arrow)

    return frame.mapInArrow(run, schema)


def media_tiles(frame: DataFrame, column: str = "media", tile: int = TILE) -> DataFrame:
    """frame with width, height, tile and dhash of the images of a binary column."""

    def values(raws):
        out = []
        for raw in raws.to_pylist():
            try:
                image = decode(raw or b"")
            except (ValueError, IndexError, OverflowError, struct.error):
                out.append((None,) * 4)
                continue
            out.append((image.shape[1], image.shape[0], npy_tile(image, tile), difference_hash(image)))
        return out

    return _mapped(frame, column, _TILES, values)


def store(payload: bytes) -> bytes:
    """payload (a multiple of 192 bytes) as a P6 image of 64 pixels a row."""
    return encode_ppm(np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES // 3, 3))


def texts_as_media(frame: DataFrame, column: str = "text") -> DataFrame:
    """frame with n_bytes and media: its texts as images."""

    def values(texts):
        data, offsets = text_bytes(texts)
        out = []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            n = int(b - a)
            out.append((n, store(data[a:b].tobytes().ljust(max(1, -(-n // ROW_BYTES)) * ROW_BYTES, b" "))))
        return out

    return _mapped(frame, column, _STORED, values)


def media_as_texts(frame: DataFrame, column: str = "media") -> DataFrame:
    """frame with what is read back from the images of texts_as_media: payload digests, media digests, difference hash and tile."""

    def values(images):
        out = []
        for media in images.to_pylist():
            image = decode(media)
            payload = image.tobytes()
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), npy_tile(image)))
        return out

    return _mapped(frame, column, _READ, values)


def stored(frame: DataFrame) -> DataFrame:
    """frame, written as a Parquet table to the folder that the cluster shares, and read back."""
    spark = frame.sparkSession
    prepared(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/media-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    from .frames import documents

    table = stored(texts_as_media(documents(spark, sf_dir).select("doc_id", "text")).drop("text"))
    return media_as_texts(table).withColumn("tile_sha256", F.sha2("tile", 256)).drop("media", "tile")
