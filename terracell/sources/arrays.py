"""Bytes of chunks and rasters: Spark lists and reads the files, each task decodes its own.

Chunks are plain, zlib, gzip, zstd, or Blosc containers of zlib, zstd or LZ4; rasters are strips or tiles of TIFF files,
plain or deflate. Other codecs raise an error that names them.
"""

from __future__ import annotations

import gzip
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.session import importable


def inflated(raw: bytes, codec: dict | None) -> bytes:
    name = (codec or {}).get("id")
    if name is None:
        return raw
    if name in ("zlib", "gzip"):
        return zlib.decompress(raw) if name == "zlib" else gzip.decompress(raw)
    if name == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    if name == "blosc":
        return unblosced(raw)
    raise ValueError(f"chunks compressed with {name!r} can't be read")


def _unpacked(raw: bytes, size: int, codec: int) -> bytes:
    """size bytes of a stream in a Blosc container, by the number of its codec."""
    if len(raw) == size:
        return raw
    if codec == 3:
        return zlib.decompress(raw)
    if codec == 4:
        return inflated(raw, {"id": "zstd"})
    if codec == 1:
        return pa.decompress(raw, decompressed_size=size, codec="lz4_raw", asbytes=True)
    raise ValueError(f"Blosc chunks of codec {codec} can't be read")


def unblosced(raw: bytes) -> bytes:
    """What a Blosc container (format version 2) holds.

    16 bytes of header (format, codec's format, flags, item size; then sizes of all, of a block and of the container),
    offsets of blocks, and in each block one stream, or one for each byte of an item. Flags: 1 bytes shuffled,
    2 stored as it is, 4 bits shuffled, 16 one stream a block; the codec from the sixth bit.
    """
    _, _, flags, item, size, block, _ = struct.unpack("<BBBBIII", raw[:16])
    if flags & 2:
        return raw[16 : 16 + size]
    out = []
    for k, at in enumerate(struct.unpack_from(f"<{-(-size // block)}I", raw, 16)):
        own = min(block, size - k * block)
        streams = item if not flags & 16 and own == block and item > 1 else 1
        parts = []
        for _ in range(streams):
            (n,) = struct.unpack_from("<I", raw, at)
            parts.append(_unpacked(raw[at + 4 : at + 4 + n], own // streams, flags >> 5))
            at += 4 + n
        data, whole = np.frombuffer(b"".join(parts), np.uint8), own // item * item
        if flags & 4 and own % item == 0 and own // item % 8 == 0:
            bits = np.unpackbits(data.reshape(8 * item, -1), axis=1, bitorder="little").T
            data = np.packbits(np.ascontiguousarray(bits), axis=1, bitorder="little").ravel()
        elif flags & 1 and item > 1:
            data = np.concatenate([data[:whole].reshape(item, -1).T.ravel(), data[whole:]])
        out.append(data.tobytes())
    return b"".join(out)


def small_file(spark: SparkSession, path: str) -> str:
    """Text of a small file, also of one whose name hides it from Spark's scans, from any file system that Spark knows."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def tiff_blocks(raw: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, column, values) of each strip or tile of a TIFF's first band."""
    end = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if end is None or struct.unpack_from(end + "H", raw, 2)[0] != 42:
        raise ValueError("not a classic TIFF")
    at = struct.unpack_from(end + "I", raw, 4)[0]
    tags = {}
    for k in range(struct.unpack_from(end + "H", raw, at)[0]):
        tag, kind, n = struct.unpack_from(end + "HHI", raw, at + 2 + 12 * k)
        code, size = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 12: ("d", 8)}.get(kind, ("B", 1))
        where = at + 10 + 12 * k if n * size <= 4 else struct.unpack_from(end + "I", raw, at + 10 + 12 * k)[0]
        tags[tag] = struct.unpack_from(f"{end}{n}s", raw, where)[0] if code == "s" else struct.unpack_from(f"{end}{n}{code}", raw, where)
    width, height = tags[256][0], tags[257][0]
    compression, bits, form = tags.get(259, (1,))[0], tags[258][0], tags.get(339, (1,))[0]
    if compression not in (1, 8, 32946) or tags.get(317, (1,))[0] not in (1, 2):
        raise ValueError(f"TIFF compression {compression}, predictor {tags.get(317)} can't be read")
    dtype = np.dtype(f"{end}{ {1: 'u', 2: 'i', 3: 'f'}[form] }{bits // 8}".replace(" ", ""))
    bands = tags.get(277, (1,))[0]
    tiled = 322 in tags
    bw, bh = (tags[322][0], tags[323][0]) if tiled else (width, min(tags.get(278, (height,))[0], height))
    across = -(-width // bw)
    for k, (offset, n) in enumerate(zip(tags[324 if tiled else 273], tags[325 if tiled else 279])):
        row, column = k // across * bh, k % across * bw
        data = raw[offset : offset + n] if compression == 1 else zlib.decompress(raw[offset : offset + n])
        rows = bh if tiled else min(bh, height - row)
        block = np.frombuffer(data, dtype, rows * bw * bands).reshape(rows, bw, bands)
        if tags.get(317, (1,))[0] == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype)
        yield row, column, block[: height - row, : width - column, 0]


def tiff_nodata(raw: bytes) -> float | None:
    """The no-data value that a raster states (tag 42113)."""
    end = {b"II": "<", b"MM": ">"}[raw[:2]]
    at = struct.unpack_from(end + "I", raw, 4)[0]
    for k in range(struct.unpack_from(end + "H", raw, at)[0]):
        tag, _, n = struct.unpack_from(end + "HHI", raw, at + 2 + 12 * k)
        if tag == 42113:
            where = at + 10 + 12 * k if n <= 4 else struct.unpack_from(end + "I", raw, at + 10 + 12 * k)[0]
            return float(raw[where : where + n].rstrip(b"\0 ") or b"nan")
    return None


def rasters(spark: SparkSession, path: str, masked: bool = True) -> DataFrame:
    """(path, iy, ix, value): cells of the first band of TIFF files. masked: no-data and NaN give no rows; otherwise all values as stored."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                nodata = tiff_nodata(raw) if masked else None
                for row, column, block in tiff_blocks(raw):
                    values = block.ravel().astype(float)
                    keep = np.ones(len(values), bool)
                    if masked:
                        keep = ~np.isnan(values) & (values != nodata if nodata is not None else True)
                    y, x = np.unravel_index(np.flatnonzero(keep), block.shape)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(y)), pa.array(y + row, pa.int64()), pa.array(x + column, pa.int64()), pa.array(values[keep])], ["path", "iy", "ix", "value"])

    files = importable(spark).read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(decode, "path string, iy long, ix long, value double").select("path", "iy", "ix", F.col("value"))
