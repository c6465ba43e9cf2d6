"""Zarr stores as cubes: chunks that a box opens, types, times, axes, and Blosc containers."""

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from terracell.operators import subset
from terracell.sources import arrays, zarr


def blosc(data: bytes, item: int, shuffle: int, codec: str, block: int) -> bytes:
    """A container after the format's description: shuffle 0 none, 1 bytes, 2 bits; one stream a block."""
    pack = {"zlib": zlib.compress, "zstd": zstandard.ZstdCompressor().compress, "lz4": lambda b: pa.compress(b, codec="lz4_raw", asbytes=True)}[codec]
    number = {"lz4": 1, "zlib": 3, "zstd": 4}[codec]
    blocks, out = [data[k : k + block] for k in range(0, len(data), block)], []
    for b in blocks:
        x, whole = np.frombuffer(b, np.uint8), len(b) // item * item
        if shuffle == 1:
            x = np.concatenate([x[:whole].reshape(-1, item).T.ravel(), x[whole:]])
        elif shuffle == 2 and len(b) % item == 0 and len(b) // item % 8 == 0:
            x = np.packbits(np.ascontiguousarray(np.unpackbits(x.reshape(-1, item), axis=1, bitorder="little").T), axis=1, bitorder="little").ravel()
        packed = pack(x.tobytes())
        packed = packed if len(packed) < len(b) else x.tobytes()
        out.append(struct.pack("<I", len(packed)) + packed)
    starts, at = [], 16 + 4 * len(out)
    for o in out:
        starts.append(at)
        at += len(o)
    flags = (number << 5) | 16 | {0: 0, 1: 1, 2: 4}[shuffle]
    return struct.pack("<BBBBIII", 2, 1, flags, item, len(data), block, at) + struct.pack(f"<{len(out)}I", *starts) + b"".join(out)


@pytest.mark.parametrize("codec", ["zlib", "zstd", "lz4"])
@pytest.mark.parametrize("shuffle", [0, 1, 2])
def test_blosc(codec, shuffle):
    rng = np.random.default_rng(0)
    for n in (1, 7, 8, 64, 1000, 1003):
        for dtype in ("<i2", "<f4", "<f8", "u1"):
            data = rng.integers(0, 9, n).astype(dtype).tobytes()
            item = np.dtype(dtype).itemsize
            assert arrays.inflated(blosc(data, item, shuffle, codec, 256), {"id": "blosc"}) == data
    assert arrays.unblosced(struct.pack("<BBBBIII", 2, 1, 2, 1, 3, 3, 19) + b"abc") == b"abc"
    streams = b"".join(struct.pack("<I", len(p)) + p for p in (bytes(range(100)), zlib.compress(b"\x07" * 100)))
    split = struct.pack("<BBBBIII", 2, 1, 3 << 5 | 1, 2, 200, 200, 20 + len(streams)) + struct.pack("<I", 20) + streams
    assert arrays.unblosced(split) == bytes(x for k in range(100) for x in (k, 7))


def stored(path, arrays_, attributes=None, consolidated=True, separator="."):
    """Writes arrays {name: (values, chunks, dims, attributes, fill, codec)} as a store."""
    meta = {".zattrs": attributes or {}, ".zgroup": {"zarr_format": 2}}
    for name, (values, chunks, dims, attrs, fill, codec) in arrays_.items():
        (path / name).mkdir(parents=True)
        meta[f"{name}/.zarray"] = {"shape": values.shape, "chunks": chunks, "dtype": values.dtype.str, "compressor": codec and {"id": codec}, "fill_value": fill, "order": "C", "filters": None, "zarr_format": 2, "dimension_separator": separator}
        meta[f"{name}/.zattrs"] = {"_ARRAY_DIMENSIONS": dims, **attrs}
        for at in np.ndindex(*[-(-n // c) for n, c in zip(values.shape, chunks)]):
            block = np.full(chunks, 0 if fill is None else fill, values.dtype)
            part = values[tuple(slice(k * c, (k + 1) * c) for k, c in zip(at, chunks))]
            block[tuple(slice(0, n) for n in part.shape)] = part
            if fill is not None and (block == fill).all():
                continue
            raw = {None: bytes, "zlib": zlib.compress, "blosc": lambda b: blosc(b, values.dtype.itemsize, 2, "zstd", 512)}[codec](block.tobytes())
            file = path / name / (separator.join(map(str, at)) or "0")
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_bytes(raw)
    for k, v in meta.items():
        if not consolidated or k == ".zgroup":
            (path / k).write_text(json.dumps(v))
    if consolidated:
        (path / ".zmetadata").write_text(json.dumps({"metadata": meta, "zarr_consolidated_format": 1}))


@pytest.fixture
def store(tmp_path):
    rng = np.random.default_rng(1)
    big = rng.integers(1, 1 << 62, (3, 20, 30))
    big[:, :4, :6] = -1
    small = rng.random((3, 20, 30)).astype("<f4")
    small[0, 10, 10] = np.nan
    stored(tmp_path / "s", {
        "big": (big, (1, 4, 6), ["time", "latitude", "longitude"], {"units": "t"}, -1, "blosc"), "small": (small, (1, 4, 6), ["time", "latitude", "longitude"], {}, None, "zlib"),
        "flat": (np.arange(600, dtype="<i2").reshape(20, 30), (8, 8), ["latitude", "longitude"], {}, None, "zlib"),
        "latitude": (50 - 0.25 * np.arange(20), (20,), ["latitude"], {}, None, None), "longitude": (10 + 0.5 * np.arange(30), (7,), ["longitude"], {}, None, None),
        "time": (np.array([0, 366, 731]), (2,), ["time"], {"units": "days since 2020-01-01"}, None, None), "spatial_ref": (np.array(0), (), [], {"crs_wkt": "EPSG:4326"}, None, None),
    }, {"title": "T"})
    return str(tmp_path / "s"), big, small


def test_store_as_cube(spark, store):
    path, big, small = store
    cube = zarr.opened(spark, path)
    assert cube.grid.crs == "EPSG:4326" and (cube.grid.x0, cube.grid.dx, cube.grid.y0, cube.grid.dy) == (9.75, 0.5, 50.125, -0.25) and cube.time == "time" and cube.attributes["title"] == "T"
    assert dict(cube.df.dtypes) == {"iy": "bigint", "ix": "bigint", "time": "timestamp_ntz", "big": "bigint", "small": "float", "flat": "smallint"}
    rows = {(r["time"].year, r["iy"], r["ix"]): r for r in cube.df.collect()}
    assert len(rows) == 1800
    for (year, iy, ix), r in rows.items():
        assert r["big"] == (None if big[year - 2020, iy, ix] == -1 else big[year - 2020, iy, ix]) and r["flat"] == 30 * iy + ix
        assert r["small"] is None if np.isnan(small[year - 2020, iy, ix]) else r["small"] == small[year - 2020, iy, ix]
    with pytest.raises(ValueError, match="flat"):
        zarr.opened(spark, path, ["none"])


def test_a_box_opens_only_its_chunks(spark, store, tmp_path):
    path, big, _ = store
    arrays_, _ = zarr.described(spark, path)
    box = {"time": (1, 1), "latitude": (5, 9), "longitude": (6, 11)}
    assert zarr.chunk_files(spark, path, arrays_["big"], box).count() == 2
    assert zarr.chunk_files(spark, path, arrays_["big"]).count() == 75 - 3 and zarr.chunk_files(spark, path, arrays_["big"], {"time": (5, 9)}) is None
    for f in (tmp_path / "s" / "big").glob("[0-9]*"):  # whatever else is opened fails
        if f.name not in ("1.1.1", "1.2.1"):
            f.write_bytes(b"broken")
    cube = zarr.opened(spark, path, ["big"], box=(13.0, 47.75, 15.5, 48.75), start="2021", end="2021-12")
    want = {(r["iy"], r["ix"]): r["big"] for r in cube.df.collect()}
    assert want == {(y, x): big[1, y, x] for y in range(5, 10) for x in range(6, 12)}
    assert want == {(r["iy"], r["ix"]): r["big"] for r in subset.bbox(cube, 13.0, 47.75, 15.5, 48.75).df.collect()}
    with pytest.raises(Exception):  # noqa: B017
        zarr.opened(spark, path, ["big"]).df.collect()
    assert zarr.opened(spark, path, ["big"], start="2030").df.count() == 0


def test_axes_become_arrays(spark, tmp_path):
    values = np.random.default_rng(2).random((2, 3, 4, 6, 8)).astype("<f4")
    values[0, 1, 2, 3, 4] = -9999
    values[:, :, :, 0, 0] = -9999
    dims = ["members", "age_class", "time", "latitude", "longitude"]
    stored(tmp_path / "a", {"age": (values, (2, 3, 1, 4, 4), dims, {}, -9999.0, "zlib"), "latitude": (np.arange(6.0), (6,), ["latitude"], {}, None, None), "longitude": (np.arange(8.0), (8,), ["longitude"], {}, None, None)}, {"crs": "EPSG:4326"}, separator="/")
    cube = zarr.opened(spark, str(tmp_path / "a"))
    assert cube.attributes["axes"] == {"age": {"names": ["members", "age_class"], "lengths": [2, 3]}} and dict(cube.df.dtypes)["age"] == "array<float>" and cube.time == "time"
    rows = {(r["time"], r["iy"], r["ix"]): r["age"] for r in cube.df.collect()}
    assert len(rows) == 4 * 47
    for (t, y, x), got in rows.items():
        assert got == [None if v == -9999 else v for v in values[:, :, t, y, x].ravel().tolist()]


def test_without_consolidated_metadata(spark, tmp_path):
    stored(tmp_path / "b", {"v": (np.arange(24, dtype="<u2").reshape(4, 6), (2, 2), ["y", "x"], {}, None, None), "y": (np.arange(4.0), (4,), ["y"], {}, None, None), "x": (np.arange(6.0), (6,), ["x"], {}, None, None)}, {"crs": "EPSG:3035"}, consolidated=False)
    cube = zarr.opened(spark, str(tmp_path / "b"), ["v"], names=["v", "x", "y"])
    assert sorted(r["v"] for r in cube.df.collect()) == list(range(24)) and cube.grid.crs == "EPSG:3035"
    assert zarr.variable(spark, str(tmp_path / "b"), "x").orderBy("d0").select(F.collect_list("value")).first()[0] == list(range(6))
    with pytest.raises(FileNotFoundError):
        zarr.described(spark, str(tmp_path / "b"))
    with pytest.raises(FileNotFoundError):
        zarr.described(spark, str(tmp_path / "b"), ["w"])
