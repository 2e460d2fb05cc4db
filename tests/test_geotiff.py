"""GeoTIFF files that the tests write themselves, against the arrays in them."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigrid.sources import geotiff
from lumigrid.sources.raster import geotiff_scene, window


def write_tiff(path, array, rows, cols=None, order="<", deflate=False, predictor=1, planar=False, big=False):
    """(bands, height, width) in strips of ``rows``, or tiles where ``cols`` is given."""
    bands, h, w = array.shape
    array = array.astype(array.dtype.newbyteorder(order))
    wide = cols or w
    blocks = []
    for part in array[:, None] if planar else array[None]:
        for r in range(0, h, rows):
            for c in range(0, w, wide):
                cut = part[:, r : r + rows, c : c + wide]
                if cols:
                    cut = np.pad(cut, ((0, 0), (0, rows - cut.shape[1]), (0, cols - cut.shape[2])))
                cut = np.moveaxis(cut, 0, 2)
                if predictor == 2:
                    cut = np.concatenate([cut[:, :1], cut[:, 1:] - cut[:, :-1]], axis=1)
                raw = np.ascontiguousarray(cut).astype(array.dtype).tobytes()
                blocks.append(zlib.compress(raw) if deflate else raw)
    long, head = ("Q", 16) if big else ("I", 8)
    offsets = np.cumsum([head, *map(len, blocks)])[:-1].tolist()
    kind = {"u": 1, "i": 2, "f": 3}[array.dtype.kind]
    wide_kind = 16 if big else 4
    tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [array.dtype.itemsize * 8] * bands), (259, 3, [8 if deflate else 1]), (277, 3, [bands]), (284, 3, [2 if planar else 1]), (317, 3, [predictor]), (339, 3, [kind] * bands)]
    tags += [(322, 4, [cols]), (323, 4, [rows]), (324, wide_kind, offsets), (325, 4, [len(b) for b in blocks])] if cols else [(273, wide_kind, offsets), (278, 4, [rows]), (279, 4, [len(b) for b in blocks])]
    tags += [(33550, 12, [0.5, 0.5, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 1000.0, 2000.0, 0.0]), (34735, 3, [1, 1, 0, 1, 3072, 0, 1, 2180]), (42113, 2, b"-9\0")]
    body, at = b"".join(blocks), head + sum(map(len, blocks))
    entry, count = (20, "Q") if big else (12, "H")
    extra_at = at + struct.calcsize(count) + entry * len(tags) + struct.calcsize(long)
    table, extra = struct.pack(order + count, len(tags)), b""
    for tag, k, values in sorted(tags):
        letter = geotiff.TYPES[k][0]
        data = values if k == 2 else struct.pack(order + letter * len(values), *values)
        word = struct.calcsize(long)
        if len(data) > word:
            place = struct.pack(order + long, extra_at + len(extra))
            extra += data
        else:
            place = data.ljust(word, b"\0")
        table += struct.pack(order + "HH" + long, tag, k, len(values)) + place
    first = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at))
    path.write_bytes(first + body + table + struct.pack(order + long, 0) + extra)


CASES = [
    {"rows": 5},
    {"rows": 16, "cols": 16, "deflate": True},
    {"rows": 7, "order": ">", "planar": True},
    {"rows": 16, "cols": 32, "deflate": True, "predictor": 2, "big": True},
    {"rows": 9, "order": ">", "deflate": True, "predictor": 2, "planar": True},
]


@pytest.mark.parametrize("case", range(len(CASES)))
@pytest.mark.parametrize("dtype", ["u1", "i2", "f4"])
def test_files_come_back(spark, tmp_path, case, dtype):
    options = CASES[case]
    if dtype == "f4":
        options = options | {"predictor": 1}
    rng = np.random.default_rng(case)
    array = rng.integers(0, 100, (3, 37, 53)).astype(dtype)
    write_tiff(tmp_path / "a.tif", array, **options)
    scene, px = geotiff_scene(spark, str(tmp_path / "a.tif"))
    assert (scene.height, scene.width, scene.bands, scene.a, scene.e, scene.c, scene.f) == (37, 53, ("b1", "b2", "b3"), 0.5, -0.5, 1000.0, 2000.0)
    assert (scene.nodata, scene.crs, scene.striped) == (-9.0, "EPSG:2180", "cols" not in options)
    rows = px.toPandas().sort_values(["r", "c"])
    assert len(rows) == 37 * 53 and all((rows[f"b{k + 1}"].to_numpy().reshape(37, 53) == array[k]).all() for k in range(3))


def test_a_window_reads_its_blocks_only(spark, tmp_path):
    """Damaged blocks outside the window are never decoded."""
    array = np.arange(2 * 64 * 96, dtype="u2").reshape(2, 64, 96)
    path = tmp_path / "b.tif"
    write_tiff(path, array, 16, 16, deflate=True)
    _, layout = geotiff.read_header(str(path))
    data = bytearray(path.read_bytes())
    inside = {r * 6 + c for r in (1, 2) for c in (2, 3)}
    for k, (at, size) in enumerate(zip(layout.offsets, layout.sizes, strict=True)):
        if k not in inside:
            data[at : at + size] = b"\xff" * size
    path.write_bytes(bytes(data))
    _, px = geotiff.read_geotiff(spark, str(path), block_bytes=1)
    part = window(px, 17, 48, 33, 64)
    assert part.rdd.getNumPartitions() == 4
    got = part.agg(F.count("*"), F.sum("b2")).first()
    assert tuple(got) == (31 * 31, float(array[1, 17:48, 33:64].sum()))
    assert window(px, 40, 40, 0, 9).count() == 0 and px.where("r = 20 and c = 40").first().b1 == array[0, 20, 40]


def test_other_files_are_errors(spark, tmp_path):
    (tmp_path / "c.tif").write_bytes(b"no raster at all")
    with pytest.raises(RuntimeError):
        geotiff_scene(spark, str(tmp_path / "c.tif"))
