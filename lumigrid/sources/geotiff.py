"""GeoTIFF rasters as a Spark data source, format ``geotiff``: rows (r, c, b1, b2, ...).

The file's own block table (strips or tiles) makes the partitions: neighbouring blocks up to
``blockBytes`` of pixels are one. Filters on r and c, as ``window`` sets them, are pushed down and
drop blocks before they are read (``spark.sql.python.filterPushdown.enabled``). A task seeks to its
blocks and decodes them; the driver reads the header alone.

Covered are classic and big files of either byte order, strips and tiles, bands in one plane or each
in its own, whole numbers and floats of 8 to 64 bits, without compression or deflate, with or without
horizontal differences. Anything else is an error that names it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from lumigrid.sources.raster import Scene

# Fixed values of the format: field types (code, struct letter, bytes) and the tags that are read.
TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 13: ("I", 4), 16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, BANDS, STRIP_ROWS, STRIP_BYTES, PLANES = 256, 257, 258, 259, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, KIND = 317, 322, 323, 324, 325, 339
SCALE, TIEPOINT, GEO_KEYS, NODATA = 33550, 33922, 34735, 42113
KINDS = {1: "u", 2: "i", 3: "f"}
PLAIN, DEFLATE = (1,), (8, 32946)
PROJECTED, GEOGRAPHIC = 3072, 2048


def _open(path: str):
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(at)


@dataclass(frozen=True)
class Layout:
    """Where a file's pixels are: block (row, column) of a plane is at offsets[plane * per_plane + row * across + column]."""

    height: int
    width: int
    bands: int
    dtype: str
    rows: int
    cols: int
    planes: int
    deflate: bool
    predictor: int
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]

    @property
    def across(self) -> int:
        return -(-self.width // self.cols)

    @property
    def down(self) -> int:
        return -(-self.height // self.rows)


def read_header(path: str) -> tuple[Scene, Layout]:
    """The scene and the layout of the first image in a file."""
    with _open(path) as file:
        head = file.read(16)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if order is None:
            raise ValueError(f"{path} is no TIFF file")
        big = struct.unpack(order + "H", head[2:4])[0] == 43
        at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
        count_of, entry, word = ("Q", 20, 8) if big else ("H", 12, 4)
        file.seek(at)
        n = struct.unpack(order + count_of, file.read(struct.calcsize(count_of)))[0]
        table = file.read(n * entry)
        tags: dict[int, tuple] = {}
        for k in range(n):
            tag, kind = struct.unpack(order + "HH", table[k * entry : k * entry + 4])
            count = struct.unpack(order + ("Q" if big else "I"), table[k * entry + 4 : k * entry + 4 + word])[0]
            if kind not in TYPES:
                continue
            letter, size = TYPES[kind]
            value = table[k * entry + 4 + word : (k + 1) * entry]
            if count * size > word:
                file.seek(struct.unpack(order + ("Q" if big else "I"), value)[0])
                value = file.read(count * size)
            value = value[: count * size]
            tags[tag] = (value,) if letter == "s" else struct.unpack(order + letter * count, value)
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    bands, bits, kinds = one(BANDS, 1), set(tags.get(BITS, (1,))), set(tags.get(KIND, (1,)))
    if one(COMPRESSION, 1) not in PLAIN + DEFLATE or len(bits) > 1 or len(kinds) > 1 or min(bits) < 8 or not kinds <= set(KINDS) or one(PREDICTOR, 1) not in (1, 2):
        raise ValueError(f"{path}: compression {one(COMPRESSION, 1)}, predictor {one(PREDICTOR, 1)}, bits {sorted(bits)}, sample kinds {sorted(kinds)} are not covered")
    tiled = TILES in tags
    height, width = one(HEIGHT), one(WIDTH)
    shape = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(STRIP_ROWS, height), height), width)
    dtype = order + KINDS[kinds.pop()] + str(bits.pop() // 8)
    layout = Layout(height, width, bands, dtype, *shape, bands if one(PLANES, 1) == 2 else 1, one(COMPRESSION, 1) in DEFLATE, one(PREDICTOR, 1), tags[TILES if tiled else STRIPS], tags[TILE_BYTES if tiled else STRIP_BYTES])
    sx, sy = tags.get(SCALE, (1.0, 1.0))[:2]
    i, j, _, x, y = tags.get(TIEPOINT, (0.0, 0.0, 0.0, 0.0, 0.0))[:5]
    keys = tags.get(GEO_KEYS, ())
    codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    code = codes.get(PROJECTED) or codes.get(GEOGRAPHIC)
    nodata = float(one(NODATA).rstrip(b"\0 ").decode()) if NODATA in tags else 0.0
    scene = Scene(height, width, tuple(f"b{k + 1}" for k in range(bands)), sx, x - i * sx, -sy, y + j * sy, nodata, f"EPSG:{code}" if code else "", shape[1] == width)
    return scene, layout


def decode_block(data: bytes, layout: Layout) -> np.ndarray:
    """(rows, cols, bands of the plane) of a block; the last strip may have fewer rows."""
    bands = 1 if layout.planes > 1 else layout.bands
    values = np.frombuffer(zlib.decompress(data) if layout.deflate else data, layout.dtype)
    rows = len(values) // (layout.cols * bands)
    block = values[: rows * layout.cols * bands].reshape(rows, layout.cols, bands)
    return np.cumsum(block, axis=1, dtype=block.dtype) if layout.predictor == 2 else block


@dataclass
class Blocks(InputPartition):
    """Neighbouring blocks of one row of blocks."""

    row: int
    first: int
    stop: int


class GeoTiffReader(DataSourceReader):
    def __init__(self, path: str, layout: Layout, block_bytes: int):
        self.path, self.layout, self.block_bytes = path, layout, block_bytes
        self.low, self.high = {"r": 0, "c": 0}, {"r": layout.height, "c": layout.width}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of r and c narrow the window; Spark checks all filters again inside it."""
        for f in filters:
            name = getattr(f, "attribute", (None,))[0]
            if name in self.low and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low[name] = max(self.low[name], f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high[name] = min(self.high[name], f.value + (not isinstance(f, LessThan)))
            yield f

    def partitions(self) -> list[Blocks]:
        t = self.layout
        if self.low["r"] >= self.high["r"] or self.low["c"] >= self.high["c"]:
            return []
        most = max(1, self.block_bytes // (t.rows * t.cols * t.bands * np.dtype(t.dtype).itemsize))
        c0, c1 = self.low["c"] // t.cols, -(-self.high["c"] // t.cols)
        return [Blocks(r, c, min(c + most, c1)) for r in range(self.low["r"] // t.rows, -(-self.high["r"] // t.rows)) for c in range(c0, c1, most)]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        t, names = self.layout, ["r", "c", *(f"b{k + 1}" for k in range(self.layout.bands))]
        with _open(self.path) as file:
            for col in range(partition.first, partition.stop):
                planes = []
                for plane in range(t.planes):
                    k = plane * t.across * t.down + partition.row * t.across + col
                    file.seek(t.offsets[k])
                    planes.append(decode_block(file.read(t.sizes[k]), t))
                block = np.concatenate(planes, axis=2)
                r0, c0 = partition.row * t.rows, col * t.cols
                a, b = max(self.low["r"] - r0, 0), min(self.high["r"] - r0, len(block))
                x, y = max(self.low["c"] - c0, 0), min(self.high["c"] - c0, t.cols)
                if a >= b or x >= y:
                    continue
                rr, cc = np.mgrid[r0 + a : r0 + b, c0 + x : c0 + y].astype(np.int32)
                bands = block[a:b, x:y].astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(rr.ravel()), pa.array(cc.ravel()), *(pa.array(np.ascontiguousarray(bands[:, :, k]).ravel()) for k in range(t.bands))], names=names)


class GeoTiff(DataSource):
    """Options: path; blockBytes, how many bytes of pixels a partition takes at least (4 MB)."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return "r int, c int, " + ", ".join(f"{b} double" for b in read_header(self.options["path"])[0].bands)

    def reader(self, schema: StructType) -> GeoTiffReader:
        return GeoTiffReader(self.options["path"], read_header(self.options["path"])[1], int(self.options.get("blockBytes", 4 << 20)))


def read_geotiff(spark: SparkSession, path: str, block_bytes: int = 4 << 20) -> tuple[Scene, DataFrame]:
    """The scene of a file and its pixels."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoTiff)
    return read_header(path)[0], spark.read.format("geotiff").option("path", path).option("blockBytes", block_bytes).load()
