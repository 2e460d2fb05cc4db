"""Tile grids and how pixels, points and seeds meet tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tile_grid(spark: SparkSession, height: int, width: int, tile: int = 2400, overlap: int = 200) -> DataFrame:
    """Overlapping tiles (tile_id, r0, c0, h, w, cr0, cr1, cc0, cc1) in row-major order. Cores take
    half of each overlap and reach to the scene's edge; they cover every pixel once."""
    step, half = tile - overlap, overlap // 2

    def axis(dim: int, name: str) -> DataFrame:
        starts = spark.range(0, max(dim - overlap, 1), step).select(F.col("id").cast("int").alias(f"{name}0"))
        size = F.least(F.lit(tile), F.lit(dim) - F.col(f"{name}0"))
        end = F.col(f"{name}0") + size
        low = F.when(F.col(f"{name}0") == 0, 0).otherwise(F.col(f"{name}0") + half)
        high = F.when(end >= dim, dim).otherwise(end - half)
        return starts.select(f"{name}0", size.cast("int").alias(f"{name}n"), low.cast("int").alias(f"c{name}0"), high.cast("int").alias(f"c{name}1"))

    columns = len(range(0, max(width - overlap, 1), step))
    rows = axis(height, "r").withColumn("k", F.lit(1))
    cols = axis(width, "c").withColumn("k", F.lit(1))
    # a row of tiles for each of a handful of starts: sizes follow the scene's outline only
    grid = rows.join(cols, "k")
    tid = F.floor(F.col("r0") / step) * columns + F.floor(F.col("c0") / step)
    return grid.select(tid.cast("int").alias("tile_id"), "r0", "c0", F.col("rn").alias("h"), F.col("cn").alias("w"), "cr0", "cr1", "cc0", "cc1")


def _candidates(at: str, dim: int, tile: int, overlap: int) -> F.Column:
    """Indices of the tiles along one axis whose window holds a coordinate."""
    step = tile - overlap
    last = len(range(0, max(dim - overlap, 1), step)) - 1
    low = F.greatest(F.lit(0), F.floor((F.col(at) - tile) / step).cast("int") + 1)
    high = F.least(F.lit(last), F.floor(F.col(at) / step).cast("int"))
    return F.sequence(F.least(low, high), high)


def to_tiles(pixels: DataFrame, height: int, width: int, tile: int = 2400, overlap: int = 200) -> DataFrame:
    """Pixels once for every tile window that holds them (at most four), by arithmetic alone, with
    tile_id, tr and tc (row and column in the window) and core (is the pixel in the tile's core)."""
    step, half = tile - overlap, overlap // 2
    columns = len(range(0, max(width - overlap, 1), step))
    out = pixels.withColumn("__i", F.explode(_candidates("r", height, tile, overlap))).withColumn("__j", F.explode(_candidates("c", width, tile, overlap)))

    def inside(at: str, k: str, dim: int) -> F.Column:
        start = F.col(k) * step
        end = F.least(start + tile, F.lit(dim))
        return (F.col(at) >= F.when(F.col(k) == 0, 0).otherwise(start + half)) & (F.col(at) < F.when(end >= dim, dim).otherwise(end - half))

    return out.select(
        *pixels.columns,
        (F.col("__i") * columns + F.col("__j")).cast("int").alias("tile_id"),
        (F.col("r") - F.col("__i") * step).cast("int").alias("tr"),
        (F.col("c") - F.col("__j") * step).cast("int").alias("tc"),
        (inside("r", "__i", height) & inside("c", "__j", width)).alias("core"),
    )


def drop_sparse_tiles(tiled: DataFrame, least: int, valid: str = "valid") -> DataFrame:
    """Pixels of tiles with at least ``least`` valid ones."""
    enough = tiled.groupBy("tile_id").agg(F.count_if(F.col(valid)).alias("__n")).where(F.col("__n") >= least).select("tile_id")
    return tiled.join(enough, "tile_id", "left_semi")


def sample_tiles(tiles: DataFrame, count: int, total: int) -> DataFrame:
    """Every k-th tile, ``count`` at most, k = max(1, total // count)."""
    step = max(1, total // count)
    return tiles.where((F.col("tile_id") % step == 0) & (F.floor(F.col("tile_id") / step) < count))


def core_bands(height: int, width: int, tile: int, striped: bool, target_px: int = 6_000_000) -> tuple[int, int]:
    """Size (rows, columns) of the non-overlapping cores that growing uses: squares, or row bands of
    the full width for striped scenes. A core is one task, of about 40 bytes a pixel of two features;
    ``target_px`` keeps a band near the size of a default square."""
    return (max(256, min(tile, target_px // width)), width) if striped else (tile, tile)


def to_cores(frame: DataFrame, rows: int, cols: int, width: int, row: str = "r", col: str = "c") -> DataFrame:
    """Adds core_id, the non-overlapping core that holds each point or pixel."""
    across = -(-width // cols)
    return frame.withColumn("core_id", (F.floor(F.col(row) / rows) * across + F.floor(F.col(col) / cols)).cast("int"))


def to_halos(frame: DataFrame, rows: int, cols: int, height: int, width: int, halo: int, row: str = "r", col: str = "c") -> DataFrame:
    """Rows once for every core whose window (core and halo) holds them, with core_id and in_core."""
    across, down = -(-width // cols), -(-height // rows)

    def reach(at: str, size: int, n: int) -> F.Column:
        low = F.greatest(F.lit(0), F.floor((F.col(at) - halo) / size).cast("int"))
        return F.sequence(low, F.greatest(low, F.least(F.lit(n - 1), F.floor((F.col(at) + halo) / size).cast("int"))))

    out = frame.withColumn("__i", F.explode(reach(row, rows, down))).withColumn("__j", F.explode(reach(col, cols, across)))
    own = (F.floor(F.col(row) / rows) == F.col("__i")) & (F.floor(F.col(col) / cols) == F.col("__j"))
    return out.select(*frame.columns, (F.col("__i") * across + F.col("__j")).cast("int").alias("core_id"), own.alias("in_core"))


def halo_px(max_radius: float) -> int:
    import math

    return max(math.ceil(2 * max_radius), 8)


def cores_with_seeds(seeds: DataFrame, rows: int, cols: int, width: int) -> DataFrame:
    return to_cores(seeds, rows, cols, width).select("core_id").distinct()


def cores_without_seeds(cores: DataFrame, seeded: DataFrame) -> DataFrame:
    return cores.select("core_id").exceptAll(seeded.select("core_id"))
