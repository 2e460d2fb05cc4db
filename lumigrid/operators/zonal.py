"""Statistics of segments: window means, spectral, hue and shape features."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumigrid.functions.color import lch
from lumigrid.functions.pixel import index
from lumigrid.operators.modes import BOX_PX, GSD, BandMode


#: Side of the blocks in which box means are taken.
BOX_BLOCK = 1024


def to_uint8(tiled: DataFrame, bands: Sequence[str], keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Bands on the 0..255 scale. Where a window's largest finite value passes 255 its 99.9th
    percentile is scaled to 255. Invalid pixels count as 0, and take part as such."""
    def safe(b: str) -> Column:
        return F.when(F.isnan(b) | (F.abs(b) == float("inf")), None).otherwise(F.col(b).cast("double"))

    stats = tiled.groupBy(*keys).agg(*(F.max(safe(b)).alias(f"__m_{b}") for b in bands), *(F.percentile(safe(b), F.lit(0.999)).alias(f"__p_{b}") for b in bands))
    joined = tiled.join(stats, list(keys))
    for b in bands:
        scaled = F.when(F.col(f"__m_{b}") > 255, F.col(b) * (F.lit(255.0) / F.greatest(F.col(f"__p_{b}"), F.lit(1.0)))).otherwise(F.col(b).cast("double"))
        joined = joined.withColumn(b, F.least(F.greatest(scaled, F.lit(0.0)), F.lit(255.0)))
    return joined.select(*tiled.columns)


def box_sums(values: np.ndarray, size: int) -> np.ndarray:
    """Sums over the size x size box around each cell of (..., rows, cols), edge values repeated
    outwards: differences of two-dimensional prefix sums, the repeats by arithmetic."""
    reach = size // 2
    for axis in (-2, -1):
        n = values.shape[axis]
        run = np.cumsum(values, axis=axis)
        at = np.arange(n)
        high = np.take(run, np.minimum(at + reach, n - 1), axis)
        low = np.where(np.expand_dims(at - reach > 0, -1) if axis == -2 else at - reach > 0, np.take(run, np.maximum(at - reach - 1, 0), axis), 0.0)
        before, after = np.maximum(reach - at, 0), np.maximum(at + reach - n + 1, 0)
        if axis == -2:
            before, after = before[:, None], after[:, None]
        values = high - low + before * np.take(values, [0], axis) + after * np.take(values, [n - 1], axis)
    return values


def box_mean(tiled: DataFrame, bands: Sequence[str], size: int = BOX_PX, keys: Sequence[str] = ("tile_id",), row: str = "tr", col: str = "tc", valid: str = "valid", prefix: str = "lm_", block: int = BOX_BLOCK) -> DataFrame:
    """Adds ``prefix + band``: mean over a size x size box around each pixel, without invalid pixels,
    the window's edge pixels repeated outwards. Windows (keys) must be complete grids; without keys
    the scene is one.

    Windows are cut into blocks of ``block`` pixels with a margin as wide as a box reaches, so one
    shuffle brings every block's pixels into a task of its own, whatever the window's size, and a
    summed-area table per band gives all means at once.
    """
    reach, names = size // 2, list(bands)
    at = tiled.withColumns({"__r": F.col(row), "__c": F.col(col)})
    span = lambda c: F.sequence(F.greatest(F.floor((F.col(c) - reach) / block), F.lit(0)), F.floor((F.col(c) + reach) / block))
    near = at.withColumn("__i", F.explode(span("__r"))).withColumn("__j", F.explode(span("__c")))
    own = (F.floor(F.col("__r") / block) == F.col("__i")) & (F.floor(F.col("__c") / block) == F.col("__j"))
    # a margin's pixel brings its bands only
    near = near.select(*(F.when(own, F.col(c)).alias(c) if c not in (*keys, row, col, valid, *names) else F.col(c) for c in tiled.columns), "__i", "__j", own.alias("__own"))

    def run(key, table):
        r, c = (table[n].to_numpy().astype(np.int64) for n in (row, col))
        r0, c0 = r.min(), c.min()
        shape = (int(r.max() - r0) + 1, int(c.max() - c0) + 1)
        place = (r - r0) * shape[1] + c - c0
        ok = table[valid].fill_null(False).to_numpy(zero_copy_only=False)
        mine = np.flatnonzero(table["__own"].to_numpy(zero_copy_only=False))
        out = table.drop_columns(["__i", "__j", "__own"]).take(mine)

        def spread(values: np.ndarray) -> np.ndarray:
            grid = np.zeros(shape[0] * shape[1])
            grid[place] = values
            return box_sums(grid.reshape(shape), size).ravel()[place[mine]]

        share = np.maximum(spread(ok.astype(np.float64)) / (size * size), 1e-6)
        for b in names:
            v = table[b].cast(pa.float64()).fill_null(0.0).to_numpy()
            out = out.append_column(f"{prefix}{b}", pa.array(spread(np.where(ok, v, 0.0)) / (size * size) / share))
        return out

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tiled.schema) + "".join(f", `{prefix}{b}` double" for b in names)
    return near.groupBy(*keys, "__i", "__j").applyInArrow(run, kind)


def with_bands(tiled: DataFrame, mode: BandMode) -> DataFrame:
    """Adds the mode's index columns and lightness, chroma, hue of its trio."""
    lightness, chroma, hue = lch(*(F.col(b) for b in mode.trio))
    return tiled.withColumns({n: index(n) for n in mode.indices}).withColumns({"lightness": lightness, "chroma": chroma, "hue": hue})


def eigen_ratio(sxx: Column, syy: Column, sxy: Column) -> Column:
    """Square root of the ratio of the eigenvalues of a 2x2 covariance, the small one at least 1e-9."""
    half = (sxx + syy) / 2.0
    root = F.sqrt(F.greatest(half * half - (sxx * syy - sxy * sxy), F.lit(0.0)))
    return F.sqrt((half + root) / F.greatest(half - root, F.lit(1e-9)))


def zonal_features(tiled: DataFrame, mode: BandMode, keys: Sequence[str] = ("tile_id", "seg"), box: int = BOX_PX, row: str = "tr", col: str = "tc", gsd: float = GSD, window_keys: Sequence[str] = ("tile_id",), block: int = BOX_BLOCK) -> DataFrame:
    """One row per segment of valid pixels: cnt, mr, mc and the mode's features, named with ``_`` for
    the dots of the contract (sr_NDVI ... wydluzenie)."""
    bands = {n: n for n in mode.indices} | {"L": "lightness", "C": "chroma"}
    named = with_bands(tiled, mode).select(*dict.fromkeys([*window_keys, *keys, row, col, "valid", *bands.values(), "hue"]))
    px = box_mean(named, list(bands.values()), box, window_keys, row, col, block=block).where(F.col("valid") & F.col(keys[-1]).isNotNull())
    aggs = []
    for b, v in bands.items():
        aggs += [F.avg(v).alias(f"sr_{b}"), F.stddev_pop(v).alias(f"sd_{b}"), (F.avg(v) - F.avg(f"lm_{v}")).alias(f"ktr_{b}")]
    hue = F.radians("hue")
    r, c = F.col(row).cast("double"), F.col(col).cast("double")
    aggs += [F.avg(F.cos(hue)).alias("cos_Hab"), F.avg(F.sin(hue)).alias("sin_Hab")]
    aggs += [F.count("*").alias("cnt"), F.avg(r).alias("mr"), F.avg(c).alias("mc"), F.var_pop(r).alias("__rr"), F.var_pop(c).alias("__cc"), F.covar_pop(r, c).alias("__rc")]
    out = px.groupBy(*keys).agg(*aggs)
    out = out.withColumns({"war_Hab": 1.0 - F.sqrt(F.col("cos_Hab") ** 2 + F.col("sin_Hab") ** 2), "pow_m2": F.col("cnt") * (gsd * gsd), "wydluzenie": eigen_ratio(F.col("__rr"), F.col("__cc"), F.col("__rc"))})
    names = [f"{k}_{b}" for b in bands for k in ("sr", "sd", "ktr")] + ["cos_Hab", "sin_Hab", "war_Hab", "pow_m2", "wydluzenie"]
    return out.select(*keys, "cnt", "mr", "mc", *names)


def spark_names(names: Sequence[str]) -> list[str]:
    """Contract feature names as column names: dots become underscores."""
    return [n.replace(".", "_") for n in names]
