"""Growing of points into regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigrid.functions.crs import transform
from lumigrid.functions.pixel import growing_space
from lumigrid.operators import grow as kernels
from lumigrid.operators.components import cut
from lumigrid.operators.modes import auto_mode, grow_recipe, resolve_mode
from lumigrid.operators.objects import running_ids
from lumigrid.operators.tiles import core_bands
from lumigrid.operators.zonal import to_uint8
from lumigrid.sources.raster import Scene, with_roles, write_crowns, write_raster


def grow_crowns(spark: SparkSession, scene: Scene, pixels: DataFrame, points: DataFrame, out: str | None = None, labels_out: str | None = None, mode: str | None = None, bands=None, space: str = "auto", rule: str = "auto", tile: int = 2048, clip_to_core: bool = True, scale_scope: str = "window", points_crs: str = "", **overrides) -> DataFrame | int:
    """Regions grown from points (x, y): (adaptel_id, area_m2, perimeter, n_parts, wkt). adaptel_id is
    the point's id where it has one, else its place in the order of (x, y) from 0. Points off the
    scene or on missing pixels give no region; no points give an empty table. Bands are scaled to
    0..255 in each core's window (scale_scope "scene": over the whole scene); regions are cut at their
    seed's core, or whole where clip_to_core is off: overlapping pixels then count for both, and the
    label raster gives them to the smallest id. Points in another coordinate system (points_crs) are
    brought to the scene's."""
    if scale_scope not in ("window", "scene"):
        raise ValueError(f"scale_scope is window or scene, not {scale_scope!r}")
    name, roles, _ = auto_mode(pixels, scene.bands, scene.height, scene.width, mode, bands, nodata=scene.nodata)
    chosen, index = resolve_mode(len(scene.bands), name, roles)
    recipe = grow_recipe(chosen.roles, space, rule, **overrides)
    x, y = transform(F.col("x"), F.col("y"), points_crs, scene.crs)
    points = points.withColumns({"x": x, "y": y})
    row, col = scene.affine.to_pixel(F.col("x"), F.col("y"))
    if "gid" in points.columns:
        named = points
    elif "id" in points.columns:
        named = points.withColumn("gid", F.col("id").cast("long"))
    else:
        strips = points.withColumn("__strip", F.floor(F.col("x") / (256 * scene.affine.a)))
        named = running_ids(strips, "__strip", ["x", "y"], "gid").withColumn("gid", F.col("gid").cast("long") - 1)
    seeds = named.select("gid", F.floor(row).cast("int").alias("r"), F.floor(col).cast("int").alias("c"))
    px = with_roles(pixels, scene, index)
    px = px.withColumns({r: F.when(F.col("valid"), F.col(r)).otherwise(F.lit(0.0)) for r in chosen.roles})
    feats = [f.alias(f"f{k}") for k, f in enumerate(growing_space(recipe.space, chosen.trio))]

    def scaled(frame, keys):
        return to_uint8(frame, chosen.roles, keys).select("*", *feats)

    if scale_scope == "scene":
        px, prepare = scaled(px.withColumn("__one", F.lit(0)), ["__one"]).drop("__one"), None
    else:
        prepare = lambda windows: scaled(windows, ["core_id"])
    rows, cols = core_bands(scene.height, scene.width, tile, scene.striped)
    labels = cut(kernels.grow_seeds(px, seeds, [f"f{k}" for k in range(len(feats))], recipe, scene.height, scene.width, rows, cols, clip_to_core, prepare), "labels")
    if labels_out:
        write_raster(kernels.label_raster(px, labels.groupBy("r", "c").agg(F.min("gid").alias("gid"))), labels_out)
    shapes = kernels.polygonize(labels, scene.a, scene.c, scene.e, scene.f)
    crowns = kernels.crown_statistics(labels, scene.affine.pixel_area).drop("n_px").join(shapes, "adaptel_id").select("adaptel_id", *(F.round(c, 2).alias(c) for c in ("area_m2", "perimeter")), "n_parts", "wkt")
    return crowns if out is None else write_crowns(crowns, out)
