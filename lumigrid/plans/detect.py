"""Detection of scored point objects in a scene, as one plan keyed by tile."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from types import FunctionType

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigrid.operators import forest, graph, normalise, objects, spatial, tiles, zonal
from lumigrid.operators.components import cut
from lumigrid.operators.modes import BOX_PX, GSD, MIN_PX, MIN_VALID_PX, SUPPRESS_M, BandMode, Manifest, auto_mode, feature_names, resolve_mode, resolve_threshold, scene_norm_policy
from lumigrid.operators.segment import segment_tiles
from lumigrid.plans.watch import watched
from lumigrid.sources.raster import POINT_COLUMNS, Scene, resample, with_roles, write_points, write_raster

Segmenter = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class DetectConfig:
    """Options of a run; defaults are those of the published tool."""

    mode: str | None = None
    bands: Sequence[str] | None = None
    threshold: float | None = None
    stand_age: float | None = 10
    stand_buffer: float = -2.0
    keep_outside: bool = False
    min_height: float = 3.0
    height_radius: float = 3.0
    keep_low: bool = False
    suppress_m: float = SUPPRESS_M
    suppress_scope: str = "tile"
    stitch: bool = False
    min_area: float = 0.0
    object_threshold: float | None = None
    edge_px: int = 8
    tile: int = 2400
    overlap: int = 200
    granularity: float | None = None
    scene_norm: object = "auto"
    norm_tiles: int = 16
    radiometry: object = "off"
    min_valid_px: int = MIN_VALID_PX
    min_px: int = MIN_PX
    box_px: int = BOX_PX
    gsd: float = GSD
    segmenter: Segmenter | None = None
    manifest: Manifest = field(default_factory=Manifest)


@dataclass(frozen=True)
class Detection:
    """Frames of the in-memory pipeline: pixels (with seg), segments (features, p), links between
    segments, members (seg to obj) and objects (features, cx, cy in pixel units of the map)."""

    pixels: DataFrame
    segments: DataFrame
    links: DataFrame
    members: DataFrame
    objects: DataFrame


def score_segments(segments: DataFrame, model, names: Sequence[str], norm: dict[str, Column] | None, min_px: int = MIN_PX) -> DataFrame:
    """Adds p: the model's probability on segments of enough pixels, 0 on others. Normalised features
    (``norm``, from ``robust_scores``) only serve the score."""
    inputs = segments.where(F.col("cnt") >= min_px).withColumns(norm or {})
    used = list(dict.fromkeys([*names, *(norm or {})]))
    scored = forest.score(inputs, model, used).select("tile_id", "seg", "p")
    return segments.join(scored, ["tile_id", "seg"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))


def detect_frame(tiled: DataFrame, mode: BandMode, model, threshold: float, scene: Scene, config: DetectConfig | None = None, norm: dict[str, Column] | None = None) -> Detection:
    """The pipeline from tiled pixels (tile_id, r, c, tr, tc, core, valid, one column per role) to
    objects. Object features are means of the features before normalisation. With ``stitch`` tiles
    don't overlap, segments are named over the scene, and objects reach over tile borders."""
    cfg = config or DetectConfig()
    ids = [] if cfg.stitch else ["tile_id"]
    names = zonal.spark_names(feature_names(mode))
    if "seg" not in tiled.columns:
        step = cfg.segmenter or (lambda t: segment_tiles(t, mode.roles, cfg.granularity or mode.granularity))
        tiled = cut(step(tiled), "segments")
    segments = zonal.zonal_features(tiled, mode, box=cfg.box_px, gsd=cfg.gsd)
    corner = tiled.groupBy("tile_id").agg(F.min(F.col("r") - F.col("tr")).alias("__r0"), F.min(F.col("c") - F.col("tc")).alias("__c0"))
    x, y = scene.affine.to_map(F.col("mr") + F.col("__r0"), F.col("mc") + F.col("__c0"))
    segments = segments.join(corner, "tile_id").withColumns({"area": F.col("cnt") * (cfg.gsd**2), "x": x, "y": y}).drop("__r0", "__c0")
    segments = cut(score_segments(segments, model, names, norm, cfg.min_px), "scored")
    links = cut(graph.edges(tiled, ids, row="r", col="c"), "links")
    picked = segments.where((F.col("cnt") >= cfg.min_px) & (F.col("p") >= threshold)).select("tile_id", "seg")
    members = cut(graph.build_objects(picked, links, ids, place="tile_id" if cfg.stitch else None), "members")
    found = objects.describe_objects(members, segments.drop("tile_id") if cfg.stitch else segments, links, names, ids)
    return Detection(tiled, segments, links, members, found)


def own_objects(found: DataFrame, scene: Scene, config: DetectConfig) -> DataFrame:
    """Objects whose centroid lies in their own tile's core (half-open, fractional pixels). Objects of
    the scene, which have no tile, get that of their centroid."""
    spark = found.sparkSession
    row, col = scene.affine.to_pixel(F.col("cx"), F.col("cy"))
    grid = tiles.tile_grid(spark, scene.height, scene.width, config.tile, config.overlap)
    inside = (F.col("gr") >= F.col("cr0")) & (F.col("gr") < F.col("cr1")) & (F.col("gc") >= F.col("cc0")) & (F.col("gc") < F.col("cc1"))
    placed = found.withColumns({"gr": row, "gc": col})
    if config.stitch:
        across = len(range(0, max(scene.width - config.overlap, 1), config.tile - config.overlap))
        placed = placed.withColumn("tile_id", (F.floor(F.col("gr") / config.tile) * across + F.floor(F.col("gc") / config.tile)).cast("int"))
    return placed.join(grid, "tile_id").where(inside)


def points_of(found: Detection, scene: Scene, mode: BandMode, config: DetectConfig, object_model=None, stands: DataFrame | None = None, heights: tuple = (), model_name: str = "custom") -> DataFrame:
    """The point layer: ownership, area, object stage, stands, heights, suppression, distances and
    running ids, cheap filters first."""
    names = zonal.spark_names(feature_names(mode))
    obj_names = ["pow", "nseg", "elong", "elong_seg", "s_max", "s_mean", "s_min", "ring_ndvi", "ring_L", "ring_n", *(f"obj_{n}" for n in names)]
    out = own_objects(found.objects, scene, config)
    finite = None
    for n in obj_names:
        ok = F.col(n).isNotNull() & ~F.isnan(F.col(n).cast("double"))
        finite = ok if finite is None else finite & ok
    out = out.where((F.col("pow") >= config.min_area) & finite)
    if object_model is not None:
        out = forest.score(out, object_model, obj_names, "p_object")
        if config.object_threshold is not None:
            out = out.where(F.col("p_object") >= config.object_threshold)
    else:
        out = out.withColumn("p_object", F.lit(None).cast("double"))
    pid = F.col("obj") if config.stitch else F.shiftleft(F.col("tile_id").cast("long"), 32) + F.col("obj")
    out = out.withColumn("pid", pid).withColumns({"x": F.col("cx"), "y": F.col("cy")})
    if stands is not None:
        out = spatial.inside_stands(out, spatial.usable_stands(stands, config.stand_age), config.stand_buffer, id_col="pid")
        out = out if config.keep_outside else out.where("in_stands = 1")
    else:
        out = out.withColumn("in_stands", F.lit(None).cast("int"))
    if heights:
        # a raster with a header lies on its own grid, a bare table on the scene's
        top, *ground = (h if isinstance(h, tuple) else (scene, h) for h in heights)
        out = spatial.heights_at(out, top, config.height_radius, "height_m" if not ground else "__top", "pid", crs=scene.crs)
        if ground:
            out = spatial.heights_at(out, ground[0], 0.0, "__ground", "pid", crs=scene.crs).withColumn("height_m", F.col("__top") - F.col("__ground")).drop("__top", "__ground")
        out = out if config.keep_low else spatial.drop_low(out, config.min_height)
    else:
        out = out.withColumn("height_m", F.lit(None).cast("double"))
    out = cut(out, "candidates")
    keys = ["tile_id"] if config.suppress_scope == "tile" else []
    out = graph.suppress(out, config.suppress_m, "pid", "x", "y", "s_max", keys).where("keep").drop("keep")
    if config.edge_px:
        out = edge_distance(out, found.pixels, scene, config)
    else:
        out = out.withColumn("edge_px", F.lit(None).cast("double"))
    # numbers run tile by tile, or over the names of the scene's objects, of which a stretch is a group
    out = out.drop("id").withColumn("__stretch", F.shiftright("obj", 16))
    out = objects.running_ids(out, "__stretch" if config.stitch else "tile_id", ["obj"])
    return out.select(
        F.col("id").cast("int").alias("id"), "x", "y",
        F.round("s_max", 4).alias("p"), F.round("s_mean", 4).alias("p_mean"), F.round("p_object", 4).alias("p_object"),
        F.round("pow", 2).alias("area_m2"), F.col("nseg").cast("int").alias("n_adaptels"), "in_stands",
        F.round("height_m", 2).alias("height_m"), F.round("edge_px", 1).alias("edge_px"),
        F.format_string("%d_%d", "r0", "c0").alias("tile"), F.lit(mode.name).alias("mode"), F.lit(model_name).alias("model"),
    ).select(*POINT_COLUMNS)


def edge_distance(points: DataFrame, pixels: DataFrame, scene: Scene, config: DetectConfig) -> DataFrame:
    """Adds edge_px: the distance of each point's pixel (the nearest whole one, ties to even, inside
    the window) to the nearest missing pixel of its tile's window or to just outside the window. A
    tile's missing pixels and points meet in one task."""
    spot = lambda at, start, n: F.least(F.greatest(F.bround(F.col(at) - F.col(start), 0), F.lit(0)), F.col(n) - 1).cast("int")
    near = points.select("pid", "tile_id", "h", "w", spot("gr", "r0", "h").alias("lr"), spot("gc", "c0", "w").alias("lc"))
    missing = pixels.where("not valid").select("tile_id", "tr", "tc").join(near.select("tile_id").distinct(), "tile_id", "left_semi")

    def run(gaps: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
        if not len(seeds):
            return pd.DataFrame({"pid": [], "edge_px": []})
        h, w = int(seeds["h"].iloc[0]), int(seeds["w"].iloc[0])
        rows = np.unique(seeds["lr"])
        along = spatial.column_gaps(gaps["tr"].to_numpy(np.int64), gaps["tc"].to_numpy(np.int64), rows, np.full(w, -np.inf), np.full(w, np.inf))
        found = [spatial.nearest_in_row(along[np.searchsorted(rows, r)], c, min(r + 1, h - r, c + 1, w - c)) for r, c in zip(seeds["lr"], seeds["lc"], strict=True)]
        return pd.DataFrame({"pid": seeds["pid"], "edge_px": found})

    return points.join(missing.groupBy("tile_id").cogroup(near.groupBy("tile_id")).applyInPandas(run, "pid bigint, edge_px double"), "pid", "left")


def probability_raster(found: Detection) -> DataFrame:
    """(r, c, p) of core pixels; -1 where invalid."""
    px = found.pixels.where("core").select("tile_id", "r", "c", "seg")
    return px.join(found.segments.select("tile_id", "seg", "p"), ["tile_id", "seg"], "left").select("r", "c", F.coalesce("p", F.lit(-1.0)).cast("float").alias("p"))


def detect(spark: SparkSession, scene: Scene, pixels: DataFrame, model, out: str | None = None, object_model=None, stands: DataFrame | None = None, heights: tuple = (), prob_raster: str | None = None, model_key: str | None = None, progress: Callable[[str], object] | None = None, model_name: str = "custom", **options) -> DataFrame | int:
    """One point per object of a scene. With ``out`` the layer is written and counted, else the
    frame is returned. ``model_key`` names a shipped model (its manifest then sets threshold and
    normalisation); otherwise the model counts as the user's own. ``model`` may be a function that
    gets the name of the band mode, once that is known, and returns (model, object model or None,
    model key). ``model_name`` is how the layer calls a model without a key. Heights are one raster, or surface and terrain, each a table of (r, c, h) on the
    scene's grid or a pair (scene, table). A progress callback is told the stages
    and how far their jobs are; if it returns False, running jobs are interrupted and the run ends in
    ``watch.Stopped``."""
    with watched(spark, progress) as tell:
        return _detect(spark, scene, pixels, model, out, object_model, stands, heights, prob_raster, model_key, tell, model_name, DetectConfig(**options))


def _detect(spark: SparkSession, scene: Scene, pixels: DataFrame, model, out, object_model, stands, heights, prob_raster, model_key, tell, model_name: str, cfg: DetectConfig) -> DataFrame | int:
    tell("open")
    scene, pixels = resample(scene, pixels, cfg.gsd)
    mode_name, roles, _ = auto_mode(pixels, scene.bands, scene.height, scene.width, cfg.mode, cfg.bands, nodata=scene.nodata)
    mode, index = resolve_mode(len(scene.bands), mode_name, roles)
    if isinstance(model, FunctionType):
        model, object_model, model_key = model(mode.name)
    threshold = resolve_threshold(cfg.threshold, cfg.manifest, mode.name, model_key is None)
    # columns that robust_scores made elsewhere are taken as they are
    norm = cfg.scene_norm if isinstance(cfg.scene_norm, dict) else None
    policy = scene_norm_policy(cfg.scene_norm, cfg.manifest, model_key or "", model_key is None) if norm is None else None
    tiled = tiles.to_tiles(with_roles(pixels, scene, index), scene.height, scene.width, cfg.tile, cfg.overlap)
    tiled = tiles.drop_sparse_tiles(tiled, cfg.min_valid_px)
    measured = _sampled(tiled, scene, cfg).where("valid")
    tiled = tiled.withColumns({r: F.when(F.col("valid"), F.col(r)).otherwise(F.lit(0.0)) for r in mode.roles})
    tiled = cut(zonal.to_uint8(tiled, mode.roles), "tiles")
    tell("radiometry")
    if cfg.radiometry != "off":
        given = not isinstance(cfg.radiometry, str)  # rows that measure_bands found elsewhere
        found = cfg.radiometry if given else normalise.measure_bands(normalise.every_fourth(zonal.to_uint8(measured, mode.roles)), mode.roles).collect()  # a row per band; scaled by valid pixels alone
        if given or normalise.needs_match(found, cfg.radiometry):
            tiled = normalise.match_bands(tiled, found)
    step = cfg.segmenter or (lambda t: segment_tiles(t, mode.roles, cfg.granularity or mode.granularity))
    tiled = cut(step(tiled), "segmented")
    if policy is not None:
        tell("normalise")
        columns = zonal.spark_names(policy[1])
        sampled = zonal.zonal_features(_sampled(tiled, scene, cfg), mode, box=cfg.box_px, gsd=cfg.gsd)
        norm = normalise.robust_scores(normalise.robust_statistics(forest.clean(sampled.where(F.col("cnt") >= cfg.min_px), columns), columns), policy[0])
    tell("objects")
    found = detect_frame(tiled, mode, model, threshold, scene, replace(cfg, segmenter=None), norm)
    points = points_of(found, scene, mode, cfg, object_model, stands, heights, model_key or model_name)
    if prob_raster:
        write_raster(probability_raster(found), prob_raster)
    tell("write")
    return points if out is None else write_points(points, out)


def _sampled(tiled: DataFrame, scene: Scene, cfg: DetectConfig) -> DataFrame:
    step = cfg.tile - cfg.overlap
    total = len(range(0, max(scene.height - cfg.overlap, 1), step)) * len(range(0, max(scene.width - cfg.overlap, 1), step))
    return tiles.sample_tiles(tiled, cfg.norm_tiles, total)
