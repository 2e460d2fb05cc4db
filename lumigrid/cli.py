"""Command line: detect, grow and info, for spark-submit or python -m lumigrid.cli."""

from __future__ import annotations

import argparse
import os

from lumigrid import __version__
from lumigrid.operators.modes import MODES, SPACES


def _names(text: str | None):
    return [x.strip().lower() or None for x in text.split(",")] if text else None


def _numbers(text: str | None):
    return tuple(float(x) for x in text.split(",")) if text else None


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("lumigrid").getOrCreate()


def _open(spark, path: str):
    from lumigrid.sources.raster import geotiff_scene, read_scene

    return geotiff_scene(spark, path) if path.lower().endswith((".tif", ".tiff")) else read_scene(spark, path)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lumigrid", description="Point objects and regions from raster scenes.")
    top.add_argument("--version", action="version", version=__version__)
    commands = top.add_subparsers(dest="command", required=True)
    d = commands.add_parser("detect", help="one point per object")
    g = commands.add_parser("grow", help="grow points into regions")
    commands.add_parser("info", help="modes, recipes and models")
    for p in (d, g):
        p.add_argument("raster")
    g.add_argument("points", help="point table; path|layername=x names a layer")
    for p in (d, g):
        p.add_argument("-o", "--output", required=True)
        p.add_argument("--mode", choices=sorted(MODES))
        p.add_argument("--bands", type=_names, help="role of every band in order")
        p.add_argument("--quiet", action="store_true")
    for flag, kind in (("--threshold", float), ("--object-threshold", float), ("--adaptel-threshold", float)):
        d.add_argument(flag, type=kind)
    for flag in ("--stands", "--stand-layer", "--chm", "--dtm", "--dsm", "--prob-raster", "--model"):
        d.add_argument(flag)
    for flag, value in (("--stand-age", 10.0), ("--stand-buffer", -2.0), ("--min-height", 3.0), ("--height-radius", 3.0), ("--suppress", 3.0), ("--min-area", 0.0)):
        d.add_argument(flag, type=float, default=value)
    for flag, value in (("--edge-px", 8), ("--tile", 2400), ("--overlap", 200), ("--norm-tiles", 16)):
        d.add_argument(flag, type=int, default=value)
    for flag in ("--keep-outside", "--keep-low", "--no-object-stage"):
        d.add_argument(flag, action="store_true")
    d.add_argument("--scene-norm", choices=("auto", "off"), default="auto")
    d.add_argument("--radiometry", choices=("off", "auto", "match"), default="off")
    g.add_argument("--labels")
    g.add_argument("--points-crs", default="", help="coordinate system of the points, such as EPSG:2180; else the scene's")
    for flag in ("--max-cost", "--max-radius", "--taper"):
        g.add_argument(flag, type=float)
    g.add_argument("--band-weights", type=_numbers)
    g.add_argument("--no-fill-holes", action="store_true")
    g.add_argument("--space", choices=("auto", *sorted(SPACES["reach"])), default="auto")
    g.add_argument("--rule", choices=("auto", *sorted(SPACES)), default="auto")
    g.add_argument("--tile", type=int, default=2048)
    g.add_argument("--workers", type=int, default=1, help="accepted for compatibility; the cluster decides")
    return top


def run_detect(a) -> int:
    from pyspark.sql import functions as F

    from lumigrid.operators.forest import load_forest_table
    from lumigrid.plans.detect import detect
    from lumigrid.sources.raster import ModelStore, read_table

    spark, store = _session(), ModelStore()
    scene, pixels = _open(spark, a.raster)
    manifest = store.manifest()

    def choose(mode: str) -> tuple:
        """Forests of the band mode that the scene turned out to have."""
        if a.model:
            return load_forest_table(spark, a.model), None, None
        second = f"objects_{mode}"
        return store.load(mode), store.load(second) if not a.no_object_stage and manifest.entry(second) else None, mode

    def raster(path: str) -> tuple:
        header, px = _open(spark, path)
        band = F.col(header.bands[0])
        return header, px.select("r", "c", (band if header.nodata is None else F.when(band != header.nodata, band)).alias("h"))

    stands = read_table(spark, f"{a.stands}|layername={a.stand_layer}" if a.stand_layer else a.stands) if a.stands else None
    paths = [a.chm] if a.chm else [a.dsm, a.dtm] if a.dsm and a.dtm else []
    n = detect(
        spark, scene, pixels, choose, a.output, None, stands, tuple(map(raster, paths)), prob_raster=a.prob_raster,
        mode=a.mode, bands=a.bands, threshold=a.threshold, stand_age=a.stand_age, stand_buffer=a.stand_buffer, keep_outside=a.keep_outside, min_height=a.min_height, height_radius=a.height_radius,
        keep_low=a.keep_low, suppress_m=a.suppress, min_area=a.min_area, object_threshold=a.object_threshold, edge_px=a.edge_px, tile=a.tile, overlap=a.overlap, granularity=a.adaptel_threshold,
        scene_norm=a.scene_norm, norm_tiles=a.norm_tiles, radiometry=a.radiometry, manifest=manifest, model_name=os.path.basename(a.model.rstrip("/")) if a.model else "custom",
    )
    if not a.quiet:
        print(f"{n} points in {a.output}")
    return 0


def run_grow(a) -> int:
    from lumigrid.plans.grow import grow_crowns
    from lumigrid.sources.raster import read_table

    spark = _session()
    scene, pixels = _open(spark, a.raster)
    n = grow_crowns(spark, scene, pixels, read_table(spark, a.points), a.output, a.labels, a.mode, a.bands, a.space, a.rule, a.tile, points_crs=a.points_crs, max_cost=a.max_cost, band_weights=a.band_weights, max_radius=a.max_radius, taper=a.taper, fill_holes=False if a.no_fill_holes else None)
    if not a.quiet:
        print(f"{n} regions in {a.output}")
    return 0


def run_info(a) -> int:
    from lumigrid.sources.raster import ModelStore

    for m in MODES.values():
        print(f"{m.name}: {', '.join(m.roles)}; granularity {m.granularity:g}; indices {', '.join(m.indices)}")
    store = ModelStore()
    print(f"models: {store.folder}" + ("" if os.path.isdir(store.folder) else " (absent)"))
    for key, entry in (store.manifest().content.get("files") or {}).items():
        print(f"  {key}: {entry.get('path')} {entry.get('kind', '')}")
    return 0


def main(argv=None) -> int:
    a = parser().parse_args(argv)
    return {"detect": run_detect, "grow": run_grow, "info": run_info}[a.command](a)


if __name__ == "__main__":
    raise SystemExit(main())
