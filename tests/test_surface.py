"""The command line, streams, models and coordinate systems."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigrid import cli
from lumigrid.functions.crs import system, transform
from lumigrid.operators import forest, spatial, tiles, zonal
from lumigrid.operators.modes import MODES, Manifest, auto_mode
from lumigrid.plans.detect import DetectConfig, detect
from lumigrid.plans.grow import grow_crowns
from lumigrid.plans.watch import Stopped, watched
from lumigrid.sources.raster import ModelStore, Scene, scene_from_array, training_table, with_roles, write_crowns, write_scene
from lumigrid.streaming.tiles import detect_stream, read_tiles, tile_pixels, whole_tiles

LEAF = {"tree": 0, "feature": None, "threshold": None, "left": None, "right": None}
ROOT = {"tree": 0, "node": 0, "feature": "sr_NDVI", "threshold": 0.2, "left": 1, "right": 2, "p": None}
STUMP = [ROOT, LEAF | {"node": 1, "p": 0.9}, LEAF | {"node": 2, "p": 0.1}]
SPOTS = ((22, 27), (70, 64))


def two_spots(n=96):
    """A green scene (red, green, blue, near infrared) with two grey discs."""
    rng = np.random.default_rng(17)
    a = np.stack([rng.normal(m, 2, (n, n)) for m in (45, 85, 40, 175)])
    r, c = np.mgrid[0:n, 0:n]
    for y, x in SPOTS:
        a[:, (r - y) ** 2 + (c - x) ** 2 <= 30] = np.array([150, 140, 135, 125])[:, None]
    return np.clip(a, 1, 255)


@pytest.fixture
def written(spark, tmp_path, monkeypatch):
    scene, px = scene_from_array(spark, two_spots(112), c=1000.0, f=2000.0)
    write_scene(scene, px, str(tmp_path / "scene"))
    monkeypatch.setenv("LUMIGRID_MODELS", str(tmp_path / "models"))
    monkeypatch.setattr(cli, "_session", lambda: spark)
    return tmp_path


def test_command_line(spark, written, capsys):
    """Detection by the stored model of the scene's mode, with the object forest and heights of
    another system, then growing."""
    store = ModelStore()
    store.save("segments_rgbn", STUMP)
    store.save("objects_rgbn", [LEAF | {"node": 0, "p": 0.75}])
    grid = Scene(40, 40, ("h",), 1.0, 1000.0, -1.0, 2000.0, nodata=None)
    heights = spark.range(1600).select(F.floor(F.col("id") / 40).cast("int").alias("r"), (F.col("id") % 40).cast("int").alias("c"), F.when(F.col("id") < 400, 9.0).otherwise(1.0).alias("h"))
    write_scene(grid, heights, str(written / "chm"))
    args = ["detect", str(written / "scene"), "-o", str(written / "out"), "--tile", "112", "--overlap", "16", "--min-area", "2", "--quiet"]
    assert cli.main([*args, "--chm", str(written / "chm"), "--object-threshold", "0.7"]) == 0
    tall = spark.read.parquet(str(written / "out" / "dead_trees")).collect()
    assert [(p.id, p.height_m, p.p_object, p.mode, p.model) for p in tall] == [(1, 9.0, 0.75, "rgbn", "rgbn")]
    assert cli.main([*args, "--no-object-stage", "--prob-raster", str(written / "prob")]) == 0
    points = spark.read.parquet(str(written / "out" / "dead_trees"))
    assert points.count() == 2 and points.where("p_object is null").count() == 2
    assert spark.read.parquet(str(written / "prob")).count() == 112 * 112
    assert cli.main(["grow", str(written / "scene"), f"{written / 'out'}|layername=dead_trees", "-o", str(written / "out")]) == 0
    assert "2 regions" in capsys.readouterr().out
    assert spark.read.parquet(str(written / "out" / "crowns")).count() == 2
    assert cli.main(["info"]) == 0
    shown = capsys.readouterr().out
    assert "rgbn: red, green, blue, nir" in shown and "objects_rgbn" in shown


def test_models_by_mode_and_manifest_names(tmp_path):
    store = ModelStore(str(tmp_path))
    store.save("segments_cir", STUMP, feature_transform={"type": "z", "columns": ["sr.L"]})
    store.save("objects_rgbn", STUMP)
    assert store.load("cir") == store.load("segments_cir") == store.load("objects") == STUMP
    assert store.manifest().transform("cir") == ("z", ["sr.L"])
    with pytest.raises(KeyError):
        store.load("rgb")


def test_stream_ids_run_on(spark, tmp_path):
    """Tiles as files, one a batch: the points of the whole scene with ids of their own."""
    scene, px = scene_from_array(spark, two_spots())
    mode = MODES["rgbn"]
    tiled = tiles.to_tiles(with_roles(px, scene, {b: k for k, b in enumerate(mode.roles)}), 96, 96, 48, 0)
    tiled = zonal.to_uint8(tiled, mode.roles)
    for t in range(4):
        tiled.where(F.col("tile_id") == t).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = read_tiles(spark, str(tmp_path / "in"), tiled.schema)
    cfg = DetectConfig(tile=48, overlap=0, box_px=11, min_area=2.0)
    detect_stream(stream, scene, mode, STUMP, 0.5, str(tmp_path / "out"), str(tmp_path / "state"), cfg).awaitTermination(300)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(p.id for p in got) == [1, 2] and len({p.tile for p in got}) == 2 and len({p.batch for p in got}) == 2
    for p in got:
        assert min(np.hypot(p.y / -0.25 - r - 0.5, p.x / 0.25 - c - 0.5) for r, c in SPOTS) < 3


def test_forest_learns_and_takes_missing_values_as_zero(spark, tmp_path):
    rng = np.random.default_rng(23)
    x = rng.normal(0, 1, (400, 2))
    rows = [(float(a), float(b) if k % 9 else float("nan"), bool(a > 0.3), k % 3) for k, (a, b) in enumerate(x)]
    spark.createDataFrame(rows, "`sr.L` double, noise double, y boolean, site int").write.parquet(str(tmp_path / "train"))
    train = training_table(spark, str(tmp_path / "train"), ["`sr.L`", "noise"])
    assert dict(train.dtypes)["site"] == "tinyint" and train.columns == ["sr.L", "noise", "y", "site"]
    plain = train.withColumnsRenamed({"sr.L": "sr_L"})
    scored = forest.score(plain, forest.train_forest(plain, ["sr_L", "noise"], trees=20, depth=4), ["sr_L", "noise"]).collect()
    assert np.mean([(r.p >= 0.5) == r.y for r in scored]) > 0.95 and any(np.isnan(r.noise) for r in scored)


def test_automatic_mode(spark):
    scene, px = scene_from_array(spark, np.stack([np.full((40, 40), v) for v in (90.0, 30.0, 60.0)]))
    assert auto_mode(px, scene.bands, 40, 40, least=1)[:2] == ("cir", ("nir", "red", "green"))
    assert auto_mode(px, scene.bands, 40, 40)[2] == "as given" or auto_mode(px, scene.bands, 40, 40, least=10**6)[0] is None
    assert auto_mode(px, scene.bands, 40, 40, "rgb")[0] == "rgb"
    assert auto_mode(px, scene.bands[:2], 40, 40)[:2] == (None, None)


def test_regions_are_written_in_order(spark, tmp_path):
    rows = [(3, 1.0, 2.0, 1, "c"), (1, 1.0, 2.0, 1, "a"), (2, 1.0, 2.0, 1, "b")]
    frame = spark.createDataFrame(rows, "adaptel_id long, area_m2 double, perimeter double, n_parts int, wkt string")
    assert write_crowns(frame, str(tmp_path)) == 3
    assert [r.adaptel_id for r in spark.read.parquet(str(tmp_path / "crowns")).collect()] == [1, 2, 3]


def located(spark, code, points):
    frame = spark.createDataFrame([(float(a), float(b)) for a, b in points], "lon double, lat double")
    e, n = transform(F.col("lon"), F.col("lat"), "EPSG:4326", code)
    back = transform(F.col("e"), F.col("n"), code, "EPSG:4326")
    return frame.select("lon", "lat", e.alias("e"), n.alias("n")).select("*", *(v.alias(k) for v, k in zip(back, ("lon2", "lat2"), strict=True))).collect()


@pytest.mark.parametrize("code", ["EPSG:32633", "EPSG:32733", "EPSG:25833", "EPSG:2180", "EPSG:2177", "EPSG:3857"])
def test_systems_turn_back(spark, code):
    for r in located(spark, code, [(15.2, 49.1), (18.9, 54.7), (13.0, -33.0), (17.5, 0.0)]):
        assert (r.lon2, r.lat2) == pytest.approx((r.lon, r.lat), abs=1e-9)


def test_systems_on_their_axes(spark):
    """On the central meridian the northing is the scaled length of the meridian arc, here summed."""
    a, f = 6378137.0, 1 / 298.257223563
    e2, phi = f * (2 - f), np.radians(np.linspace(0, 52, 200_001))
    arc = np.trapezoid(a * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5, phi)
    (north,) = located(spark, "EPSG:32633", [(15, 52)])
    assert (north.e, north.n) == pytest.approx((500000, 0.9996 * arc), abs=1e-3)
    (south,) = located(spark, "EPSG:32733", [(15, -52)])
    assert south.n == pytest.approx(1e7 - 0.9996 * arc, abs=1e-3)
    (polish,) = located(spark, "EPSG:2180", [(19, 52)])
    assert (polish.e, polish.n) == pytest.approx((500000, 0.9993 * arc - 5300000), abs=1e-2)
    (web,) = located(spark, "EPSG:3857", [(180, 0)])
    assert (web.e, web.n) == pytest.approx((np.pi * a, 0), abs=1e-6)
    with pytest.raises(ValueError):
        system("EPSG:27700")


def test_heights_and_points_in_other_systems(spark):
    """A point in zone 33 meets the height cell of its place in the Polish system."""
    (at,) = located(spark, "EPSG:2180", [(16.5, 51.5)])
    (utm,) = located(spark, "EPSG:32633", [(16.5, 51.5)])
    grid = Scene(10, 10, ("h",), 1.0, float(np.floor(at.e)) - 4, -1.0, float(np.ceil(at.n)) + 4, crs="EPSG:2180")
    cells = spark.createDataFrame([(r, c, 10.0 * r + c) for r in range(10) for c in range(10)], "r int, c int, h double")
    pts = spark.createDataFrame([(1, utm.e, utm.n), (2, utm.e + 1000, utm.n)], "id int, x double, y double")
    got = {r.id: r.height_m for r in spatial.heights_at(pts, (grid, cells), 0.0, "height_m", crs="EPSG:32633").collect()}
    assert got == {1: 44.0, 2: None}
    scene, px = scene_from_array(spark, two_spots(), c=utm.e - 27.5 * 0.25, f=utm.n + 22.5 * 0.25, crs="EPSG:32633")
    seeds = spark.createDataFrame([(7, 16.5, 51.5)], "id int, x double, y double")
    (crown,) = grow_crowns(spark, scene, px, seeds, points_crs="EPSG:4326").collect()
    assert crown.adaptel_id == 7 and 2 < crown.area_m2 < 20


def test_object_stage_needs_finite_features_and_a_score(spark):
    scene, px = scene_from_array(spark, two_spots())
    opts = {"tile": 96, "overlap": 16, "box_px": 21, "min_valid_px": 100, "min_area": 2.0, "manifest": Manifest(json.loads("{}"))}
    by_area = [ROOT | {"feature": "pow", "threshold": 1e6}, LEAF | {"node": 1, "p": 0.4}, LEAF | {"node": 2, "p": 0.9}]
    assert detect(spark, scene, px, STUMP, object_model=by_area, object_threshold=0.5, **opts).count() == 0
    assert {p.p_object for p in detect(spark, scene, px, STUMP, object_model=by_area, object_threshold=0.4, **opts).collect()} == {0.4}


def test_tiles_in_pieces(spark, tmp_path):
    """A tile over three files of two runs, one that repeats a piece, one that never gets whole, and a
    piece that comes late."""
    scene, cfg = Scene(20, 50, ("b",)), DetectConfig(tile=20, overlap=0)
    assert [tile_pixels(k, scene, cfg) for k in range(3)] == [400, 400, 200]
    schema = "tile_id int, tr int, tc int, b double"
    cells = lambda t, rows, value=1.0: [(t, r, c, value) for r in rows for c in range(20 if t < 2 else 10)]
    files = iter(range(100))

    def add(rows):
        n = next(files)
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n:03d}"))

    def run(patience=3_600_000):
        # a timeout asks for batches without data for ever, and a run over what is there would not end
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        whole_tiles(stream, scene, cfg, patience).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
        got = spark.read.schema(schema).parquet(str(tmp_path / "out"))
        return {r.tile_id: (r.n, r.s) for r in got.groupBy("tile_id").agg(F.count("*").alias("n"), F.sum("b").alias("s")).collect()}

    add(cells(0, range(7)) + cells(1, range(20)))
    add(cells(0, range(5, 14)))
    assert run() == {1: (400, 400.0)}
    add(cells(0, range(14, 20)) + cells(2, range(3), 2.0))
    assert run() == {0: (400, 400.0), 1: (400, 400.0)}
    add(cells(0, range(2), 9.0) + cells(1, range(1), 9.0))
    add(cells(2, range(2, 5), 2.0))
    assert run(patience=1) == {0: (400, 400.0), 1: (400, 400.0)}
    time.sleep(1)
    add(cells(1, range(1), 9.0))
    add(cells(1, range(1), 9.0))
    assert run(patience=1) == {0: (400, 400.0), 1: (400, 400.0), 2: (50, 100.0)}
    add(cells(2, range(5, 20), 9.0))
    assert run() == {0: (400, 400.0), 1: (400, 400.0), 2: (50, 100.0)}


def test_a_running_job_is_stopped(spark):
    """The callback sees tasks of the running stage; its False ends them within seconds."""
    seen = []

    def progress(text):
        seen.append(text)
        return "of" not in text

    def slow(batches):
        for b in batches:
            time.sleep(9)
            yield b

    began = time.time()
    with pytest.raises(Stopped), watched(spark, progress, every=0.2) as tell:
        tell("tiles")
        spark.range(0, 8, 1, 4).mapInArrow(slow, "id long").count()
    assert time.time() - began < 8 and seen[0] == "tiles" and seen[-1] == "tiles: 0 of 4 tasks"
    with watched(spark, lambda text: True) as tell:
        tell("again")
        assert spark.range(10).count() == 10
