import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigrid.operators import graph, normalise, objects, spatial, tiles, zonal
from lumigrid.operators.objects import describe_objects
from lumigrid.plans import catalog
from lumigrid.plans.detect import DetectConfig, detect
from lumigrid.plans.grow import grow_crowns
from lumigrid.sources.raster import ModelStore, Scene, read_scene, scene_from_array, split_layer, write_scene

SF = "/root/testdata/sf0.001"
FAST = ["valid_mask", "tile_grid", "tile_core_cover", "core_bands_halo", "rgb_to_lab", "to_uint8_scale", "radiometry_fit", "zonal_stats", "box_mean", "edges_distinct", "components", "stands_inside", "height_gate", "nodata_distance", "resample_scene", "running_ids", "suppress_points", "core_ownership", "seed_windows", "auto_mode", "lab_raster", "growing_spaces_rgb", "crs_round_trip", "detect_tiled", "scene_zscore", "region_outlines"]


@pytest.mark.parametrize("name", FAST)
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "customer", "part", "nation", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.queries()[name](spark, SF)
    rel = con.sql(catalog.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    mine = sorted(repr(tuple(r)) for r in df.select(*cols).collect())
    theirs = sorted(repr(tuple(r[rel.columns.index(c)] for c in cols)) for r in rel.fetchall())
    assert mine == theirs


def test_points_of_large_tables_turn_back(spark, tmp_path):
    """Keys whose northing lies near half a millimetre, and keys beyond those whose row would pass the pole."""
    rows = [(k, 0.0) for k in (0, 18132, 19029, 29919, 40248, 42499, 42500, 48950, 89999, 899999)]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    cols = ["id", "easting", "northing", "lon", "lat"]
    got = {tuple(r) for r in catalog.crs_round_trip(spark, str(tmp_path)).select(*cols).collect()}
    assert got == set(con.sql(f"SELECT {', '.join(cols)} FROM ({catalog.oracle_sql()['crs_round_trip']})").fetchall())
    assert len(got) == len(rows) and all(41 < r[4] < 84 for r in got)


def test_cores_cover_once(spark):
    for h, w, t, o in ((500, 370, 240, 20), (50, 30, 240, 20)):
        grid = tiles.tile_grid(spark, h, w, t, o).collect()
        seen = np.zeros((h, w), int)
        for g in grid:
            seen[g.cr0 : g.cr1, g.cc0 : g.cc1] += 1
        assert (seen == 1).all()


def test_objects_and_ring(spark):
    """A chain of three with a stray link, and rings counted by edges."""
    links = spark.createDataFrame([(7, 10, 12), (7, 12, 19), (7, 14, 30), (7, 11, 30)], "tile_id int, a int, b int")
    pred = spark.createDataFrame([(7, k) for k in (10, 11, 12, 14, 19)], "tile_id int, seg int")
    assert {r.seg: r.obj for r in graph.build_objects(pred, links).collect()} == {10: 10, 12: 10, 19: 10, 11: 11, 14: 14}
    rows = [(7, 10, 0.3, 41.0, 1.3, 4.0, 6.0, 2.0, 0.75), (7, 12, 0.5, 47.0, 2.1, 6.0, 8.0, 2.0, 0.5), (7, 30, 0.6, 33.0, 1.0, 5.0, 7.0, 5.0, 0.0), (7, 31, 0.9, 25.0, 1.4, 10.0, 9.0, 1.0, 0.25)]
    seg = spark.createDataFrame(rows, "tile_id int, seg int, sr_NDVI double, sr_L double, wydluzenie double, area double, x double, y double, p double")
    links = spark.createDataFrame([(7, 10, 12), (7, 10, 30), (7, 12, 30), (7, 12, 31)], "tile_id int, a int, b int")
    members = graph.build_objects(seg.where("p >= 0.5").select("tile_id", "seg"), links)
    o = describe_objects(members, seg, links, ["sr_NDVI", "sr_L"]).first()
    # segment 30 touches both members and counts twice: (5 * 0.6 * 2 + 10 * 0.9) / 20
    assert (o.nseg, o.ring_n, o.pow, o.s_max, o.s_min) == (2, 3, 10.0, 0.75, 0.5)
    assert [o.s_mean, o.ring_ndvi, o.ring_L, o.cx, o.obj_sr_NDVI] == pytest.approx([0.6, 0.75, 29.0, 7.2, 0.42])


def slow_suppression(rows, radius):
    kept = []
    for i, x, y, _ in sorted(rows, key=lambda r: (-r[3], r[0])):
        if all((x - u) ** 2 + (y - v) ** 2 > radius * radius for _, u, v in kept):
            kept.append((i, x, y))
    return sorted(k[0] for k in kept)


@pytest.mark.parametrize("block", [1.5, 4.0, 512.0])
def test_suppression_equals_a_slow_version(spark, block):
    rng = np.random.default_rng(17)
    rows = [(int(i), float(x), float(y), float(s)) for i, x, y, s in zip(rng.permutation(400), rng.integers(0, 60, 400) / 2, rng.integers(0, 60, 400) / 2, rng.integers(0, 9, 400), strict=True)]
    pts = spark.createDataFrame(rows, "id int, x double, y double, score double")
    assert sorted(x.id for x in graph.suppress(pts, 2.0, block=block).where("keep").collect()) == slow_suppression(rows, 2.0)
    assert graph.suppress(pts, 0.0).where("not keep").count() == 0 and graph.suppress(pts.limit(0), 2.0).count() == 0


def test_suppression_of_dense_points_in_bounded_blocks(spark, monkeypatch):
    """A task keeps a block's points and not its pairs; dense blocks are halved with the same result."""
    pairs = 400_000
    better = np.random.default_rng(5).integers(0, 1000, pairs)
    block = graph.pa.RecordBatch.from_pydict({"bx": np.zeros(pairs, np.int64), "by": np.zeros(pairs, np.int64), "i": np.repeat(np.arange(1000, 2000), 400), "j": better, "inside": np.ones(pairs, bool)})
    tracemalloc.start()
    (out,) = graph._greedy(block.slice(k, 2000) for k in range(0, pairs, 2000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == 2000 and sum(out["keep"].to_pylist()) == 1000 and peak < 4_000_000
    rng = np.random.default_rng(23)
    rows = [(k, float(x), float(y), float(s)) for k, (x, y, s) in enumerate(zip(rng.random(500) * 40, rng.random(500) * 40, rng.integers(0, 9, 500), strict=True))]
    monkeypatch.setattr(graph, "BLOCK_PAIRS", 200)
    pts = spark.createDataFrame(rows, "id int, x double, y double, score double")
    assert sorted(r.id for r in graph.suppress(pts, 2.0).where("keep").collect()) == slow_suppression(rows, 2.0)


def test_suppression_of_a_long_falling_line(spark):
    rows = [(k, 3.0 * k, 0.0, -float(k)) for k in range(5000)]
    pts = spark.createDataFrame(rows, "id int, x double, y double, score double")
    assert {r.id for r in graph.suppress(pts, 3.0).where("keep").select("id").collect()} == set(range(0, 5000, 2))


def test_components_are_stitched_over_tiles(spark):
    """Links of a scene in 12 tiles equal those without tiles, in chains that run through many."""
    rng = np.random.default_rng(23)
    tile = {v: int(v // 40) for v in range(480)}
    links = {(int(a), int(a) + int(d)) for a, d in zip(rng.integers(0, 470, 330), rng.integers(1, 9, 330), strict=True)} | {(k, k + 40) for k in range(3, 440, 40)}
    links = [(tile[a], a, tile[b], b) for a, b in links if b < 480]
    root = list(range(480))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for _, a, _, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.v: r.low for r in graph.stitched_components(spark.createDataFrame(links, "ta int, a bigint, tb int, b bigint")).collect()}
    assert got == {v: find(v) for _, a, _, b in links for v in (a, b)} and len(set(got.values())) > 5


def test_box_means_in_blocks(spark):
    """Blocks with margins give what the whole window does, with missing pixels and every edge."""
    rng = np.random.default_rng(31)
    h, w, size = 37, 53, 9
    v, ok = rng.normal(0, 5, (h, w)), rng.random((h, w)) < 0.8
    rr, cc = np.mgrid[:h, :w]
    px = spark.createDataFrame([(3, int(r), int(c), float(v[r, c]), bool(ok[r, c]), "x") for r, c in zip(rr.ravel(), cc.ravel(), strict=True)], "tile_id int, tr int, tc int, v double, valid boolean, other string")
    got = {(r.tr, r.tc): (r.lm_v, r.other) for r in zonal.box_mean(px, ["v"], size, block=10).collect()}
    pad = lambda a: np.pad(a, size // 2, mode="edge")
    view = lambda a: np.lib.stride_tricks.sliding_window_view(pad(a), (size, size)).mean(axis=(2, 3))
    want = view(np.where(ok, v, 0)) / np.maximum(view(ok.astype(float)), 1e-6)
    assert len(got) == h * w and all(o == "x" for _, o in got.values())
    assert np.allclose([got[r, c][0] for r in range(h) for c in range(w)], want.ravel())


@pytest.mark.parametrize("share", [0.0, 0.001, 0.5, 0.98])
def test_distance_to_missing_data(spark, share):
    """Against all pairs: scenes with nothing, little, half and nearly all missing; half is one side."""
    rng = np.random.default_rng(41)
    h, w = 83, 121
    gone = rng.random((h, w)) < share if share != 0.5 else np.broadcast_to(np.arange(w) >= 60, (h, w))
    seeds = [(k, int(r), int(c)) for k, (r, c) in enumerate(zip(rng.integers(0, h, 60), rng.integers(0, w, 60), strict=True))]
    missing = spark.createDataFrame([(int(r), int(c)) for r, c in np.argwhere(gone)], "r int, c int")
    got = {r.id: r.edge_px for r in spatial.nodata_distance(spark.createDataFrame(seeds, "id int, r int, c int"), missing, h, w, band=16, strip=32).collect()}
    at = np.argwhere(gone)
    for k, r, c in seeds:
        edge = min(r + 1, h - r, c + 1, w - c)
        near = np.sqrt(((at - (r, c)) ** 2).sum(axis=1)).min() if len(at) else np.inf
        assert got[k] == pytest.approx(min(edge, near))


def test_exact_quantiles(spark):
    rng = np.random.default_rng(6)
    a = np.concatenate([rng.normal(0, 1e-3, 500), rng.normal(0, 1e9, 500), [0.0, -0.0, 5e-324, -1e308, 1e308]])
    b = rng.integers(0, 4, len(a)).astype(float)
    rows = [(float(x), float(y), None) for x, y in zip(a, b, strict=True)] + [(float("nan"), None, None), (float("inf"), 2.0, None)]
    shares = (0.0, 0.02, 0.5, 0.777, 0.98, 1.0)
    got = normalise.exact_quantiles(spark.createDataFrame(rows, "a double, `b.c` double, empty double"), ["a", "b.c", "empty"], shares)
    assert set(got) == {"a", "b.c"} and got["a"][0] == len(a) and got["b.c"][0] == len(b) + 1
    assert np.allclose(got["a"][1], np.quantile(a, shares), rtol=1e-12) and np.allclose(got["b.c"][1], np.quantile(np.append(b, 2.0), shares))


def test_stands(spark):
    sq = lambda x, age: ([(x, 0.0), (x + 10, 0.0), (x + 10, 10.0), (x, 10.0)], age)
    st = spark.createDataFrame([sq(0.0, 20.0), sq(10.0, 20.0), sq(40.0, 5.0), sq(60.0, None)], "ring array<struct<x:double,y:double>>, age double")
    pts = spark.createDataFrame([(0, 10.0, 5.0), (1, 1.0, 5.0), (2, 45.0, 5.0), (3, 65.0, 5.0), (4, -1.0, 5.0)], "id int, x double, y double")
    inside = lambda b: {r.id for r in spatial.inside_stands(pts, spatial.usable_stands(st, 10), b).where("in_stands = 1").collect()}
    assert inside(-2.0) == {0} and inside(0.5) == {0, 1} and inside(2.0) == {0, 1, 4}
    with pytest.raises(ValueError):
        spatial.usable_stands(st, 99)


def test_radiometry_and_norm(spark):
    """Green too dark-shifted, near infrared too narrow, red as it should be."""
    px = spark.range(24000).select((F.col("id") % 51 + 29.5).alias("red"), (F.col("id") % 49 + 75.0).alias("green"), (F.col("id") % 31 + 61.0).alias("nir"))
    found = normalise.measure_bands(px, ["red", "green", "nir"]).collect()
    assert {r.role: (r.dark, r.flat) for r in found} == {"red": (False, False), "green": (True, False), "nir": (False, True)}
    assert normalise.needs_match(found) and not normalise.needs_match(found[:1] if found[0].role == "red" else [r for r in found if r.role == "red"])
    assert not normalise.needs_match(found, "off") and normalise.needs_match([], "match") and not normalise.needs_match([])
    low, high = normalise.match_bands(px, found).agg(*(F.percentile("nir", F.lit(q)) for q in (0.02, 0.98))).first()
    assert (low, high) == pytest.approx(normalise.REFERENCE["nir"])
    few = normalise.measure_bands(px.limit(999), ["red", "cloud"][:1]).collect()
    assert few[0].gain is None and normalise.match_bands(px, few).columns == px.columns
    with pytest.raises(ValueError):
        normalise.needs_match(found, "sometimes")
    rows = normalise.robust_statistics(spark.createDataFrame([(float(k), 1.0) for k in (4, 8, 15, 16, 23, 42)] + [(float("inf"), None)], "v double, flat double"), ["v", "flat"])
    assert {r["name"]: (r["med"], round(r["mad"], 4)) for r in rows} == {"v": (15.5, round(1.4826 * 7.5 + 1e-6, 4)), "flat": (1.0, 0.0)}
    assert set(normalise.robust_scores(rows, "both")) == {"z_v", "z_flat"} and set(normalise.robust_scores(rows, "zsr")) == {"v", "flat"}
    with pytest.raises(ValueError):
        normalise.robust_scores(rows, "none")
    with pytest.raises(RuntimeError):
        normalise.robust_statistics(spark.createDataFrame([], "v double"), ["v"])


def plot(seed=77, rows=110, cols=130, crowns=((22, 95, 7), (78, 31, 9))):
    """Green ground with discs without chlorophyll (row, column, radius), and a corner without data."""
    rng = np.random.default_rng(seed)
    a = np.stack([rng.normal(mean, 5, (rows, cols)) for mean in (52, 71, 44, 168)])
    rr, cc = np.mgrid[:rows, :cols]
    for r, c, radius in crowns:
        disc = np.hypot(rr - r, cc - c) <= radius
        a[:, disc] = np.array([172, 160, 151, 133])[:, None] + rng.normal(0, 3, (4, int(disc.sum())))
    a = np.clip(a, 1, 255)
    a[:, -12:, :9] = 0
    return a


def test_detect_and_grow(spark, tmp_path):
    crowns = ((22, 95), (78, 31))
    scene, px = scene_from_array(spark, plot(), c=730000.0, f=215000.0)
    write_scene(scene, px, str(tmp_path / "scene"))
    scene, px = read_scene(spark, str(tmp_path / "scene"))
    leaf = lambda node, p: {"tree": 0, "node": node, "feature": None, "p": p, "threshold": None, "left": None, "right": None}
    bare = [{"tree": 0, "node": 0, "feature": "sr_NDVI", "threshold": 0.15, "left": 1, "right": 2, "p": None}, leaf(1, 0.85), leaf(2, 0.05)]
    opts = {"tile": 130, "overlap": 30, "min_valid_px": 80, "box_px": 15, "min_area": 2.5}
    assert detect(spark, scene, px, bare, str(tmp_path / "out"), prob_raster=str(tmp_path / "prob"), model_name="mine.json", radiometry="auto", **opts) == 2
    pts = spark.read.parquet(str(tmp_path / "out" / "dead_trees"))
    want = [(730000 + (c + 0.5) * 0.25, 215000 - (r + 0.5) * 0.25) for r, c in crowns]
    for p in pts.collect():
        assert min(np.hypot(p.x - x, p.y - y) for x, y in want) < 1 and p.p == 0.85 and p.edge_px > 8 and p.model == "mine.json"
    prob = spark.read.parquet(str(tmp_path / "prob"))
    assert prob.count() == 110 * 130 and prob.where("p = -1").count() == 12 * 9
    assert detect(spark, scene, px, [leaf(0, 0.0)], **opts).count() == 0
    with pytest.raises(RuntimeError):
        detect(spark, scene, px, bare, progress=lambda s: False, **opts)
    whole = grow_crowns(spark, scene, px, pts).collect()
    assert len(whole) == 2 and all(4 < c.area_m2 < 60 and c.n_parts == 1 and c.wkt.startswith("MULTIPOLYGON (((") for c in whole)
    assert all(round(v, 2) == v for c in whole for v in (c.area_m2, c.perimeter))
    tiled = grow_crowns(spark, scene, px, pts, tile=64, labels_out=str(tmp_path / "labels")).collect()
    assert sorted(c.area_m2 for c in tiled) == pytest.approx(sorted(c.area_m2 for c in whole))
    assert spark.read.parquet(str(tmp_path / "labels")).count() == 110 * 130
    assert grow_crowns(spark, scene, px, pts.limit(0)).count() == 0


def test_heights_lie_on_their_own_grid(spark):
    """A surface of 1 m cells over points of a 0.25 m scene, and a coarser terrain under it."""
    pts = spark.createDataFrame([(0, 3.1, -2.6), (1, 9.9, -0.1), (2, 50.0, 50.0)], "id int, x double, y double")
    grid = Scene(12, 12, ("h",), 1.0, 0.0, -1.0, 0.0)
    rows = [(r, c, float(10 * r + c) if (r, c) != (3, 4) else None) for r in range(12) for c in range(12)]
    surface = spark.createDataFrame(rows, "r int, c int, h double")
    got = {r.id: r.height_m for r in spatial.heights_at(pts, (grid, surface), 1.0, "height_m").collect()}
    assert got == {0: 33.0, 1: 20.0, 2: None}


def test_ids_run_over_groups(spark):
    rng = np.random.default_rng(4)
    rows = [(int(g), int(v)) for g, v in zip(rng.integers(0, 9, 300), rng.permutation(300), strict=True)]
    out = objects.running_ids(spark.createDataFrame(rows, "g int, v int"), "g", ["v"]).collect()
    assert [(r.g, r.v) for r in sorted(out, key=lambda r: r.id)] == sorted(rows) and sorted(r.id for r in out) == list(range(1, 301))


def test_components_in_tiles_and_over_the_scene(spark):
    rng = np.random.default_rng(9)
    links = sorted({(int(t), int(min(a, b)), int(max(a, b))) for t, a, b in zip(rng.integers(0, 3, 150), rng.integers(0, 90, 150), rng.integers(0, 90, 150), strict=True) if a != b})
    seen = [(t, s) for t in range(3) for s in range(0, 90, 1) if (t + s) % 7]
    root = {k: k for k in seen}

    def find(k):
        return k if root[k] == k else find(root[k])

    for t, a, b in links:
        if (t, a) in root and (t, b) in root:
            x, y = sorted((find((t, a)), find((t, b))))
            root[y] = x
    df, edges = spark.createDataFrame(seen, "tile_id int, seg int"), spark.createDataFrame(links, "tile_id int, a int, b int")
    got = {(r.tile_id, r.seg): r.obj for r in graph.build_objects(df, edges).collect()}
    assert got == {k: find(k)[1] for k in seen}
    one = {r.seg: r.obj for r in graph.build_objects(df.where("tile_id = 1").drop("tile_id"), edges.where("tile_id = 1").drop("tile_id"), ()).collect()}
    assert one == {s: o for (t, s), o in got.items() if t == 1}


def test_model_follows_the_mode_of_the_scene(spark):
    """Near infrared, red and green without a mode: the forest is asked for once that is known."""
    n = 70
    rng = np.random.default_rng(8)
    array = np.stack([rng.normal(m, 4, (n, n)) for m in (160, 50, 80)])
    scene, px = scene_from_array(spark, np.clip(array, 1, 255))
    asked = []

    def choose(mode):
        asked.append(mode)
        return [{"tree": 0, "node": 0, "feature": None, "p": 0.0, "threshold": None, "left": None, "right": None}], None, None

    assert detect(spark, scene, px, choose, tile=70, overlap=10, min_valid_px=10, box_px=11).count() == 0 and asked == ["cir"]


def test_models_and_names(tmp_path):
    store = ModelStore(str(tmp_path))
    store.save("rgbn", [{"tree": 0, "node": 0, "feature": None, "p": 0.5}], rows=1)
    assert store.load("rgbn")[0]["p"] == 0.5
    (tmp_path / "rgbn.json").write_text("{}")
    with pytest.raises(OSError):
        store.load("rgbn")
    assert split_layer("a.gpkg|layername=tops") == ("a.gpkg", "tops")
    assert Scene(10, 10, ("b1",)).affine.pixel_area == pytest.approx(0.0625)
    assert DetectConfig().overlap == 200


def test_growing_takes_the_whole_scene(spark):
    """All seeds on valid pixels are grown, also below row 100, to the operator's own radius."""
    d = "/root/testdata/sf0.1"
    px, seeds, recipe = catalog._stack(spark, d)
    assert recipe.max_radius == 20
    wanted = {r.gid for r in seeds.join(px.where("valid"), ["r", "c"]).select("gid").collect()}
    assert {r.gid for r in catalog.grow_reach(spark, d).select("gid").distinct().collect()} == wanted
