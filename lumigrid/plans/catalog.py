"""Named queries over the driver's tables, each with SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumigrid.functions import color, crs, pixel
from lumigrid.operators import forest, graph, grow, modes, normalise, objects, outlines, segment, spatial, tiles, zonal
from lumigrid.operators.components import cut
from lumigrid.plans import detect, views
from lumigrid.plans.views import HT, PT, PX, SEG, ST

FLAGSHIP = "dead_trees"
TILE, OVERLAP, BOX, RADIUS, BLOCK = 60, 10, 11, 3.0, 128
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: A small forest over segment features: root and two second-level splits for each tree.
FOREST = [
    {"tree": t, "node": n, "feature": f, "threshold": v, "left": a, "right": b, "p": p}
    for t, rows in enumerate(
        (
            ((0, "sr_NDVI", 0.1, 1, 2, None), (1, "sr_L", 40.0, 3, 4, None), (2, "sd_NDVI", 0.2, 5, 6, None), (3, None, None, None, None, 0.9), (4, None, None, None, None, 0.6), (5, None, None, None, None, 0.4), (6, None, None, None, None, 0.2)),
            ((0, "sr_NDGR", 0.05, 1, 2, None), (1, "wydluzenie", 1.1, 3, 4, None), (2, "cos_Hab", 0.0, 5, 6, None), (3, None, None, None, None, 0.8), (4, None, None, None, None, 0.7), (5, None, None, None, None, 0.3), (6, None, None, None, None, 0.5)),
        )
    )
    for n, f, v, a, b, p in rows
]
FOREST_SQL = """(CASE WHEN sr_NDVI <= 0.1e0 THEN CASE WHEN sr_L <= 40e0 THEN 0.9e0 ELSE 0.6e0 END ELSE CASE WHEN sd_NDVI <= 0.2e0 THEN 0.4e0 ELSE 0.2e0 END END
 + CASE WHEN sr_NDGR <= 0.05e0 THEN CASE WHEN wydluzenie <= 1.1e0 THEN 0.8e0 ELSE 0.7e0 END ELSE CASE WHEN cos_Hab <= 0e0 THEN 0.3e0 ELSE 0.5e0 END END) / 2e0"""


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def _round(df: DataFrame, digits: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes))


# --- SQL pieces -------------------------------------------------------------------------------------

_IDX = "(nir - red) / greatest(nir + red, 1e-6) AS NDVI, (green - red) / greatest(green + red, 1e-6) AS NDGR, (blue - red) / greatest(blue + red, 1e-6) AS NDBR"


def _lin(b: str) -> str:
    v = f"(floor(least(greatest({b}, 0e0), 255e0)) / 255e0)"
    return f"CASE WHEN {v} <= 0.04045e0 THEN {v} / 12.92e0 ELSE pow(({v} + 0.055e0) / 1.055e0, 2.4e0) END"


LAB = f""",
lin AS (SELECT r, c, {_lin('red')} AS lr, {_lin('green')} AS lg, {_lin('blue')} AS lb FROM px WHERE valid),
xyz AS (SELECT r, c, {', '.join(f'({m[0]}e0 * lr + {m[1]}e0 * lg + {m[2]}e0 * lb) / {w}e0 AS {n}' for m, w, n in zip(color.XYZ, color.WHITE, 'xyz', strict=True))} FROM lin),
cur AS (SELECT r, c, {', '.join(f'CASE WHEN {n} > 216e0 / 24389e0 THEN pow({n}, 1e0 / 3e0) ELSE ({n} * (24389e0 / 27e0) + 16e0) / 116e0 END AS f{n}' for n in 'xyz')} FROM xyz),
lab AS (SELECT r, c, fy * 116e0 - 16e0 AS L, (fx - fy) * 500e0 AS a, (fy - fz) * 200e0 AS b FROM cur)"""
LCH = LAB + """,
lch AS (SELECT r, c, L, sqrt(a * a + b * b) AS CH, CASE WHEN atan2(b, a) < 0 THEN degrees(atan2(b, a)) + 360e0 ELSE degrees(atan2(b, a)) END AS Hab FROM lab)"""
BANDS_SQL = SEG + LCH + f""",
bd AS MATERIALIZED (SELECT p.r, p.c, p.seg, p.valid, {_IDX}, l.L, l.CH AS C_, l.Hab FROM seg p LEFT JOIN lch l ON p.r = l.r AND p.c = l.c)"""
# the box mean by brute force: every pixel meets its box, edges repeated
BOX_SQL = BANDS_SQL + f""",
dim AS (SELECT max(r) AS hr, max(c) AS hc FROM bd),
off AS (SELECT * FROM generate_series(-{BOX // 2}, {BOX // 2}) t(d)),
spots AS MATERIALIZED (SELECT p.r, p.c, least(greatest(p.r + a.d, 0), hr) AS qr, least(greatest(p.c + b.d, 0), hc) AS qc FROM bd p, dim, off a, off b),
nb AS (SELECT spots.r, spots.c, q.valid, q.NDVI, q.NDGR, q.NDBR, q.L, q.C_ FROM spots JOIN bd q ON q.r = spots.qr AND q.c = spots.qc),
lm AS MATERIALIZED (SELECT r, c, {', '.join(f"(sum(CASE WHEN valid THEN {b} ELSE 0e0 END) / {BOX * BOX}e0) / greatest(count(*) FILTER (valid) / {BOX * BOX}e0, 1e-6) AS lm_{b}" for b in ('NDVI', 'NDGR', 'NDBR', 'L', 'C_'))} FROM nb GROUP BY r, c)"""


def _zonal_sql(box: bool = True) -> str:
    cols = []
    for b, n in (("NDVI", "NDVI"), ("NDGR", "NDGR"), ("NDBR", "NDBR"), ("L", "L"), ("C_", "C")):
        cols += [f"avg({b}) AS sr_{n}", f"stddev_pop({b}) AS sd_{n}"] + ([f"avg({b}) - avg(lm_{b}) AS ktr_{n}"] if box else [])
    return f""",
z0 AS (SELECT seg, count(*) AS cnt, avg(p.r) AS mr, avg(p.c) AS mc, var_pop(p.r) AS rr, var_pop(p.c) AS cc, covar_pop(p.r, p.c) AS rc, avg(cos(radians(Hab))) AS cos_Hab, avg(sin(radians(Hab))) AS sin_Hab, {', '.join(cols)}
  FROM bd p {'JOIN lm ON p.r = lm.r AND p.c = lm.c' if box else ''} WHERE valid GROUP BY seg),
z AS MATERIALIZED (SELECT *, 1e0 - sqrt(cos_Hab * cos_Hab + sin_Hab * sin_Hab) AS war_Hab, cnt * 0.0625e0 AS pow_m2,
  sqrt(((rr + cc) / 2 + sqrt(greatest((rr + cc) / 2 * ((rr + cc) / 2) - (rr * cc - rc * rc), 0e0))) / greatest((rr + cc) / 2 - sqrt(greatest((rr + cc) / 2 * ((rr + cc) / 2) - (rr * cc - rc * rc), 0e0)), 1e-9)) AS wydluzenie FROM z0)"""


ZONAL = BOX_SQL + _zonal_sql()
ZONAL_NOBOX = BANDS_SQL + _zonal_sql(False)
EDGES = """,
ed AS MATERIALIZED (SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM (
  SELECT p.seg AS x, q.seg AS y FROM seg p JOIN seg q ON p.r = q.r AND q.c = p.c + 1 WHERE p.valid AND q.valid
  UNION ALL SELECT p.seg, q.seg FROM seg p JOIN seg q ON p.c = q.c AND q.r = p.r + 1 WHERE p.valid AND q.valid) WHERE x <> y)"""
SCORED = ZONAL + EDGES + f""",
sc AS MATERIALIZED (SELECT *, CASE WHEN cnt >= 4 THEN {FOREST_SQL} ELSE 0e0 END AS p, cnt * 0.0625e0 AS area, mc + 0.5e0 AS x, mr + 0.5e0 AS y FROM z),
pr AS (SELECT seg FROM sc WHERE cnt >= 4 AND p >= 0.6e0)"""
COMPONENTS = """,
rc(seg, obj) AS (SELECT seg, seg FROM pr UNION SELECT e.y, rc.obj FROM rc JOIN (SELECT a AS x, b AS y FROM ed UNION ALL SELECT b, a FROM ed) e ON e.x = rc.seg JOIN pr ON pr.seg = e.y),
mem AS (SELECT seg, min(obj) AS obj FROM rc GROUP BY seg)"""
_FEATURES = zonal.spark_names(modes.feature_names("rgbn"))
OBJECTS = COMPONENTS + f""",
m AS (SELECT mem.obj, sc.* FROM mem JOIN sc ON mem.seg = sc.seg),
ctr AS (SELECT obj, sum(area * x) / sum(area) AS cx, sum(area * y) / sum(area) AS cy FROM m GROUP BY obj),
mo AS (SELECT m.obj, any_value(cx) AS cx, any_value(cy) AS cy, sum(area) AS pow, count(*) AS nseg,
  sum(area * (x - cx) * (x - cx) + area * area / (4 * pi())) / sum(area) AS sxx, sum(area * (y - cy) * (y - cy) + area * area / (4 * pi())) / sum(area) AS syy, sum(area * (x - cx) * (y - cy)) / sum(area) AS sxy,
  sum(area * wydluzenie) / sum(area) AS elong_seg, max(p) AS s_max, sum(area * p) / sum(area) AS s_mean, min(p) AS s_min, {', '.join(f'sum(area * {f}) / sum(area) AS obj_{f}' for f in _FEATURES)}
  FROM m JOIN ctr ON m.obj = ctr.obj GROUP BY m.obj),
ring AS (SELECT mem.obj, count(*) AS ring_n, sum(s.area * s.sr_NDVI) / sum(s.area) AS ring_ndvi, sum(s.area * s.sr_L) / sum(s.area) AS ring_L
  FROM (SELECT a AS s, b AS t FROM ed UNION ALL SELECT b, a FROM ed) e JOIN mem ON mem.seg = e.s JOIN sc s ON s.seg = e.t WHERE e.t NOT IN (SELECT seg FROM mem) GROUP BY mem.obj),
ob AS MATERIALIZED (SELECT mo.*, sqrt(((sxx + syy) / 2 + sqrt(greatest((sxx + syy) * (sxx + syy) / 4 - (sxx * syy - sxy * sxy), 0e0))) / greatest((sxx + syy) / 2 - sqrt(greatest((sxx + syy) * (sxx + syy) / 4 - (sxx * syy - sxy * sxy), 0e0)), 1e-9)) AS elong,
  coalesce(ring_n, 0) AS ring_n, coalesce(ring_ndvi, 0e0) AS ring_ndvi, coalesce(ring_L, 0e0) AS ring_L FROM mo LEFT JOIN ring ON mo.obj = ring.obj)"""


def _suppressed(points: str, ident: str, score: str, radius: float) -> str:
    """Greedy suppression by rank with a recursive list of what is kept."""
    return f""",
rk AS (SELECT {ident} AS id, x, y, row_number() OVER (ORDER BY {score} DESC, {ident}) AS k FROM {points}),
sup(k, kept) AS (SELECT 0, CAST([] AS STRUCT(id BIGINT, x DOUBLE, y DOUBLE)[])
  UNION ALL SELECT rk.k, CASE WHEN len(list_filter(kept, lambda s: (s.x - rk.x) * (s.x - rk.x) + (s.y - rk.y) * (s.y - rk.y) <= {radius * radius}e0)) = 0 THEN list_append(kept, {{'id': CAST(rk.id AS BIGINT), 'x': rk.x, 'y': rk.y}}) ELSE kept END
  FROM sup JOIN rk ON rk.k = sup.k + 1),
kp AS (SELECT unnest(list_transform((SELECT kept FROM sup ORDER BY k DESC LIMIT 1), lambda s: s.id)) AS id)"""


#: Transverse Mercator of zone 32 by the conformal latitude in exponential form; the constants are
#: those of WGS84 (eccentricity, series to the fourth order in every term, scaled rectifying radius).
_UTM = """
geo AS (SELECT id, x * 0.1e0 + 6.53e0 AS lon, y % 850 * 0.05e0 + 41.07e0 AS lat FROM pt),
cf AS (SELECT id, lon, lat, radians(lon - 9e0) AS l, atanh(sin(radians(lat))) - 0.0818191908426215e0 * atanh(0.0818191908426215e0 * sin(radians(lat))) AS q FROM geo),
uv AS (SELECT id, lon, lat, atan2((exp(q) - exp(-q)) / 2, cos(l)) AS u, atanh(sin(l) / ((exp(q) + exp(-q)) / 2)) AS v FROM cf),
kr AS (SELECT j, k FROM (VALUES (1, 8.377318206303529e-4), (2, 7.608527714248998e-7), (3, 1.1976380015605232e-9), (4, 2.4433761945220637e-12)) t(j, k)),
utm AS (SELECT id, any_value(lon) AS lon, any_value(lat) AS lat, 6364902.166165087e0 AS rad, any_value(v) + sum(k * cos(2 * j * u) * (exp(2 * j * v) - exp(-2 * j * v)) / 2) AS e, any_value(u) + sum(k * sin(2 * j * u) * (exp(2 * j * v) + exp(-2 * j * v)) / 2) AS n FROM uv, kr GROUP BY id)"""


# --- sources, tiles, pixels -------------------------------------------------------------------------


@query(f"WITH {PX} SELECT r, c, red, nir FROM px WHERE r >= 10 AND r < 60 AND c >= 20 AND c < 100")
def scene_scan(spark, d):
    """Windowed scan of two bands."""
    from lumigrid.sources.raster import window

    return window(views.pixels(spark, d), 10, 60, 20, 100).select("r", "c", "red", "nir")


@query(f"WITH {PX} SELECT r, c, coalesce(red <> 0 AND green <> 0 AND blue <> 0 AND nir <> 0, false) AS valid FROM px")
def valid_mask(spark, d):
    """Validity over all bands with 0 as missing data."""
    px = views.pixels(spark, d)
    return px.select("r", "c", pixel.is_valid([F.col(b) for b in views.BANDS], 0.0).alias("valid"))


def _tiles_sql() -> str:
    step = TILE - OVERLAP
    return f"""
gr AS (SELECT (SELECT max(o_orderkey) // 150 + 1 FROM orders) AS hh, 150 AS ww),
rs AS (SELECT CAST(i * {step} AS INT) AS r0, i FROM gr, generate_series(0, greatest(hh - {OVERLAP}, 1) - 1) t(i) WHERE i * {step} < greatest(hh - {OVERLAP}, 1)),
cs AS (SELECT CAST(j * {step} AS INT) AS c0, j FROM gr, generate_series(0, greatest(ww - {OVERLAP}, 1) - 1) t(j) WHERE j * {step} < greatest(ww - {OVERLAP}, 1)),
tl AS (SELECT CAST(i * (SELECT count(*) FROM cs) + j AS INT) AS tile_id, r0, c0, CAST(least({TILE}, hh - r0) AS INT) AS h, CAST(least({TILE}, ww - c0) AS INT) AS w,
  CAST(CASE WHEN r0 = 0 THEN 0 ELSE r0 + {OVERLAP // 2} END AS INT) AS cr0, CAST(CASE WHEN r0 + least({TILE}, hh - r0) >= hh THEN hh ELSE r0 + least({TILE}, hh - r0) - {OVERLAP // 2} END AS INT) AS cr1,
  CAST(CASE WHEN c0 = 0 THEN 0 ELSE c0 + {OVERLAP // 2} END AS INT) AS cc0, CAST(CASE WHEN c0 + least({TILE}, ww - c0) >= ww THEN ww ELSE c0 + least({TILE}, ww - c0) - {OVERLAP // 2} END AS INT) AS cc1
  FROM rs, cs, gr)"""


@query(f"WITH {_tiles_sql()} SELECT * FROM tl")
def tile_grid(spark, d):
    return tiles.tile_grid(spark, views.height(spark, d), views.WIDTH, TILE, OVERLAP)


@query(f"WITH {PX}, {_tiles_sql()} SELECT tile_id, count(*) AS n_px, count(*) FILTER (r >= cr0 AND r < cr1 AND c >= cc0 AND c < cc1) AS n_core FROM px JOIN tl ON r >= r0 AND r < r0 + h AND c >= c0 AND c < c0 + w GROUP BY tile_id")
def tile_core_cover(spark, d):
    """Pixels of each tile's window and core; every pixel is in one core."""
    t = tiles.to_tiles(views.pixels(spark, d).drop("tile_id", "tr", "tc"), views.height(spark, d), views.WIDTH, TILE, OVERLAP)
    return t.groupBy("tile_id").agg(F.count("*").alias("n_px"), F.count_if("core").alias("n_core"))


@query(f"WITH {PX}, {_tiles_sql()}, n AS (SELECT tile_id, count(*) FILTER (valid) AS v FROM px JOIN tl ON r >= r0 AND r < r0 + h AND c >= c0 AND c < c0 + w GROUP BY tile_id) SELECT tile_id, v AS n_valid FROM n WHERE v >= 1200")
def tile_valid_counts(spark, d):
    """Tiles with enough valid pixels."""
    t = tiles.to_tiles(views.pixels(spark, d).drop("tile_id", "tr", "tc"), views.height(spark, d), views.WIDTH, TILE, OVERLAP)
    return tiles.drop_sparse_tiles(t, 1200).groupBy("tile_id").agg(F.count_if("valid").alias("n_valid"))


@query(f"WITH {_tiles_sql()}, k AS (SELECT greatest(1, count(*) // 3) AS s FROM tl) SELECT tile_id FROM tl, k WHERE tile_id % s = 0 AND tile_id // s < 3")
def tile_sample(spark, d):
    """Every k-th tile, three at most."""
    t = tiles.tile_grid(spark, views.height(spark, d), views.WIDTH, TILE, OVERLAP)
    return tiles.sample_tiles(t, 3, t.count()).select("tile_id")


@query(f"WITH {PX} SELECT CAST((r // 40) * 4 + c // 40 AS INT) AS core_id, count(*) AS n_core, (SELECT count(*) FROM px q WHERE q.r >= (any_value(p.r) // 40) * 40 - 8 AND q.r <= (any_value(p.r) // 40) * 40 + 39 + 8 AND q.c >= (any_value(p.c) // 40) * 40 - 8 AND q.c <= (any_value(p.c) // 40) * 40 + 39 + 8) AS n_window FROM px p GROUP BY r // 40, c // 40")
def core_bands_halo(spark, d):
    """Non-overlapping cores with halos."""
    h = tiles.to_halos(views.pixels(spark, d).select("r", "c"), 40, 40, views.height(spark, d), views.WIDTH, 8)
    return h.groupBy("core_id").agg(F.count_if("in_core").alias("n_core"), F.count("*").alias("n_window"))


@query(f"WITH {PT}, {_tiles_sql()}, o AS (SELECT id, (x + 0.25e0) * 2.9e0 AS cx, (y + 0.25e0) * 0.9e0 AS cy FROM pt) SELECT id, tile_id FROM o JOIN tl ON cy >= cr0 AND cy < cr1 AND cx >= cc0 AND cx < cc1")
def core_ownership(spark, d):
    """Objects seen by up to four tiles each, kept by the one whose core holds their centroid."""
    scene = views.scene(spark, d)
    at = views.points(spark, d).select("id", ((F.col("x") + 0.25) * 2.9).alias("cx"), ((F.col("y") + 0.25) * 0.9).alias("cy"))
    at = at.withColumns({"r": F.floor("cy").cast("int"), "c": F.floor("cx").cast("int")}).where(F.col("r") < scene.height)
    seen = tiles.to_tiles(at, scene.height, scene.width, TILE, OVERLAP).select("id", "tile_id", "cx", "cy")
    return detect.own_objects(seen, scene, detect.DetectConfig(tile=TILE, overlap=OVERLAP)).select("id", "tile_id")


@query(f"WITH {PX}, {PT}, k AS (SELECT DISTINCT r // 40 AS i, c // 40 AS j FROM px) SELECT id, CAST(i * 4 + j AS INT) AS core_id, (pt.r // 40 = i AND pt.c // 40 = j) AS in_core FROM pt JOIN k ON pt.r >= i * 40 - 8 AND pt.r <= i * 40 + 47 AND pt.c >= j * 40 - 8 AND pt.c <= j * 40 + 47 WHERE pt.r <= (SELECT max(r) FROM px)")
def seed_windows(spark, d):
    """Every window (core and halo) that holds a seed, and whether its core does."""
    h = views.height(spark, d)
    return tiles.to_halos(views.points(spark, d).where(F.col("r") < h), 40, 40, h, views.WIDTH, 8).select("id", "core_id", "in_core")


@query(f"WITH {PX}, {PT} SELECT DISTINCT CAST((pt.r // 10) * 15 + pt.c // 10 AS INT) AS core_id FROM pt JOIN px ON px.r = pt.r AND px.c = pt.c WHERE valid AND score > 5000")
def seeds_in_tiles(spark, d):
    """Cores that hold seeds on valid pixels."""
    seeds = views.points(spark, d).where("score > 5000").select("id", "r", "c")
    valid = views.pixels(spark, d).where("valid").select("r", "c")
    return tiles.cores_with_seeds(seeds.join(valid, ["r", "c"]), 10, 10, views.WIDTH)


@query(f"WITH {PX}, {PT} SELECT core_id FROM (SELECT DISTINCT CAST((r // 10) * 15 + c // 10 AS INT) AS core_id FROM px EXCEPT SELECT CAST((r // 10) * 15 + c // 10 AS INT) FROM pt WHERE score > 5000)")
def tile_except(spark, d):
    """Cores without seeds."""
    cores = tiles.to_cores(views.pixels(spark, d), 10, 10, views.WIDTH).select("core_id").distinct()
    return tiles.cores_without_seeds(cores, tiles.cores_with_seeds(views.points(spark, d).where("score > 5000"), 10, 10, views.WIDTH))


@query(f"WITH {PX} SELECT r, c, round((nir - red) / greatest(nir + red, 1e-6), 6) AS ndvi, round((green - red) / greatest(green + red, 1e-6), 6) AS ndgr, round((blue - red) / greatest(blue + red, 1e-6), 6) AS ndbr FROM px WHERE valid")
def spectral_indices(spark, d):
    return views.pixels(spark, d).where("valid").select("r", "c", *(F.round(pixel.index(n), 6).alias(n.lower()) for n in pixel.INDEX_BANDS))


@query(f"WITH {PX}{LAB} SELECT r, c, round(L, 4) AS lightness, round(a, 4) AS a, round(b, 4) AS b FROM lab")
def rgb_to_lab(spark, d):
    parts = color.lab(*(F.col(b) for b in views.BANDS[:3]))
    return views.pixels(spark, d).where("valid").select("r", "c", *(F.round(v, 4).alias(n) for n, v in zip(("lightness", "a", "b"), parts, strict=True)))


@query(f"WITH {PX}{LAB} SELECT px.r, px.c, round(L, 4) AS l_star, round(a, 4) AS a_star, round(b, 4) AS b_star FROM px LEFT JOIN lab ON px.r = lab.r AND px.c = lab.c")
def lab_raster(spark, d):
    """The CIELAB raster of the scene, null where data is missing."""
    from lumigrid.sources.raster import lab_raster as raster

    px = views.pixels(spark, d).select("r", "c", *(F.when(F.col("valid"), F.col(b)).otherwise(-1.0).alias(b) for b in views.BANDS))
    out = raster(replace(views.scene(spark, d), nodata=-1.0), px, views.BANDS[:3], {b: k for k, b in enumerate(views.BANDS)})
    return out.select("r", "c", *(F.round(n, 4).alias(f"{n.lower()}_star") for n in ("L", "a", "b")))


@query(f"WITH {PX}{LAB} SELECT px.r, px.c, round(L, 4) AS f0, round(a, 4) AS f1, round(b, 4) AS f2, red AS raw0, green AS raw1, blue AS raw2 FROM px JOIN lab ON px.r = lab.r AND px.c = lab.c")
def growing_spaces_rgb(spark, d):
    """The growing spaces of scenes without near infrared: weighted CIELAB and raw bands."""
    trio = views.BANDS[:3]
    lab, raw = pixel.growing_space("lab_w", trio), pixel.growing_space("raw", trio)
    return views.pixels(spark, d).where("valid").select("r", "c", *(F.round(f, 4).alias(f"f{k}") for k, f in enumerate(lab)), *(f.alias(f"raw{k}") for k, f in enumerate(raw)))


@query(f"WITH {PX}{LCH} SELECT r, c, round(L, 4) AS lightness, round(CH, 4) AS chroma, CASE WHEN CH > 1e-3 THEN round(Hab, 3) END AS hue FROM lch")
def rgb_to_lch(spark, d):
    lightness, chroma, hue = color.lch(*(F.col(b) for b in views.BANDS[:3]))
    return views.pixels(spark, d).where("valid").select("r", "c", F.round(lightness, 4).alias("lightness"), F.round(chroma, 4).alias("chroma"), F.when(chroma > 1e-3, F.round(hue, 3)).alias("hue"))


@query(f"WITH {PX}{LAB} SELECT p.r, p.c, round(100e0 * (nir - red) / greatest(nir + red, 1e-6), 4) AS ndvi, round(L, 4) AS lightness FROM px p JOIN lab ON p.r = lab.r AND p.c = lab.c")
def growing_space_ndvi(spark, d):
    ndvi, lightness = pixel.growing_space("ndvi_L", ("red", "green", "blue"))
    return views.pixels(spark, d).where("valid").select("r", "c", F.round(ndvi, 4).alias("ndvi"), F.round(lightness, 4).alias("lightness"))


@query(f"WITH {PX}, w AS (SELECT r, c, r // 25 AS t, CASE WHEN valid THEN nir * 16 ELSE 0e0 END AS nir, CASE WHEN valid THEN red ELSE 0e0 END AS red FROM px), s AS (SELECT t, max(nir) AS m, quantile_cont(nir, 0.999) AS q FROM w GROUP BY t) SELECT r, c, round(least(greatest(CASE WHEN m > 255 THEN nir * (255e0 / greatest(q, 1e0)) ELSE nir END, 0e0), 255e0), 5) AS nir, red FROM w JOIN s USING (t)")
def to_uint8_scale(spark, d):
    """Scaling of sixteen-bit bands by window; missing pixels take part as zeros."""
    px = views.pixels(spark, d).withColumns({"tile_id": F.floor(F.col("r") / 25), "nir": F.when(F.col("valid"), F.col("nir") * 16).otherwise(0.0), "red": F.when(F.col("valid"), F.col("red")).otherwise(0.0)})
    return zonal.to_uint8(px, ["nir", "red"]).select("r", "c", F.round("nir", 5).alias("nir"), "red")


@query(f"WITH {PX}, w AS (SELECT *, least(140, hh, ww) AS sz FROM (SELECT (SELECT max(r) + 1 FROM px) AS hh, 150 AS ww), generate_series(1, 3) a(i), generate_series(1, 3) b(j)), v AS (SELECT green, red, nir FROM px, w WHERE valid AND green <> 0 AND red <> 0 AND nir <> 0 AND r >= greatest(0, least(hh - sz, hh * i // 4 - sz // 2)) AND r < greatest(0, least(hh - sz, hh * i // 4 - sz // 2)) + sz AND c >= greatest(0, least(ww - sz, ww * j // 4 - sz // 2)) AND c < greatest(0, least(ww - sz, ww * j // 4 - sz // 2)) + sz), q AS (SELECT median(green) AS m1, median(red) AS m2, median(nir) AS m3 FROM v) SELECT m1, m2, m3, CASE WHEN m2 < m1 AND m2 < m3 AND least(m1, m3) - m2 > 0.1e0 * greatest(m2, 1e-6) THEN 'cir' WHEN m2 > m1 AND m2 > m3 THEN 'rgb' END AS guess FROM q")
def band_medians_guess(spark, d):
    """Band medians of a grid of windows and the mode they suggest."""
    bands = ("green", "red", "nir")
    m = modes.sample_medians(views.pixels(spark, d).where("valid"), bands, views.height(spark, d), views.WIDTH, size=140, least=1)
    guess = modes.guess_band_order(m)[0]
    return spark.createDataFrame([(*m, guess)], "m1 double, m2 double, m3 double, guess string")


@query(ORACLE["band_medians_guess"].replace("SELECT m1, m2, m3, CASE", "SELECT CASE").replace("WHEN m2 > m1 AND m2 > m3 THEN 'rgb' END AS guess", "END AS mode, CASE WHEN m2 < m1 AND m2 < m3 AND least(m1, m3) - m2 > 0.1e0 * greatest(m2, 1e-6) THEN 'nir,red,green' END AS roles"))
def auto_mode(spark, d):
    """The mode and band order of a scene of three bands that says nothing of them; none where the
    usual order fits."""
    px = views.pixels(spark, d).where("valid")
    mode, roles, _ = modes.auto_mode(px, ("green", "red", "nir"), views.height(spark, d), views.WIDTH, size=140, least=1)
    return spark.createDataFrame([(mode, ",".join(roles) if roles else None)], "mode string, roles string")


def _radiometry_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT '{b}' AS role, count({b}) AS n, quantile_cont({b}, 0.02) AS lo, quantile_cont({b}, 0.98) AS hi FROM px WHERE valid" for b in views.BANDS)
    ref = " UNION ALL ".join(f"SELECT '{b}' AS role, {v[0]}e0 AS r0, {v[1]}e0 AS r1" for b, v in normalise.REFERENCE.items())
    return f"{PX}, pc AS ({rows}), rf AS ({ref})"


@query(f"WITH {_radiometry_sql()} SELECT role, n, round(lo, 5) AS lo, round(hi, 5) AS hi, lo - r0 > 15 AS dark, hi - lo < 0.7e0 * (r1 - r0) AS flat FROM pc JOIN rf USING (role)")
def radiometry_fit(spark, d):
    """Percentiles by band and whether they call for a match."""
    out = normalise.measure_bands(views.pixels(spark, d).where("valid"), views.BANDS)
    return out.select("role", "n", F.round("lo", 5).alias("lo"), F.round("hi", 5).alias("hi"), "dark", "flat")


@query(f"WITH {_radiometry_sql()}, g AS (SELECT role, lo, r0, (r1 - r0) / greatest(hi - lo, 1e-6) AS k FROM pc JOIN rf USING (role)) SELECT r, c, {', '.join(f'''round(least(greatest(({b} - (SELECT lo FROM g WHERE role = '{b}')) * (SELECT k FROM g WHERE role = '{b}') + (SELECT r0 FROM g WHERE role = '{b}'), 0e0), 255e0), 4) AS {b}''' for b in views.BANDS)} FROM px WHERE valid")
def radiometry_apply(spark, d):
    """Bands mapped to the reference ranges."""
    px = views.pixels(spark, d).where("valid")
    found = normalise.measure_bands(px, views.BANDS).collect()  # a row per band
    return _round(normalise.match_bands(px, found).select("r", "c", *views.BANDS), 4)


# --- segments ---------------------------------------------------------------------------------------


def _zonal(spark, d) -> DataFrame:
    return zonal.zonal_features(views.segments(spark, d), modes.MODES["rgbn"], box=BOX, block=BLOCK)


@query(f"WITH {BOX_SQL} SELECT r, c, round(lm_NDVI, 5) AS lm_ndvi, round(lm_L, 4) AS lm_l FROM lm")
def box_mean(spark, d):
    """Two-dimensional moving mean without missing pixels."""
    px = zonal.with_bands(views.pixels(spark, d), modes.MODES["rgbn"])
    return zonal.box_mean(px.select("tile_id", "r", "c", "tr", "tc", "valid", "NDVI", "lightness"), ["NDVI", "lightness"], BOX, block=BLOCK).select("r", "c", F.round("lm_NDVI", 5).alias("lm_ndvi"), F.round("lm_lightness", 4).alias("lm_l"))


@query(f"WITH {ZONAL_NOBOX} SELECT seg, cnt, round(mr, 5) AS mr, round(mc, 5) AS mc, {', '.join(f'round({k}_{b}, 4) + 0e0 AS {k.lower()}_{b.lower()}' for b in ('NDVI', 'NDGR', 'NDBR', 'L', 'C') for k in ('sr', 'sd'))} FROM z")
def zonal_stats(spark, d):
    z = _zonal(spark, d)
    return z.select("seg", "cnt", F.round("mr", 5).alias("mr"), F.round("mc", 5).alias("mc"), *((F.round(f"{k}_{b}", 4) + 0.0).alias(f"{k}_{b}".lower()) for b in ("NDVI", "NDGR", "NDBR", "L", "C") for k in ("sr", "sd")))


@query(f"WITH {ZONAL} SELECT seg, {', '.join(f'round(ktr_{b}, 4) + 0e0 AS ktr_{b.lower()}' for b in ('NDVI', 'NDGR', 'NDBR', 'L', 'C'))} FROM z")
def contrast(spark, d):
    """Segment mean less the mean of the box means."""
    return _zonal(spark, d).select("seg", *((F.round(f"ktr_{b}", 4) + 0.0).alias(f"ktr_{b}".lower()) for b in ("NDVI", "NDGR", "NDBR", "L", "C")))


@query(f"WITH {ZONAL_NOBOX} SELECT seg, round(cos_Hab, 5) AS cos_hab, round(sin_Hab, 5) AS sin_hab, round(war_Hab, 5) AS war_hab FROM z")
def zonal_hue(spark, d):
    return _zonal(spark, d).select("seg", *(F.round(c, 5).alias(c.lower()) for c in ("cos_Hab", "sin_Hab", "war_Hab")))


@query(f"WITH {ZONAL_NOBOX} SELECT seg, round(pow_m2, 4) AS pow_m2, CASE WHEN wydluzenie < 1000 THEN round(wydluzenie, 4) END AS wydluzenie FROM z")
def zonal_shape(spark, d):
    return _zonal(spark, d).select("seg", F.round("pow_m2", 4).alias("pow_m2"), F.when(F.col("wydluzenie") < 1000, F.round("wydluzenie", 4)).alias("wydluzenie"))


@query(f"WITH {ZONAL_NOBOX}, b AS (SELECT * FROM z WHERE cnt >= 4), s AS (SELECT median(sr_NDVI) AS m1, median(sr_L) AS m2 FROM b), t AS (SELECT median(abs(sr_NDVI - m1)) * 1.4826e0 + 1e-6 AS d1, median(abs(sr_L - m2)) * 1.4826e0 + 1e-6 AS d2 FROM b, s) SELECT seg, round((sr_NDVI - m1) / d1, 4) AS z_sr_ndvi, round((sr_L - m2) / d2, 4) AS z_sr_l FROM z, s, t")
def scene_zscore(spark, d):
    """Robust z-scores by scene median and MAD."""
    z = cut(_zonal(spark, d).select("seg", "cnt", "sr_NDVI", "sr_L"), "zscore")
    found = normalise.robust_statistics(z.where("cnt >= 4"), ["sr_NDVI", "sr_L"])
    return z.withColumns(normalise.robust_scores(found, "both")).select("seg", F.round("z_sr_NDVI", 4).alias("z_sr_ndvi"), F.round("z_sr_L", 4).alias("z_sr_l"))


@query(f"WITH {SEG}{EDGES} SELECT a, b FROM ed")
def edges_distinct(spark, d):
    return graph.edges(views.segments(spark, d)).select("a", "b")


@query(f"WITH RECURSIVE {SEG}{EDGES}, pr AS (SELECT seg FROM seg WHERE valid GROUP BY seg HAVING avg(nir) < 100){COMPONENTS} SELECT seg, CAST(obj AS BIGINT) AS obj FROM mem")
def components(spark, d):
    """Objects of adjacent dark segments, settled in tiles and stitched over their borders."""
    px = cut(views.tiled_segments(spark, d, TILE), "seg")
    dark = px.where("valid").groupBy("tile_id", "seg").agg(F.avg("nir").alias("m")).where("m < 100")
    return graph.build_objects(dark, graph.edges(px, (), row="r", col="c"), (), place="tile_id").select("seg", "obj")


#: The flagship's scene in tiles without overlap, whose objects are stitched.
STITCHED = detect.DetectConfig(box_px=BOX, min_px=4, tile=TILE, overlap=0, stitch=True, suppress_scope="scene", edge_px=0, suppress_m=RADIUS)


def _found(spark, d) -> detect.Detection:
    return detect.detect_frame(cut(views.tiled_segments(spark, d, TILE), "seg"), modes.MODES["rgbn"], FOREST, 0.6, views.scene(spark, d), STITCHED)


@query(f"WITH {SCORED} SELECT seg, round(p, 6) AS p FROM sc")
def forest_score(spark, d):
    """Forest probability of segments of four or more pixels, 0 of others."""
    z = _zonal(spark, d)
    return detect.score_segments(z, FOREST, zonal.spark_names(modes.feature_names("rgbn")), None).select("seg", F.round("p", 6).alias("p"))


@query(f"WITH RECURSIVE {SCORED}{OBJECTS} SELECT CAST(obj AS BIGINT) AS obj, nseg, round(pow, 4) AS pow, round(cx, 4) AS cx, round(cy, 4) AS cy, round(elong, 3) AS elong, round(s_max, 5) AS s_max, round(s_mean, 5) AS s_mean, round(s_min, 5) AS s_min, round(obj_sr_NDVI, 4) AS obj_sr_ndvi, round(obj_sr_L, 3) AS obj_sr_l FROM ob")
def object_features(spark, d):
    o = _found(spark, d).objects
    return o.select("obj", "nseg", F.round("pow", 4).alias("pow"), F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"), F.round("elong", 3).alias("elong"), *(F.round(c, 5).alias(c) for c in ("s_max", "s_mean", "s_min")), F.round("obj_sr_NDVI", 4).alias("obj_sr_ndvi"), F.round("obj_sr_L", 3).alias("obj_sr_l"))


@query(f"WITH RECURSIVE {SCORED}{OBJECTS} SELECT CAST(obj AS BIGINT) AS obj, ring_n, round(ring_ndvi, 4) AS ring_ndvi, round(ring_L, 3) AS ring_l FROM ob")
def object_ring(spark, d):
    return _found(spark, d).objects.select("obj", "ring_n", F.round("ring_ndvi", 4).alias("ring_ndvi"), F.round("ring_L", 3).alias("ring_l"))


@query(f"WITH {SCORED} SELECT r, c, CAST(coalesce(round(p, 4), -1) AS DOUBLE) AS p FROM seg LEFT JOIN sc ON seg.seg = sc.seg")
def prob_raster(spark, d):
    """Probability of every pixel, -1 where data is missing."""
    z = _zonal(spark, d)
    scored = detect.score_segments(z, FOREST, zonal.spark_names(modes.feature_names("rgbn")), None)
    px = views.segments(spark, d).select("tile_id", "r", "c", "seg")
    return px.join(scored.select("tile_id", "seg", "p"), ["tile_id", "seg"], "left").select("r", "c", F.coalesce(F.round("p", 4), F.lit(-1.0)).alias("p"))


@query(f"WITH RECURSIVE {SCORED}{OBJECTS}, cd AS (SELECT obj, cx AS x, cy AS y, round(s_max, 9) AS s FROM ob){_suppressed('cd', 'obj', 's', RADIUS)} SELECT row_number() OVER (ORDER BY obj) AS id, round(cx, 4) AS x, round(cy, 4) AS y, round(s_max, 4) AS p, round(s_mean, 4) AS p_mean, round(pow, 2) AS area_m2, CAST(nseg AS INT) AS n_adaptels FROM ob JOIN kp ON kp.id = ob.obj")
def dead_trees(spark, d):
    """The flagship: points of the scene with blocks as segments, from pixels to the final layer."""
    scene, cfg = views.scene(spark, d), STITCHED
    found = _found(spark, d)
    rounded = detect.Detection(found.pixels, found.segments, found.links, found.members, found.objects.withColumn("s_max", F.round("s_max", 9)))
    pts = detect.points_of(rounded, scene, modes.MODES["rgbn"], cfg)
    return pts.select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "p", "p_mean", "area_m2", "n_adaptels")


def _tiled_sql() -> str:
    """Every tile's window on its own: blocks as segments, features, objects, ownership and suppression
    per tile, and the distance of each point's pixel to missing data or the window's edge."""
    step = TILE - OVERLAP
    return f"""{PX}{LCH}, {_tiles_sql()},
wi AS MATERIALIZED (SELECT tile_id, r0, c0, h, w, px.*, CASE WHEN valid THEN tile_id * 1000000 + (r - r0) // 4 * 100 + (c - c0) // 4 END AS seg FROM px JOIN tl ON r >= r0 AND r < r0 + h AND c >= c0 AND c < c0 + w),
bd AS MATERIALIZED (SELECT p.tile_id, p.r, p.c, p.seg, p.valid, {_IDX}, l.L, l.CH AS C_, l.Hab FROM wi p LEFT JOIN lch l ON p.r = l.r AND p.c = l.c){_zonal_sql(False)},
seg AS (SELECT * FROM wi),
ed AS MATERIALIZED (SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM (
  SELECT p.seg AS x, q.seg AS y FROM wi p JOIN wi q ON p.tile_id = q.tile_id AND p.r = q.r AND q.c = p.c + 1 WHERE p.valid AND q.valid
  UNION ALL SELECT p.seg, q.seg FROM wi p JOIN wi q ON p.tile_id = q.tile_id AND p.c = q.c AND q.r = p.r + 1 WHERE p.valid AND q.valid) WHERE x <> y),
sc AS MATERIALIZED (SELECT *, CASE WHEN cnt >= 4 THEN {FOREST_SQL} ELSE 0e0 END AS p, cnt * 0.0625e0 AS area, mc + 0.5e0 AS x, mr + 0.5e0 AS y FROM z),
pr AS (SELECT seg FROM sc WHERE cnt >= 4 AND p >= 0.6e0){COMPONENTS},
oo AS (SELECT mem.obj, mem.obj // 1000000 AS tile_id, sum(area * x) / sum(area) AS x, sum(area * y) / sum(area) AS y, sum(area) AS pow, count(*) AS nseg, round(max(p), 9) AS s, sum(area * p) / sum(area) AS s_mean FROM mem JOIN sc ON mem.seg = sc.seg GROUP BY mem.obj),
ow AS (SELECT oo.*, r0, c0, h, w FROM oo JOIN tl ON oo.tile_id = tl.tile_id AND y >= cr0 AND y < cr1 AND x >= cc0 AND x < cc1),
rk AS (SELECT obj AS id, tile_id, x, y, row_number() OVER (ORDER BY s DESC, obj) AS k FROM ow),
sup(k, kept) AS (SELECT 0, CAST([] AS STRUCT(id BIGINT, t BIGINT, x DOUBLE, y DOUBLE)[])
  UNION ALL SELECT rk.k, CASE WHEN len(list_filter(kept, lambda s: s.t = rk.tile_id AND (s.x - rk.x) * (s.x - rk.x) + (s.y - rk.y) * (s.y - rk.y) <= {RADIUS * RADIUS}e0)) = 0 THEN list_append(kept, {{'id': CAST(rk.id AS BIGINT), 't': CAST(rk.tile_id AS BIGINT), 'x': rk.x, 'y': rk.y}}) ELSE kept END
  FROM sup JOIN rk ON rk.k = sup.k + 1),
kp AS (SELECT unnest(list_transform((SELECT kept FROM sup ORDER BY k DESC LIMIT 1), lambda s: s.id)) AS id),
fi AS (SELECT ow.*, least(greatest(round_even(y - r0, 0), 0), h - 1) AS pr, least(greatest(round_even(x - c0, 0), 0), w - 1) AS pc FROM ow JOIN kp ON kp.id = ow.obj),
ds AS (SELECT obj, least(any_value(least(pr + 1, h - pr, pc + 1, w - pc)), coalesce(min(sqrt((r - fi.r0 - pr) * (r - fi.r0 - pr) + (c - fi.c0 - pc) * (c - fi.c0 - pc))), 1e9)) AS edge_px
  FROM fi LEFT JOIN (SELECT tile_id, r, c FROM wi WHERE NOT valid) g ON g.tile_id = fi.tile_id GROUP BY obj)
SELECT row_number() OVER (ORDER BY tile_id, fi.obj) AS id, round(x, 4) AS x, round(y, 4) AS y, round(s, 4) AS p, round(s_mean, 4) AS p_mean, round(pow, 2) AS area_m2, CAST(nseg AS INT) AS n_adaptels, round(edge_px, 1) AS edge_px, printf('%d_%d', r0, c0) AS tile FROM fi JOIN ds ON fi.obj = ds.obj"""


@query(f"WITH RECURSIVE {_tiled_sql()}")
def detect_tiled(spark, d):
    """Detection over overlapping tiles: objects of each window, kept by the tile whose core holds
    their centroid, suppressed per tile, with their distance to missing data."""
    cfg = detect.DetectConfig(box_px=BOX, min_px=4, tile=TILE, overlap=OVERLAP, suppress_m=RADIUS)
    scene, mode = views.scene(spark, d), modes.MODES["rgbn"]
    found = detect.detect_frame(cut(views.tiled_segments(spark, d, TILE, OVERLAP), "seg"), mode, FOREST, 0.6, scene, cfg)
    rounded = replace(found, objects=found.objects.withColumn("s_max", F.round("s_max", 9)))
    pts = detect.points_of(rounded, scene, mode, cfg)
    return pts.select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "p", "p_mean", "area_m2", "n_adaptels", "edge_px", "tile")


#: A small forest over object features.
OBJECT_FOREST = [
    {"tree": 0, "node": n, "feature": f, "threshold": v, "left": a, "right": b, "p": p}
    for n, f, v, a, b, p in ((0, "pow", 1.30001, 1, 2, None), (1, "ring_ndvi", 0.05001, 3, 4, None), (2, None, None, None, None, 0.8), (3, None, None, None, None, 0.35), (4, None, None, None, None, 0.55))
]
_P_OBJECT = "CASE WHEN pow <= 1.30001e0 THEN CASE WHEN ring_ndvi <= 0.05001e0 THEN 0.35e0 ELSE 0.55e0 END ELSE 0.8e0 END"
_GATED = f""",
og AS (SELECT *, {_P_OBJECT} AS p_object FROM ob WHERE pow >= 0.26e0),
sg AS (SELECT og.*, CAST(EXISTS (SELECT 1 FROM st WHERE age >= 5 AND cx > x0 + 1.37e0 AND cx < x0 + 6.63e0 AND cy > y0 + 1.37e0 AND cy < y0 + 6.63e0) AS INT) AS in_stands FROM og WHERE p_object >= 0.5e0),
hg AS (SELECT obj, max(h) AS height_m FROM sg LEFT JOIN ht ON ht.r BETWEEN floor(cy) - 1 AND floor(cy) + 1 AND ht.c BETWEEN floor(cx) - 1 AND floor(cx) + 1 GROUP BY obj),
gt AS (SELECT sg.*, height_m, cx AS x, cy AS y, round(s_max, 9) AS s FROM sg JOIN hg ON sg.obj = hg.obj WHERE height_m IS NULL OR NOT height_m < 40)"""


@query(f"WITH RECURSIVE {SCORED}{OBJECTS}, {ST}, {HT}{_GATED}{_suppressed('gt', 'obj', 's', RADIUS)} SELECT row_number() OVER (ORDER BY obj) AS id, round(cx, 4) AS x, round(cy, 4) AS y, round(s_max, 4) AS p, p_object, round(pow, 2) AS area_m2, in_stands, round(height_m, 2) AS height_m FROM gt JOIN kp ON kp.id = gt.obj")
def dead_trees_gated(spark, d):
    """The flagship with its gates: least area, object forest and cut, stands as a flag, heights."""
    scene = views.scene(spark, d)
    cfg = replace(STITCHED, min_area=0.26, object_threshold=0.5, stand_age=5, stand_buffer=-1.37, keep_outside=True, height_radius=1.0, min_height=40.0)
    found = _found(spark, d)
    rounded = detect.Detection(found.pixels, found.segments, found.links, found.members, found.objects.withColumn("s_max", F.round("s_max", 9)))
    pts = detect.points_of(rounded, scene, modes.MODES["rgbn"], cfg, OBJECT_FOREST, views.stands(spark, d), (views.heights(spark, d),))
    return pts.select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "p", "p_object", "area_m2", "in_stands", "height_m")


# --- points, gates, growing -------------------------------------------------------------------------


@query(f"WITH RECURSIVE {PT}{_suppressed('pt', 'id', 'score', RADIUS)} SELECT id FROM kp")
def suppress_points(spark, d):
    return graph.suppress(views.points(spark, d), RADIUS).where("keep").select("id")


@query(f"WITH {PT}, {ST} SELECT id, CAST(EXISTS (SELECT 1 FROM st WHERE age >= 10 AND x > x0 + 2 AND x < x0 + 6 AND y > y0 + 2 AND y < y0 + 6) AS INT) AS in_stands FROM pt")
def stands_inside(spark, d):
    """Points inside stands old enough, shrunk by two units."""
    return spatial.inside_stands(views.points(spark, d), spatial.usable_stands(views.stands(spark, d), 10), -2.0, cell=16.0).select("id", "in_stands")


#: The union by brute force: unit squares that a stand covers or not, and points against all of them.
_OVERLAP = """
sr AS (SELECT CAST(n_nationkey % 5 * 10 AS INT) AS x0, CAST(n_nationkey // 5 * 10 AS INT) AS y0, CAST(8 + n_nationkey % 3 * 3 AS INT) AS w, CAST(6 + n_nationkey % 2 * 7 AS INT) AS h FROM nation WHERE n_regionkey * 5 >= 5
  UNION ALL SELECT CAST(n_nationkey % 5 * 10 + 2 AS INT), CAST(n_nationkey // 5 * 10 + 1 AS INT), 4, 3 FROM nation WHERE n_regionkey * 5 >= 5 AND n_nationkey % 3 = 0),
sq AS (SELECT i, j, EXISTS (SELECT 1 FROM sr WHERE i >= x0 AND i < x0 + w AND j >= y0 AND j < y0 + h) AS full_ FROM generate_series(-4, 64) a(i), generate_series(-4, 64) b(j)),
pq AS (SELECT id, x + 0.25e0 AS px, y + 0.25e0 AS py FROM pt WHERE y < 60),
dq AS (SELECT id, min(g) FILTER (full_) AS inner_, min(g) FILTER (NOT full_) AS outer_ FROM (SELECT id, full_, greatest(i - px, px - i - 1, 0e0) * greatest(i - px, px - i - 1, 0e0) + greatest(j - py, py - j - 1, 0e0) * greatest(j - py, py - j - 1, 0e0) AS g FROM pq, sq) GROUP BY id)"""


@query(f"WITH {PT}, {_OVERLAP} SELECT id, CAST(outer_ > 4 AS INT) AS shrunk, CAST(outer_ > 0 AS INT) AS plain, CAST(inner_ <= 4 AS INT) AS grown FROM dq")
def stands_overlap(spark, d):
    """Points inside the union of stands that overlap and hold one another, shrunk, as it is, grown."""
    stands = spatial.usable_stands(views.overlapping_stands(spark, d), 5)
    out = views.points(spark, d).where("y < 60").select("id", (F.col("x") + 0.25).alias("x"), (F.col("y") + 0.25).alias("y"))
    for name, buffer in (("shrunk", -2.0), ("plain", 0.0), ("grown", 2.0)):
        out = spatial.inside_stands(out, stands, buffer, cell=16.0).withColumnRenamed("in_stands", name)
    return out.select("id", "shrunk", "plain", "grown")


@query(f"WITH {PT}, {HT}, t AS (SELECT pt.id, max(h) AS height_m FROM pt LEFT JOIN ht ON ht.r BETWEEN pt.r - 1 AND pt.r + 1 AND ht.c BETWEEN pt.c - 1 AND pt.c + 1 GROUP BY pt.id) SELECT id, height_m FROM t WHERE height_m IS NULL OR NOT height_m < 40")
def height_gate(spark, d):
    """Largest height near a point; low points go, unknown ones stay."""
    p = views.points(spark, d).withColumnsRenamed({"r": "hr", "c": "hc"})
    return spatial.drop_low(spatial.height_near(p, views.heights(spark, d), 1), 40.0).select("id", "height_m")


@query(f"WITH {PT}, {HT}, t AS (SELECT pt.id, max(h + 100) AS top FROM pt LEFT JOIN ht ON ht.r BETWEEN pt.r - 2 AND pt.r + 2 AND ht.c BETWEEN pt.c - 2 AND pt.c + 2 GROUP BY pt.id) SELECT t.id, top - CASE WHEN h IS NOT NULL THEN 90 + h / 10 END AS height_m FROM t JOIN pt ON pt.id = t.id LEFT JOIN ht ON ht.r = pt.r AND ht.c = pt.c")
def dsm_minus_dtm(spark, d):
    """Surface maximum less the terrain under the point."""
    p = views.points(spark, d).withColumnsRenamed({"r": "hr", "c": "hc"})
    h = views.heights(spark, d)
    return spatial.surface_height(p, h.withColumn("h", F.col("h") + 100), h.withColumn("h", F.col("h") / 10 + 90), 2).select("id", "height_m")


@query(f"WITH {PX}, {PT}, dm AS (SELECT max(r) + 1 AS hh, 150 AS ww FROM px), g AS (SELECT r, c FROM px WHERE NOT valid), p AS (SELECT pt.id, pt.r, pt.c, hh, ww FROM pt, dm WHERE pt.r < hh) SELECT p.id, round(least(any_value(least(p.r + 1, hh - p.r, p.c + 1, ww - p.c)), coalesce(min(sqrt((p.r - g.r) * (p.r - g.r) + (p.c - g.c) * (p.c - g.c))), 1e9)), 1) AS edge_px FROM p LEFT JOIN g ON true GROUP BY p.id")
def nodata_distance(spark, d):
    h = views.height(spark, d)
    p = views.points(spark, d).where(F.col("r") < h)
    missing = views.pixels(spark, d).where("not valid").select("r", "c")
    return spatial.nodata_distance(p, missing, h, views.WIDTH, band=64, strip=64).select("id", F.round("edge_px", 1).alias("edge_px"))


@query("WITH s AS (SELECT list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(sqrt(list_sum(list_transform(generate_series(1, 64), lambda i: (embedding[i] - s.e[i]) * (embedding[i] - s.e[i]) * CASE WHEN i % 2 = 0 THEN 4e0 ELSE 1e0 END))), 4) AS dist FROM embeddings, s")
def seed_distance(spark, d):
    """Weighted distance of feature vectors to a seed's vector, the step cost of growing."""
    e = views.table(spark, d, "embeddings")
    seed = [float(v) for v in e.where("vec_id = 0").first()["embedding"]]
    weights = F.array(*(F.lit(2.0 if i % 2 else 1.0) for i in range(64)))
    parts = F.zip_with(F.zip_with("embedding", F.array(*map(F.lit, seed)), lambda a, b: a.cast("double") - b), weights, lambda x, w: x * x * w * w)
    return e.select("vec_id", F.round(F.sqrt(F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)), 4).alias("dist"))


@query(f"WITH {PX}, {PT}, lb AS (SELECT px.r, px.c, coalesce(min(pt.id), -1) AS gid FROM px LEFT JOIN pt ON score > 8000 AND abs(px.r - pt.r) <= 1 AND abs(px.c - pt.c) <= 1 AND valid GROUP BY px.r, px.c) SELECT gid, count(*) AS n_px FROM lb GROUP BY gid")
def label_raster_counts(spark, d):
    """A label raster of squares around points, -1 elsewhere, counted by label."""
    seeds = views.points(spark, d).where("score > 8000").select(F.col("id").alias("gid"), "r", "c")
    steps = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    spread = seeds.withColumn("dr", F.explode(steps)).withColumn("dc", F.explode(steps)).select("gid", (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"))
    px = views.pixels(spark, d)
    labels = spread.groupBy("r", "c").agg(F.min("gid").alias("gid")).join(px.where("valid").select("r", "c"), ["r", "c"])
    return grow.label_raster(px, labels).groupBy("gid").agg(F.count("*").alias("n_px"))


@query(f"WITH {SEG} SELECT CAST(seg AS BIGINT) AS adaptel_id, count(*) AS n_px, count(*) * 0.0625e0 AS area_m2, round(2 * sqrt(pi() * (count(*) * 0.0625e0)), 6) AS perimeter FROM seg WHERE valid GROUP BY seg")
def crown_areas(spark, d):
    """Area and the perimeter of the circle of that area."""
    labels = views.segments(spark, d).where("valid").select(F.col("seg").cast("long").alias("gid"), "r", "c")
    return grow.crown_statistics(labels, 0.0625).withColumn("perimeter", F.round("perimeter", 6))


@query(f"WITH {PT}, a AS (SELECT id, 500000e0 + (x + 0.5e0) * 0.25e0 AS mx, 600000e0 + (y + 0.5e0) * -0.25e0 AS my FROM pt) SELECT id, mx, my, CAST(floor((my - 600000e0) / -0.25e0) AS INT) AS row, CAST(floor((mx - 500000e0) / 0.25e0) AS INT) AS col FROM a")
def affine_round_trip(spark, d):
    """Pixels to map coordinates and back."""
    t = pixel.Affine(0.25, 500000.0, -0.25, 600000.0)
    mx, my = t.to_map(F.col("y"), F.col("x"))
    out = views.points(spark, d).select("id", mx.alias("mx"), my.alias("my"))
    row, col = t.to_pixel(F.col("mx"), F.col("my"))
    return out.select("id", "mx", "my", F.floor(row).cast("int").alias("row"), F.floor(col).cast("int").alias("col"))


@query(f"WITH {PT}, {_UTM} SELECT id, round(500000e0 + rad * e, 3) AS easting, round(rad * n, 3) AS northing, round(lon, 9) AS lon, round(lat, 9) AS lat FROM utm")
def crs_round_trip(spark, d):
    """Geographic points in a transverse Mercator zone and back; latitudes begin again at 41.07 degrees
    after every 850 rows of points, as the zone ends at 84."""
    lon, lat = F.col("x") * 0.1 + 6.53, F.col("y") % 850 * 0.05 + 41.07
    out = views.points(spark, d).select("id", *(v.alias(n) for n, v in zip(("e", "n"), crs.transform(lon, lat, "EPSG:4326", "EPSG:32632"), strict=True)))
    back = crs.transform(F.col("e"), F.col("n"), "EPSG:32632", "EPSG:4326")
    return out.select("id", F.round("e", 3).alias("easting"), F.round("n", 3).alias("northing"), *(F.round(v, 9).alias(n) for n, v in zip(("lon", "lat"), back, strict=True)))


@query(f"WITH {PX}, h AS (SELECT max(r) + 1 AS hh, 150 AS ww FROM px), t AS (SELECT a.i AS r, b.j AS c, least(greatest((a.i + 0.5e0) * 2 - 0.5e0, 0), hh - 1) AS fr, least(greatest((b.j + 0.5e0) * 2 - 0.5e0, 0), ww - 1) AS fc FROM h, generate_series(0, hh // 2 - 1) a(i), generate_series(0, 74) b(j)), n AS (SELECT t.r, t.c, px.nir, px.valid, greatest(0e0, 1 - abs(fr - px.r)) * greatest(0e0, 1 - abs(fc - px.c)) AS w FROM t JOIN px ON px.r BETWEEN floor(fr) AND floor(fr) + 1 AND px.c BETWEEN floor(fc) AND floor(fc) + 1) SELECT CAST(r AS INT) AS r, CAST(c AS INT) AS c, CASE WHEN bool_and(valid) THEN round(sum(nir * w) / sum(w), 4) ELSE 0e0 END AS nir FROM n WHERE w > 0 GROUP BY r, c")
def resample_scene(spark, d):
    """Bilinear resampling to pixels of twice the size."""
    from lumigrid.sources.raster import Scene, resample

    h = views.height(spark, d)
    px = views.pixels(spark, d).select("r", "c", F.when(F.col("valid"), F.col("nir")).otherwise(0.0).alias("nir"))
    _, out = resample(Scene(h, views.WIDTH, ("nir",), 0.125, 0.0, -0.125, 0.0), px)
    return out.select("r", "c", F.round("nir", 4).alias("nir"))


@query(f"WITH {PX}, w AS (SELECT r, c, row_number() OVER (PARTITION BY r // 25 ORDER BY r, c) AS k FROM px WHERE valid) SELECT r, c FROM w WHERE k % 4 = 1")
def systematic_sample(spark, d):
    """One valid pixel in four, in row-major order of each tile."""
    px = views.pixels(spark, d).withColumn("tile_id", F.floor(F.col("r") / 25)).where("valid")
    return normalise.every_fourth(px).select("r", "c")


@query(f"WITH {PX}, s AS (SELECT DISTINCT CAST((r // 4) * 100 + c // 4 AS INT) AS seg, CAST(r // 4 AS INT) AS tile FROM px WHERE valid) SELECT seg, tile, row_number() OVER (ORDER BY tile, seg) AS id FROM s")
def running_ids(spark, d):
    """Ids that run over tiles in order."""
    s = views.segments(spark, d).where("valid").select("seg", F.floor(F.col("r") / 4).cast("int").alias("tile")).distinct()
    return objects.running_ids(s, "tile", ["seg"]).select("seg", "tile", "id")


@query(f"WITH {PT}, {HT}, cell AS (SELECT id, CAST(floor((y * 2 + 1) / 3) AS INT) AS hr, CAST(floor((x * 2 + 1) / 3) AS INT) AS hc FROM pt) SELECT cell.id, max(h) AS height_m FROM cell LEFT JOIN ht ON ht.r BETWEEN hr - 2 AND hr + 2 AND ht.c BETWEEN hc - 2 AND hc + 2 GROUP BY cell.id")
def height_gate_grid(spark, d):
    """Largest height near points, from a raster with a grid of its own: cells one and a half times
    those of the points, shifted by half a unit."""
    from lumigrid.sources.raster import Scene

    grid = Scene(10**6, 50, ("h",), 1.5, -0.5, 1.5, -0.5)
    return spatial.heights_at(views.points(spark, d), (grid, views.heights(spark, d)), 3.0, "height_m").select("id", "height_m")


def _stack(spark, d) -> tuple[DataFrame, DataFrame, modes.GrowRecipe]:
    ndvi, lightness = pixel.growing_space("ndvi_L", ("red", "green", "blue"))
    px = views.pixels(spark, d).select("r", "c", "valid", ndvi.alias("f0"), lightness.alias("f1"))
    seeds = views.points(spark, d).where("score > 8000").select(F.col("id").alias("gid"), "r", "c")
    return px, seeds, modes.grow_recipe(("red", "green", "blue", "nir"))


@query()
def grow_reach(spark, d):
    """Regions by the within-reach rule."""
    px, seeds, recipe = _stack(spark, d)
    return grow.grow_seeds(px, seeds, ["f0", "f1"], recipe, views.height(spark, d), views.WIDTH, 64, 64)


@query()
def grow_partition(spark, d):
    """Regions by the partition rule, cut afterwards."""
    px, seeds, _ = _stack(spark, d)
    recipe = modes.grow_recipe(("red", "green", "blue", "nir"), "ndvi_L", "partition")
    return grow.grow_seeds(px, seeds, ["f0", "f1"], recipe, views.height(spark, d), views.WIDTH, 64, 64)


@query()
def polygonize(spark, d):
    """Outlines of grown regions."""
    return grow.polygonize(grow_reach(spark, d), 0.25, 500000.0, -0.25, 600000.0)


@query(
    f"""WITH {PX}, lab AS (SELECT CAST(floor(nir / 64) AS BIGINT) AS gid, r, c FROM px WHERE valid),
quad AS (SELECT gid, r + k // 2 AS y, c + k % 2 AS x, count(*) AS n, sum(k) AS s FROM lab, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY ALL),
bit AS (SELECT gid, count(*) FILTER (WHERE n = 1) AS q1, count(*) FILTER (WHERE n = 3) AS q3, count(*) FILTER (WHERE n = 2 AND s = 3) AS qd FROM quad GROUP BY gid),
side AS (SELECT gid, r + dr AS r2, c + dc AS c2 FROM lab, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) AS t(dr, dc)),
open AS (SELECT gid, count(*) AS sides FROM (SELECT * FROM side ANTI JOIN lab ON lab.gid = side.gid AND lab.r = side.r2 AND lab.c = side.c2) GROUP BY gid),
many AS (SELECT gid, count(*) AS n_px FROM lab GROUP BY gid)
SELECT gid, n_px, sides, q1 + q3 + 2 * qd AS corners, CAST((q1 - q3 + 2 * qd) // 4 AS BIGINT) AS outer_less_holes FROM many JOIN open USING (gid) JOIN bit USING (gid)"""
)
def region_outlines(spark, d):
    """Closed rings around classes of pixels that run through all tiles: what they enclose, their sides
    and corners, and outer rings less holes."""
    labels = views.pixels(spark, d).where("valid").select(F.floor(F.col("nir") / 64).cast("long").alias("gid"), "r", "c")
    ring = outlines.ring_statistics(outlines.outline_pieces(labels, TILE))
    return ring.groupBy("gid").agg(F.sum("area").alias("n_px"), F.sum("sides").alias("sides"), F.sum("corners").alias("corners"), F.sum(F.signum("area")).cast("long").alias("outer_less_holes"))


@query()
def adaptels(spark, d):
    """Superpixels of tiles."""
    t = tiles.to_tiles(views.pixels(spark, d).drop("tile_id", "tr", "tc"), views.height(spark, d), views.WIDTH, TILE, OVERLAP)
    return segment.segment_tiles(t, views.BANDS, 60.0).select("tile_id", "r", "c", "seg")
