"""Spatial gates: stands, heights, distance to missing data."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumigrid.functions.crs import transform
from lumigrid.operators.components import cut


def usable_stands(stands: DataFrame, min_age: float | None = 10, age: str = "age") -> DataFrame:
    """Stands of at least the age; those without an age go, unless the table has no age at all."""
    if min_age is None or age not in stands.columns:
        out = stands
    else:
        out = stands.where(F.col(age).isNotNull() & (F.col(age) >= min_age))
    if out.limit(1).count() == 0:
        raise ValueError("no stand is left")
    return out


#: Lengths, relative to a side, below which places on it count as one.
SAME = 1e-9


def _in_cells(frame: DataFrame, low_x: Column, high_x: Column, low_y: Column, high_y: Column, cell: float, reach: float = 0.0) -> DataFrame:
    """Rows once for every grid cell (gx, gy) that a box, grown by ``reach``, touches."""
    out = frame.withColumn("gx", F.explode(F.sequence(F.floor((low_x - reach) / cell), F.floor((high_x + reach) / cell))))
    return out.withColumn("gy", F.explode(F.sequence(F.floor((low_y - reach) / cell), F.floor((high_y + reach) / cell))))


def _box_cells(polygons: DataFrame, cell: float) -> DataFrame:
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    return _in_cells(polygons, F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys), cell)


def _side_cells(sides: DataFrame, cell: float, reach: float = 0.0) -> DataFrame:
    return _in_cells(sides, F.least("x1", "x2"), F.greatest("x1", "x2"), F.least("y1", "y2"), F.greatest("y1", "y2"), cell, reach)


def _ring_side(k: Column) -> tuple[Column, Column]:
    n = F.size("ring")
    return F.element_at("ring", (k + 1).cast("int")), F.element_at("ring", (F.pmod(k + 1, n) + 1).cast("int"))


def _odd(px: Column, py: Column) -> Column:
    """Is the point inside the column ring, by the number of sides that a ray to the right crosses?"""

    def crossing(k: Column) -> Column:
        p, q = _ring_side(k)
        spans = (p["y"] > py) != (q["y"] > py)
        return F.when(spans & (px < (q["x"] - p["x"]) * (py - p["y"]) / (q["y"] - p["y"]) + p["x"]), 1).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.size("ring") - 1), F.lit(0), lambda acc, k: acc + crossing(k)) % 2 == 1


def union_outline(stands: DataFrame, ring: str = "ring", cell: float = 50.0) -> DataFrame:
    """The outline of the union of the polygons: sides (x1, y1, x2, y2), each with the inside on its
    left.

    Noding in grid cells: sides of different polygons meet in the cells of their boxes and are cut
    where they cross, touch or run along one another. A piece goes if its middle lies strictly inside
    another polygon. Pieces that lie on one another are one if they run the same way, and none if
    both ways occur, since then the inside is on both sides. All joins are equi-joins on cells, so
    the work follows the number of sides that are near each other.
    """
    polygons = stands.select(F.monotonically_increasing_id().alias("s"), F.col(ring).alias("ring")).where(F.size(ring) > 2)
    polygons = cut(polygons, "polygons")
    twice = F.aggregate(F.sequence(F.lit(0), F.size("ring") - 1), F.lit(0.0), lambda acc, k: acc + _ring_side(k)[0]["x"] * _ring_side(k)[1]["y"] - _ring_side(k)[1]["x"] * _ring_side(k)[0]["y"])
    turned = polygons.select("s", F.when(twice < 0, F.reverse("ring")).otherwise(F.col("ring")).alias("ring"))
    p, q = _ring_side(F.col("k"))
    sides = turned.select("s", "ring", F.explode(F.sequence(F.lit(0), F.size("ring") - 1)).alias("k")).select("s", "k", p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")).where("x1 <> x2 or y1 <> y2")
    sides = cut(sides, "sides")
    near = _side_cells(sides, cell, SAME)
    other = near.select("gx", "gy", *(F.col(c).alias(f"o{c}") for c in sides.columns))
    x, y = {c: F.col(c) for c in ("x1", "x2", "ox1", "ox2")}, {c: F.col(c) for c in ("y1", "y2", "oy1", "oy2")}
    rx, ry, sx, sy = x["x2"] - x["x1"], y["y2"] - y["y1"], x["ox2"] - x["ox1"], y["oy2"] - y["oy1"]
    dx, dy = x["ox1"] - x["x1"], y["oy1"] - y["y1"]
    turn, off, length = rx * sy - ry * sx, dx * ry - dy * rx, rx * rx + ry * ry
    size = F.sqrt(length * (sx * sx + sy * sy))
    along = F.abs(turn) <= SAME * size
    t, u = (dx * sy - dy * sx) / turn, off / turn
    crossing = F.when(~along & (u >= -SAME) & (u <= 1 + SAME), F.array(t))
    # parallel sides on one line: where the other begins and ends
    running = F.when(along & (F.abs(off) <= SAME * length), F.array((dx * rx + dy * ry) / length, ((dx + sx) * rx + (dy + sy) * ry) / length))
    met = near.join(other, ["gx", "gy"]).where("s <> os").select("s", "k", F.explode(F.coalesce(crossing, running)).alias("t")).where((F.col("t") > SAME) & (F.col("t") < 1 - SAME))
    cuts = met.select("s", "k", F.round("t", 9).alias("t")).groupBy("s", "k").agg(F.sort_array(F.collect_set("t")).alias("t"))
    line = sides.join(cuts, ["s", "k"], "left").withColumn("t", F.concat(F.array(F.lit(0.0)), F.coalesce("t", F.array().cast("array<double>")), F.array(F.lit(1.0))))
    ends = line.select("s", "k", "x1", "y1", "x2", "y2", "t", F.explode(F.sequence(F.lit(1), F.size("t") - 1)).alias("j"))
    spot = lambda c, k: F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * F.element_at("t", k)
    pieces = ends.select("s", F.struct("k", "j").alias("piece"), *(spot(c, F.col("j") + e).alias(f"{c}{e + 1}") for e in (0, 1) for c in "xy"))
    pieces = cut(pieces.withColumns({"px": (F.col("x1") + F.col("x2")) / 2, "py": (F.col("y1") + F.col("y2")) / 2}), "pieces")
    middle = pieces.select("s", "piece", "px", "py", F.floor(F.col("px") / cell).alias("gx"), F.floor(F.col("py") / cell).alias("gy"))
    boxed = _box_cells(turned, cell).select(F.col("s").alias("os"), "ring", "gx", "gy")
    gap = F.array_min(F.transform(F.sequence(F.lit(0), F.size("ring") - 1), lambda k: _gap2(F.col("px"), F.col("py"), *_ring_side(k))))
    hidden = middle.join(boxed, ["gx", "gy"]).where("s <> os").where(_odd(F.col("px"), F.col("py"))).where(gap > 1e-12).select("s", "piece").distinct()
    shown = pieces.join(hidden, ["s", "piece"], "left_anti")
    key = lambda c: F.round(c, 6) + 0.0
    forward = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") < F.col("y2")))
    ends = F.when(forward, F.array(*map(key, ("x1", "y1", "x2", "y2")))).otherwise(F.array(*map(key, ("x2", "y2", "x1", "y1"))))
    one = shown.groupBy(ends.alias("__ends")).agg(F.min(forward).alias("low"), F.max(forward).alias("high"), F.min(F.struct("x1", "y1", "x2", "y2")).alias("side"))
    return one.where("low = high").select("side.*")


def _gap2(px: Column, py: Column, p: Column, q: Column) -> Column:
    """Squared distance of a point to the side from p to q."""
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    length = F.greatest(dx * dx + dy * dy, F.lit(1e-300))
    t = F.least(F.greatest(((px - p["x"]) * dx + (py - p["y"]) * dy) / length, F.lit(0.0)), F.lit(1.0))
    return (px - p["x"] - t * dx) ** 2 + (py - p["y"] - t * dy) ** 2


def _side_distance2(px: Column, py: Column) -> Column:
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.least(F.greatest(((px - F.col("x1")) * dx + (py - F.col("y1")) * dy) / (dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0))
    return (px - F.col("x1") - t * dx) ** 2 + (py - F.col("y1") - t * dy) ** 2


def inside_stands(points: DataFrame, stands: DataFrame, buffer: float = -2.0, cell: float = 50.0, id_col: str = "id", x: str = "x", y: str = "y", ring: str = "ring") -> DataFrame:
    """Adds in_stands (0 or 1): is the point strictly inside the union of the stands, shrunk
    (buffer < 0) or grown (buffer > 0) by the buffer. Stands may overlap, touch or hold one another.

    Stands and points meet in grid cells: a polygon is entered in the cells of its bounding box, the
    sides of the union's outline in the cells within reach of them, so both joins are equi-joins.
    """
    reach = abs(buffer)
    pts = points.select(F.col(id_col).alias("__id"), F.col(x).alias("__x"), F.col(y).alias("__y"))
    pts = pts.withColumns({"gx": F.floor(F.col("__x") / cell), "gy": F.floor(F.col("__y") / cell)})
    boxed = _box_cells(stands.select(F.col(ring).alias("ring")), cell)
    within = pts.join(boxed, ["gx", "gy"]).where(_odd(F.col("__x"), F.col("__y"))).select("__id").distinct().withColumn("__in", F.lit(1))
    near = _side_cells(union_outline(stands, ring, cell), cell, reach)
    touched = pts.join(near, ["gx", "gy"]).groupBy("__id").agg(F.min(_side_distance2(F.col("__x"), F.col("__y"))).alias("__d2"))
    out = points.join(within, F.col(id_col) == F.col("__id"), "left").drop("__id").join(touched, F.col(id_col) == F.col("__id"), "left").drop("__id")
    deep = F.coalesce(F.sqrt("__d2"), F.lit(float("inf")))
    member = F.col("__in").isNotNull()
    flag = member & (deep > reach) if buffer < 0 else (member & (deep > 0)) if buffer == 0 else member | (deep <= reach)
    return out.withColumn("in_stands", flag.cast("int")).drop("__in", "__d2")


def height_near(points: DataFrame, heights: DataFrame, radius_px: int, out: str = "height_m", id_col: str = "id", row: str = "hr", col: str = "hc", value: str = "h") -> DataFrame:
    """Adds the largest height in the square of ``radius_px`` cells around each point's cell (row,
    col); null where there is none. Points and heights meet in blocks of the square's size, of which
    a point looks into four at most; heights of blocks without points go before their shuffle."""
    side = 2 * radius_px + 1
    block = lambda c: F.floor(c / side).cast("long")
    span = lambda c: F.sequence(block(F.col(c) - radius_px), block(F.col(c) + radius_px))
    seek = points.select(F.col(id_col).alias("__id"), F.col(row).alias("__r"), F.col(col).alias("__c")).where("__r is not null and __c is not null")
    seek = seek.withColumn("__i", F.explode(span("__r"))).withColumn("__j", F.explode(span("__c")))
    known = heights.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select("r", "c", value, block(F.col("r")).alias("__i"), block(F.col("c")).alias("__j"))
    known = known.join(seek.select("__i", "__j").distinct(), ["__i", "__j"], "left_semi")
    near = (F.abs(F.col("r") - F.col("__r")) <= radius_px) & (F.abs(F.col("c") - F.col("__c")) <= radius_px)
    top = seek.join(known, ["__i", "__j"]).where(near).groupBy("__id").agg(F.max(value).alias(out))
    return points.join(top, F.col(id_col) == F.col("__id"), "left").drop("__id")


def heights_at(points: DataFrame, raster: tuple, radius_m: float, out: str, id_col: str = "id", x: str = "x", y: str = "y", crs: str = "") -> DataFrame:
    """Adds the largest height within ``radius_m`` of each point from a raster (scene, heights) with
    a grid and a coordinate system of its own; ``crs`` is that of the points."""
    scene, heights = raster
    hr, hc = scene.affine.to_pixel(*transform(F.col(x), F.col(y), crs, scene.crs))
    placed = points.withColumns({"__hr": F.floor(hr).cast("int"), "__hc": F.floor(hc).cast("int")})
    return height_near(placed, heights, radius_cells(radius_m, scene.a), out, id_col, "__hr", "__hc").drop("__hr", "__hc")


def radius_cells(radius_m: float, cell_m: float) -> int:
    """Half-even rounding of the radius in cells."""
    return int(round(radius_m / abs(cell_m)))


def surface_height(points: DataFrame, dsm: DataFrame, dtm: DataFrame, radius_px: int, out: str = "height_m", **names) -> DataFrame:
    """Adds the surface maximum near the point less the terrain under it; null if either is."""
    both = height_near(height_near(points, dsm, radius_px, "__top", **names), dtm, 0, "__ground", **names)
    return both.withColumn(out, F.col("__top") - F.col("__ground")).drop("__top", "__ground")


def drop_low(points: DataFrame, min_height: float, column: str = "height_m") -> DataFrame:
    """Points not known to be lower than the gate."""
    return points.where(F.col(column).isNull() | ~(F.col(column) < min_height))


def column_gaps(rows: np.ndarray, cols: np.ndarray, wanted: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Distance along the column to the nearest missing cell, for the wanted rows (ascending) and all
    columns 0..n-1. rows, cols: the missing cells; first and last: the nearest missing row below and
    above what is given here, -inf and inf where there is none."""
    n = len(first)
    order = np.lexsort((rows, cols))
    rows, cols = rows[order].astype(np.float64), cols[order]
    # one sorted line of all columns, each with its first and last row at the ends
    start = np.searchsorted(cols, np.arange(n))
    line = np.insert(rows, np.concatenate([start, np.append(start[1:], len(rows))]), np.concatenate([first, last]))
    column = np.insert(cols, np.concatenate([start, np.append(start[1:], len(rows))]), np.concatenate([np.arange(n)] * 2))
    order = np.lexsort((line, column))
    line, column = line[order], column[order]
    begin = np.searchsorted(column, np.arange(n))
    out = np.empty((len(wanted), n))
    for k, r in enumerate(wanted):
        below = np.concatenate([[0], np.cumsum(line <= r)])
        at = begin + (below[np.append(begin[1:], len(line))] - below[begin]) - 1
        out[k] = np.minimum(r - line[np.maximum(at, begin)], np.abs(line[np.minimum(at + 1, np.append(begin[1:], len(line)) - 1)] - r))
    return np.abs(out)


def nearest_in_row(gaps: np.ndarray, col: int, most: float) -> float:
    """Distance from a row's cell to the nearest missing cell of all rows, from the distances along
    columns; ``most`` where that is nearer."""
    a, b = max(0, col - int(most)), min(len(gaps), col + int(most) + 1)
    return float(min(most, np.sqrt((gaps[a:b] ** 2 + (np.arange(a, b) - col) ** 2.0).min(initial=np.inf))))


def nodata_distance(points: DataFrame, missing: DataFrame, height: int, width: int, band: int = 512, strip: int = 1024, id_col: str = "id", row: str = "r", col: str = "c", out: str = "edge_px") -> DataFrame:
    """Adds the Euclidean distance in pixels from each point's pixel to the nearest missing pixel or
    to just outside the window, whichever is nearer.

    A distance transform in its two separable steps. Along columns: the scene is cut into tiles of
    ``band`` rows and ``strip`` columns; a tile knows its missing pixels and, for each column, the
    nearest missing row above and below, which the bands pass on as one row a column; it gives the
    distances along columns for the rows that hold points. Along rows: a row's strips make its
    distances whole, and each point takes the least over the columns that can matter to it. A task
    holds a tile or a row; the work follows the scene's size, not how much is missing or where.
    """
    edge = F.least(F.col(row) + 1, F.lit(height) - F.col(row), F.col(col) + 1, F.lit(width) - F.col(col)).cast("double")
    seek = points.select(F.col(id_col).alias("__id"), F.col(row).cast("int").alias("__r"), F.col(col).cast("int").alias("__c"), edge.alias("__e"))
    bands, strips = -(-height // band), -(-width // strip)
    spot = [F.floor(F.col("__r") / band).cast("int").alias("b"), F.floor(F.col("__c") / strip).cast("int").alias("s")]
    gaps = missing.select(F.col("r").cast("int").alias("__r"), F.col("c").cast("int").alias("__c")).select("*", *spot)
    ends = gaps.groupBy("b", "__c").agg(F.min("__r").alias("low"), F.max("__r").alias("high"))
    # every band of every column that misses anything: the last missing row above, the first below
    full = ends.select("__c").distinct().withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))).join(ends, ["b", "__c"], "left")
    by = Window.partitionBy("__c").orderBy("b")
    passed = full.select("b", "__c", F.max("high").over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("above"), F.min("low").over(by.rowsBetween(1, Window.unboundedFollowing)).alias("below"))
    null = lambda *names: [F.lit(None).cast("int").alias(n) for n in names]
    told = gaps.select("b", "s", "__r", "__c", *null("above", "below")).unionByName(passed.select("b", F.floor(F.col("__c") / strip).cast("int").alias("s"), *null("__r"), "__c", "above", "below"))
    asked = seek.select("__r").distinct().withColumns({"b": F.floor(F.col("__r") / band).cast("int"), "s": F.explode(F.sequence(F.lit(0), F.lit(strips - 1)))})

    def along_columns(tile: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"r": [], "s": [], "gaps": []})
        s, wanted = int(rows["s"].iloc[0]), np.sort(rows["__r"].to_numpy())
        n = min(strip, width - s * strip)
        first, last = np.full(n, -np.inf), np.full(n, np.inf)
        ends, here = tile[tile["__r"].isna()], tile[tile["__r"].notna()]
        at = ends["__c"].to_numpy(np.int64) - s * strip
        first[at], last[at] = ends["above"].fillna(-np.inf), ends["below"].fillna(np.inf)
        found = column_gaps(here["__r"].to_numpy(np.int64), here["__c"].to_numpy(np.int64) - s * strip, wanted, first, last)
        return pd.DataFrame({"r": wanted, "s": s, "gaps": [g.tobytes() for g in found]})

    def along_rows(strips: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        whole = np.concatenate([np.frombuffer(g) for g in strips.sort_values("s")["gaps"]]) if len(strips) else np.full(width, np.inf)
        found = [nearest_in_row(whole, int(c), float(e)) for c, e in zip(asked["__c"], asked["__e"], strict=True)]
        return pd.DataFrame({"__id": asked["__id"], out: found})

    kind = points.schema[id_col].dataType.simpleString()
    columns = told.groupBy("b", "s").cogroup(asked.groupBy("b", "s")).applyInPandas(along_columns, "r int, s int, gaps binary")
    found = columns.groupBy("r").cogroup(seek.groupBy("__r")).applyInPandas(along_rows, f"__id {kind}, {out} double")
    return points.join(found, F.col(id_col) == F.col("__id"), "left").drop("__id")
