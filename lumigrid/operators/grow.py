"""Growing seeds into regions, filling holes, and turning regions into polygons."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigrid.operators.modes import GrowRecipe
from lumigrid.operators.tiles import to_halos


def grow_array(stack: np.ndarray, valid: np.ndarray, seeds: np.ndarray, recipe: GrowRecipe) -> np.ndarray:
    """Labels (index of the seed, -1 elsewhere). Costs are the largest distance to the seed's own
    features on the way (8 neighbours); pixels are settled in the order of (cost, seed, row, col).

    Rule "reach": a seed may take a pixel only within its radius and its tolerance, which falls by
    the taper towards the radius. Rule "partition": every pixel goes to the seed of the least cost
    without limits, and tolerance and radius are cut afterwards.
    """
    bands, h, w = stack.shape
    weights = np.ones(bands) if recipe.band_weights is None else np.asarray(recipe.band_weights, float)
    if weights.shape != (bands,):
        raise ValueError(f"{bands} band weights are needed, got {len(weights)}")
    ok = valid & np.isfinite(stack).all(axis=0)
    # one margin of closed pixels all round, so that a place and eight offsets are all that is needed
    wide = w + 2
    closed = np.ones((h + 2, wide), np.uint8)
    closed[1:-1, 1:-1] = ~ok
    values = np.zeros((bands, h + 2, wide))
    values[:, 1:-1, 1:-1] = np.where(ok, stack, 0) * weights[:, None, None]
    cost, owner = np.full((h + 2) * wide, np.inf), np.full((h + 2) * wide, -1, np.int64)
    shut, price, taken = memoryview(closed.reshape(-1)), memoryview(cost), memoryview(owner)
    planes = [memoryview(np.ascontiguousarray(v.reshape(-1))) for v in values]
    around = [dr * wide + dc for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc]

    places = np.asarray(seeds, int).reshape(-1, 2)
    inside = ((places >= 0) & (places < (h, w))).all(axis=1)
    at = np.where(inside, (places[:, 0] + 1) * wide + places[:, 1] + 1, 0)
    queue = []
    for s in np.flatnonzero(inside).tolist():
        p = int(at[s])
        if not shut[p] and price[p] > 0.0:  # of seeds on one pixel the first has it
            price[p], taken[p] = 0.0, s
            queue.append((0.0, s, p))
    heapq.heapify(queue)
    own = [[v[int(p)] for v in planes] for p in at]
    bounded = recipe.rule == "reach"
    reach2, fall = recipe.max_radius**2, recipe.taper / recipe.max_radius if recipe.max_radius else 0.0
    while queue:
        paid, s, p = heapq.heappop(queue)
        if shut[p] or taken[p] != s or paid > price[p]:
            continue
        shut[p] = 1
        colour, (seed_row, seed_col) = own[s], divmod(int(at[s]), wide)
        for step in around:
            q = p + step
            if shut[q]:
                continue
            most = recipe.max_cost
            if bounded:
                row, col = divmod(q, wide)
                away2 = (row - seed_row) ** 2 + (col - seed_col) ** 2
                if away2 > reach2:
                    continue
                most -= fall * math.sqrt(away2)
            due = max(paid, math.dist([v[q] for v in planes], colour))
            if due < price[q] and not (bounded and due > most):
                price[q], taken[q] = due, s
                heapq.heappush(queue, (due, s, q))
    out, paid = (x.reshape(h + 2, wide)[1:-1, 1:-1].copy() for x in (owner, cost))
    if not bounded:
        rr, cc = np.nonzero(out >= 0)
        far = ((np.column_stack([rr, cc]) - places[out[rr, cc]]) ** 2).sum(axis=1) > reach2
        gone = far | (paid[rr, cc] > recipe.max_cost)
        out[rr[gone], cc[gone]] = -1
    return fill_holes(out, ok) if recipe.fill_holes else out


def fill_holes(labels: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Unassigned valid pixels that one region encloses go to it."""
    out = labels.copy()
    for s in np.unique(labels[labels >= 0]):
        rr, cc = np.nonzero(labels == s)
        r0, r1, c0, c1 = rr.min(), rr.max() + 1, cc.min(), cc.max() + 1
        own = labels[r0:r1, c0:c1] == s
        h, w = own.shape
        outside = np.zeros((h + 2, w + 2), bool)
        solid = np.pad(own, 1)
        stack = [(0, 0)]
        outside[0, 0] = True
        while stack:
            r, c = stack.pop()
            for a, b in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                if 0 <= a < h + 2 and 0 <= b < w + 2 and not outside[a, b] and not solid[a, b]:
                    outside[a, b] = True
                    stack.append((a, b))
        hole = ~outside[1:-1, 1:-1] & ~own & (labels[r0:r1, c0:c1] < 0) & valid[r0:r1, c0:c1]
        out[r0:r1, c0:c1][hole] = s
    return out


def grow_seeds(pixels: DataFrame, seeds: DataFrame, features: Sequence[str], recipe: GrowRecipe, height: int, width: int, rows: int, cols: int, clip_to_core: bool = False, prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Label rows (gid, r, c) from seeds (gid, r, c). Cores with seeds are grown with a halo, in which
    all seeds compete; a seed's region is taken from its own core's window, whole (clip_to_core
    keeps only the pixels inside the core). ``prepare`` makes the features from the pixels of windows
    (keyed by core_id) where they depend on the window. Pixels and seeds are copied into the windows that hold
    them and met per core in one task of bounded size."""
    from lumigrid.operators.tiles import halo_px

    halo = halo_px(recipe.max_radius)
    named = seeds.select("gid", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c")).where(f"r >= 0 and r < {height} and c >= 0 and c < {width}")
    near = to_halos(named, rows, cols, height, width, halo)
    used = near.where("in_core").select("core_id").distinct()
    near = near.join(used, "core_id", "left_semi")
    made = lambda frame: frame.select(*(c for c in ("core_id", "in_core") if c in frame.columns), "r", "c", "valid", *(F.col(f).cast("double").alias(f"__f{k}") for k, f in enumerate(features)))
    # only windows with seeds are built: the pruning comes before the kernel's shuffle
    windows = to_halos(pixels if prepare else made(pixels), rows, cols, height, width, halo).join(used, "core_id", "left_semi")
    windows = made(prepare(windows)) if prepare else windows
    names = [f"__f{k}" for k in range(len(features))]

    def run(px: pd.DataFrame, sd: pd.DataFrame) -> pd.DataFrame:
        if not len(px) or not len(sd):
            return pd.DataFrame({"gid": pd.Series(dtype="int64"), "r": pd.Series(dtype="int32"), "c": pd.Series(dtype="int32")})
        r0, c0 = px["r"].min(), px["c"].min()
        h, w = int(px["r"].max() - r0) + 1, int(px["c"].max() - c0) + 1
        at = (px["r"].to_numpy() - r0, px["c"].to_numpy() - c0)
        stack, valid, core = np.full((len(names), h, w), np.nan), np.zeros((h, w), bool), np.zeros((h, w), bool)
        for k, n in enumerate(names):
            stack[k][at] = px[n]
        valid[at] = px["valid"].fillna(False)
        core[at] = px["in_core"]
        sd = sd.sort_values("gid")
        label = grow_array(stack, valid, np.column_stack([sd["r"] - r0, sd["c"] - c0]), recipe)
        keep = (label >= 0) & sd["in_core"].to_numpy()[np.maximum(label, 0)]
        if clip_to_core:
            keep &= core
        rr, cc = np.nonzero(keep)
        return pd.DataFrame({"gid": sd["gid"].to_numpy()[label[rr, cc]], "r": (rr + r0).astype("int32"), "c": (cc + c0).astype("int32")})

    return windows.groupBy("core_id").cogroup(near.groupBy("core_id")).applyInPandas(run, "gid bigint, r int, c int")


def crown_statistics(labels: DataFrame, pixel_area: float) -> DataFrame:
    """(adaptel_id, n_px, area_m2, perimeter) per region; the perimeter is that of a circle."""
    from lumigrid.functions.pixel import equivalent_perimeter

    out = labels.groupBy(F.col("gid").alias("adaptel_id")).agg(F.count("*").alias("n_px"))
    return out.withColumn("area_m2", F.col("n_px") * pixel_area).withColumn("perimeter", equivalent_perimeter(F.col("area_m2")))


def label_raster(grid: DataFrame, labels: DataFrame) -> DataFrame:
    """(r, c, gid) for every pixel of the grid, -1 where no region is."""
    return grid.select("r", "c").join(labels, ["r", "c"], "left").withColumn("gid", F.coalesce("gid", F.lit(-1).cast("long")))


def rings_of(cells: set[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Closed boundary rings of a set of (row, col) cells in corner coordinates (col, row); outer
    rings run one way round, holes the other. Corners that touch stay apart."""
    out_of: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r, c in cells:
        for (dr, dc), a, b in (((-1, 0), (c, r), (c + 1, r)), ((0, 1), (c + 1, r), (c + 1, r + 1)), ((1, 0), (c + 1, r + 1), (c, r + 1)), ((0, -1), (c, r + 1), (c, r))):
            if (r + dr, c + dc) not in cells:
                out_of.setdefault(a, []).append(b)
    rings = []
    while out_of:
        start = min(out_of)
        ring, at, came = [start], start, None
        while True:
            ways = out_of[at]
            if len(ways) > 1 and came is not None:  # keep to the same cell: turn right
                ways.sort(key=lambda b: (b[0] - at[0]) * came[1] - (b[1] - at[1]) * came[0])
            nxt = ways.pop(0)
            if not ways:
                del out_of[at]
            came = (nxt[0] - at[0], nxt[1] - at[1])
            at = nxt
            if at == start:
                break
            ring.append(at)
        slim = [p for k, p in enumerate(ring) if (p[0] - ring[k - 1][0]) * (ring[(k + 1) % len(ring)][1] - p[1]) != (p[1] - ring[k - 1][1]) * (ring[(k + 1) % len(ring)][0] - p[0])]
        rings.append([*slim, slim[0]])
    return rings


def parts_of(cells: set[tuple[int, int]]) -> list[set[tuple[int, int]]]:
    """8-connected components."""
    left, out = set(cells), []
    while left:
        stack, part = [left.pop()], set()
        while stack:
            r, c = stack.pop()
            part.add((r, c))
            for q in ((r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                if q in left:
                    left.remove(q)
                    stack.append(q)
        out.append(part)
    return sorted(out, key=min)


def polygonize(labels: DataFrame, a: float = 1.0, c: float = 0.0, e: float = 1.0, f: float = 0.0) -> DataFrame:
    """(adaptel_id, n_parts, wkt): a MULTIPOLYGON of each region's outline in map coordinates.
    n_parts counts 8-connected parts. A region is bounded by its growing radius; regions follow each
    other in a task, which holds the pixels of one."""

    def outline(cells: set[tuple[int, int]]) -> tuple[int, str]:
        parts = parts_of(cells)
        shapes = []
        for part in parts:
            rings = rings_of(part)
            area = [sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(r, r[1:], strict=False)) for r in rings]
            text = ["(" + ", ".join(f"{c + x * a:.10g} {f + y * e:.10g}" for x, y in r) + ")" for r in rings]
            outer, inner = [k for k, s in enumerate(area) if s > 0], [k for k, s in enumerate(area) if s < 0]
            for k in outer:  # a hole belongs to the smallest outer ring around it
                mine = [i for i in inner if _holds(rings[k], rings[i][0]) and all(j == k or area[j] >= area[k] or not _holds(rings[j], rings[i][0]) for j in outer)]
                shapes.append("(" + ", ".join([text[k], *(text[i] for i in mine)]) + ")")
        return len(parts), "MULTIPOLYGON (" + ", ".join(shapes) + ")"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gid, cells, done = None, set(), []

        def outlines() -> pa.RecordBatch:
            kinds = {"adaptel_id": pa.int64(), "n_parts": pa.int32(), "wkt": pa.string()}
            return pa.RecordBatch.from_arrays([pa.array([row[k] for row in done], t) for k, t in enumerate(kinds.values())], names=list(kinds))

        for batch in batches:
            for g, row, col in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if g != gid:
                    if cells:
                        done.append((gid, *outline(cells)))
                    gid, cells = g, set()
                cells.add((row, col))
            yield outlines()
            done.clear()
        if cells:
            done.append((gid, *outline(cells)))
            yield outlines()

    named = labels.select(F.col("gid").cast("long").alias("gid"), "r", "c")
    return named.repartition("gid").sortWithinPartitions("gid").mapInArrow(run, "adaptel_id bigint, n_parts int, wkt string")


def _holds(ring: list[tuple[int, int]], point: tuple[int, int]) -> bool:
    """Is the middle of the cell right below the point's corner inside the ring?"""
    x, y, odd = point[0] + 0.5, point[1] + 0.5, False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd
