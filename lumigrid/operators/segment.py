"""Superpixel segmentation of tiles by growing from seeds, as a grouped kernel on arrays.

The rule. Costs are whole numbers; ``LEVELS`` of them make up the granularity. A segment has the
values of its seed pixel. To step from a pixel to one of its four neighbours costs the neighbour's
distance from those values, in levels, one at least; a pixel goes to the segment of the least total
cost below ``LEVELS`` (ties: the smaller seed, in row-major order), and only passes on the segment
that it went to. Seeds are set in rounds: in each square of ``SPACING`` pixels, then half of that,
and so on down to one, the free pixel nearest to the square's middle (ties: row, column) is a seed,
and segments of a round only take pixels that earlier rounds left. So segments are as large as the
spacing where a tile is even, and small where it is not; every valid pixel gets one.

All pixels whose cost is c are final once costs below c are done, as a step costs one at least, and
are taken together: a bucket queue over the levels, whose buckets are arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS, SPACING = 255, 16


def round_seeds(free: np.ndarray, side: int) -> np.ndarray:
    """Flat indices, ascending, of the free pixel nearest to the middle of each square."""
    h, w = free.shape
    at = np.flatnonzero(free)
    r, c = (at // w).astype(np.int64), (at % w).astype(np.int64)
    away = (2 * (r % side) - side + 1) ** 2 + (2 * (c % side) - side + 1) ** 2
    square = r // side * (-(-w // side)) + c // side
    order = np.lexsort((at, away, square))
    first = np.append(True, np.diff(square[order]) != 0) if len(at) else np.zeros(0, bool)
    return np.sort(at[order[first]])


def segment_array(stack: np.ndarray, valid: np.ndarray, granularity: float, spacing: int = SPACING) -> np.ndarray:
    """Labels (rows x cols, int32) from 0 in the order of seeds, -1 on invalid pixels."""
    bands, h, w = stack.shape
    flat = np.ascontiguousarray(stack.reshape(bands, -1).T, np.float32)
    unit = np.float32(granularity / LEVELS)
    owner = np.full(h * w, -1, np.int32)
    cost = np.full(h * w, LEVELS, np.int16)
    free = valid.ravel().copy()
    seeds_of, side = [], spacing
    while free.any():
        seeds = round_seeds(free.reshape(h, w), side)
        seeds_of.append(seeds)
        owner[seeds], cost[seeds] = seeds, 0
        buckets: list[list[np.ndarray]] = [[] for _ in range(LEVELS)]
        buckets[0].append(seeds)
        for level in range(LEVELS):
            if not buckets[level]:
                continue
            # a pixel may wait in the bucket of a cost that it no longer has
            p = np.unique(np.concatenate(buckets[level]))
            buckets[level] = []
            p = p[(cost[p] == level) & free[p]]
            free[p] = False
            r, c = p // w, p % w
            for shift, inside in ((-w, r > 0), (-1, c > 0), (1, c + 1 < w), (w, r + 1 < h)):
                q, s = p[inside] + shift, owner[p[inside]]
                on = free[q]
                q, s = q[on], s[on]
                step = np.sqrt(((flat[q] - flat[s]) ** 2).sum(axis=1)) / unit
                new = level + np.maximum(np.ceil(np.minimum(step, LEVELS)), 1).astype(np.int64)
                on = (new < LEVELS) & ((new < cost[q]) | ((new == cost[q]) & (s < owner[q])))
                q, s, new = q[on], s[on], new[on]
                cost[q], owner[q] = new, s
                order = np.argsort(new, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(new[order])) + 1) if len(order) else ():
                    buckets[int(new[part[0]])].append(q[part])
        side = max(1, side // 2)
    rank = np.full(h * w, -1, np.int32)
    seeds = np.concatenate(seeds_of) if seeds_of else np.zeros(0, np.int64)
    rank[seeds] = np.arange(len(seeds), dtype=np.int32)
    return np.where(owner >= 0, rank[owner], -1).reshape(h, w).astype(np.int32)


def segment_tiles(tiled: DataFrame, bands: Sequence[str], granularity: float, keys: Sequence[str] = ("tile_id",), row: str = "tr", col: str = "tc") -> DataFrame:
    """Adds seg to the pixels of each tile (null where invalid). A tile is one task's arrays, about
    60 bytes a pixel of four bands beside the batch; tiles have a fixed size, so a task does not grow
    with the scene."""
    slim = tiled.select(*keys, row, col, F.coalesce("valid", F.lit(False)).alias("valid"), *(F.coalesce(F.col(b).cast("float"), F.lit(0).cast("float")).alias(f"__b{k}") for k, b in enumerate(bands)))
    schema = ", ".join(f"{k} {tiled.schema[k].dataType.simpleString()}" for k in (*keys, row, col)) + ", seg int"

    def run(table):
        r, c = (table[n].to_numpy().astype(np.int32) for n in (row, col))
        h, w = int(r.max()) + 1, int(c.max()) + 1
        at = r * w + c
        stack, valid = np.zeros((len(bands), h * w), np.float32), np.zeros(h * w, bool)
        for k in range(len(bands)):
            stack[k][at] = table[f"__b{k}"].to_numpy()
        valid[at] = table["valid"].to_numpy(zero_copy_only=False)
        label = segment_array(stack.reshape(-1, h, w), valid.reshape(h, w), granularity).ravel()[at]
        return pa.table([*(table[n] for n in (*keys, row, col)), pa.array(label, mask=label < 0)], names=[*keys, row, col, "seg"])

    labels = slim.groupBy(*keys).applyInArrow(run, schema)
    return tiled.drop("seg").join(labels, [*keys, row, col])


def block_segments(tiled: DataFrame, size: int, across: int = 100, row: str = "r", col: str = "c") -> DataFrame:
    """Adds seg by square blocks of pixels (null where invalid): a deterministic stand-in for the
    kernel that SQL can express."""
    seg = F.floor(F.col(row) / size) * across + F.floor(F.col(col) / size)
    return tiled.withColumn("seg", F.when(F.col("valid"), seg.cast("int")))
