"""Outlines of regions of any extent, such as regions wider than a tile.

A region's boundary is a set of directed pixel sides with the region on their right. Which side
follows a side is decided by three pixels around its end: without the pixel ahead the same pixel's
next side, with it the pixel ahead's side, or, where the one beyond the boundary is set too, that
one's. Pixels that only touch at corners stay apart. Tiles chain their own sides to paths, in one
task of bounded size each; the paths of a ring over several tiles are a cycle of a table with a row
for each path, which pointer jumping numbers in as many rounds as the cycle's length has bits.

Labels are rows (gid, r, c) with r and c from 0; rows with a null are left out, repeated rows count
once, no rows give no outlines. Regions may overlap: a tile's task holds its pixels once for each
region that has them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigrid.operators.components import cut, settle

#: Steps (row, column) along the top, right, bottom and left side of a pixel; the outside of a side
#: lies in the step of the side before.
AHEAD = np.array([(0, 1), (1, 0), (0, -1), (-1, 0)])
#: Corner (row, column) of the pixel where each of the sides ends.
ENDS = np.array([(0, 1), (1, 1), (1, 0), (0, 0)])
_PATH = "gid bigint, a bigint, b bigint, sides bigint, area bigint, xs array<int>, ys array<int>"


def _jumps(follows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For lists given by each node's successor (their number: none): the node after the last jump,
    the smallest node met, the list's last node, and the nodes left in the list."""
    n = len(follows)
    at, low, last = np.append(follows, n), np.arange(n + 1), np.arange(n + 1)
    left = np.append(np.ones(n, np.int64), 0)
    for _ in range(n.bit_length()):
        low = np.minimum(low, low[at])
        last = np.where(at < n, last[at], last)
        left = left + left[at]
        at = at[at]
    return at[:-1], low[:-1], last[:-1], left[:-1]


def tile_paths(gid: np.ndarray, r: np.ndarray, c: np.ndarray, top: int, left: int, tile: int) -> dict[str, object]:
    """Paths of the sides that pixels of the tile at (top, left) own, from pixels of the tile and a
    margin of one. ``a`` names a path's first side and ``b`` the side after its last: its own first
    where the path is closed."""
    regions, own = np.unique(gid, return_inverse=True)
    wide = tile + 4
    pixel = np.unique((own * wide + (r - top + 1)) * wide + (c - left + 1))
    row, col = pixel // wide % wide, pixel % wide
    core = (row >= 1) & (row <= tile) & (col >= 1) & (col <= tile)

    def find(key: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(pixel, key), len(pixel) - 1)
        return np.where(pixel[at] == key, at, -1)

    step = AHEAD[:, 0] * wide + AHEAD[:, 1]
    inner = np.flatnonzero(core)
    node = np.sort(np.concatenate([inner[find(pixel[inner] + step[d - 1]) < 0] * 4 + d for d in range(4)]))
    p, d = node // 4, node % 4
    ahead, beyond = find(pixel[p] + step[d]), find(pixel[p] + step[d] + step[d - 1])
    straight, inward = (ahead >= 0) & (beyond < 0), (ahead >= 0) & (beyond >= 0)
    to = np.where(inward, beyond, np.where(straight, ahead, p))
    turn = np.where(inward, (d + 3) % 4, np.where(straight, d, (d + 1) % 4))
    follows = np.where(core[to], np.searchsorted(node, to * 4 + turn), len(node))

    at, low, _, _ = _jumps(follows)
    follows[(at < len(node)) & (follows == low)] = len(node)  # rings inside the tile begin at their first side
    _, _, last, rest = _jumps(follows)
    order = np.lexsort((-rest, last))
    begin = np.flatnonzero(np.append(True, last[order][1:] != last[order][:-1])) if len(order) else np.zeros(0, np.int64)
    close = np.append(begin[1:], len(order))[: len(begin)]  # tiles may have pixels and no sides

    def name(pixels: np.ndarray, sides: np.ndarray) -> np.ndarray:
        return ((row[pixels] - 1 + top) << 32) | ((col[pixels] - 1 + left) << 2) | sides

    y, x = row[p] - 1 + top + ENDS[d, 0], col[p] - 1 + left + ENDS[d, 1]
    corner = (turn != d)[order]
    offsets = np.append(0, np.cumsum(corner))[np.append(begin, len(order))].astype(np.int32)
    area = np.where(d == 1, x, np.where(d == 3, -x, 0))[order]
    first, final = order[begin], order[close - 1]
    return {
        "gid": regions[pixel[p[first]] // wide // wide], "a": name(p[first], d[first]), "b": name(to[final], turn[final]), "sides": close - begin,
        "area": np.add.reduceat(area, begin) if len(begin) else begin, "offsets": offsets, "xs": x[order][corner].astype(np.int32), "ys": y[order][corner].astype(np.int32),
    }


def outline_paths(labels: DataFrame, tile: int = 1024) -> DataFrame:
    """(gid, a, b, sides, area, xs, ys): the paths of every tile, with their corners in order."""

    def reach(at: str) -> F.Column:
        """Tiles whose window, a tile and a margin of one, holds a pixel."""
        low = F.greatest(F.lit(0), F.floor((F.col(at) - 1) / tile))
        return F.explode(F.sequence(low.cast("int"), F.floor((F.col(at) + 1) / tile).cast("int")))

    def run(key: tuple, frame: pa.Table) -> pa.Table:
        top, left = (k.as_py() * tile for k in key)
        found = tile_paths(*(frame.column(n).to_numpy() for n in ("gid", "r", "c")), top, left, tile)
        lists = [pa.ListArray.from_arrays(pa.array(found["offsets"]), pa.array(found[n])) for n in ("xs", "ys")]
        return pa.table([*(pa.array(found[n], pa.int64()) for n in ("gid", "a", "b", "sides", "area")), *lists], names=["gid", "a", "b", "sides", "area", "xs", "ys"])

    named = labels.select(*(F.col(n).cast("long").alias(n) for n in ("gid", "r", "c"))).where("gid is not null and r >= 0 and c >= 0")
    return named.withColumn("i", reach("r")).withColumn("j", reach("c")).groupBy("i", "j").applyInArrow(run, _PATH)


def _numbered(paths: DataFrame) -> DataFrame:
    """(gid, a, ring, ahead): the first side of the ring that each open path belongs to, and how many
    paths it is from there. A jump twice as long that finds no earlier side has been all round."""
    at = cut(paths.where("a <> b").select("gid", "a", "b", F.col("a").alias("ring"), F.lit(0).cast("long").alias("ahead")), "outline-jumps")
    step, moved = 1, True
    while moved:
        then = at.select("gid", F.col("a").alias("b"), F.col("b").alias("b2"), F.col("ring").alias("ring2"), F.col("ahead").alias("ahead2"))
        lower = F.col("ring2") < F.col("ring")
        at = cut(at.join(then, ["gid", "b"]).select("gid", "a", F.col("b2").alias("b"), F.least("ring", "ring2").alias("ring"), F.when(lower, F.col("ahead2") + step).otherwise(F.col("ahead")).alias("ahead"), lower.alias("moved")), "outline-jumps")
        moved = bool(at.agg(F.max("moved")).first()[0])
        step *= 2
    return at.select("gid", "a", "ring", "ahead")


def outline_pieces(labels: DataFrame, tile: int = 1024) -> DataFrame:
    """(gid, ring, place, sides, area, xs, ys): each ring as pieces in the order of ``place``; the
    pieces' areas add up to what an outer ring holds, or to less than zero for the ring of a hole."""

    def make() -> DataFrame:
        paths = cut(outline_paths(labels, tile), "outline-paths")
        joined = paths.join(_numbered(paths), ["gid", "a"], "left")
        # the ring's first path comes first, then those with the longest way to it
        place = F.when(F.coalesce("ahead", F.lit(0)) == 0, F.lit(-(2**62))).otherwise(-F.col("ahead"))
        return joined.select("gid", F.coalesce("ring", "a").alias("ring"), place.cast("long").alias("place"), "sides", "area", "xs", "ys")

    return settle(make, "outline-pieces")


def ring_statistics(pieces: DataFrame) -> DataFrame:
    """(gid, ring, area, sides, corners) of every ring; corners are never brought together."""
    return pieces.groupBy("gid", "ring").agg(F.sum("area").alias("area"), F.sum("sides").alias("sides"), F.sum(F.size("xs")).alias("corners"))


def rings(pieces: DataFrame) -> DataFrame:
    """(gid, ring, area, xs, ys): a row for every closed ring, its corners in order, the first of
    them not repeated. A row is as long as the ring has corners."""
    held = pieces.groupBy("gid", "ring").agg(F.sum("area").alias("area"), F.sort_array(F.collect_list(F.struct("place", "xs", "ys"))).alias("held"))
    return held.select("gid", "ring", "area", *(F.flatten(F.col(f"held.{n}")).alias(n) for n in ("xs", "ys")))


def _inside(x: np.ndarray, y: np.ndarray, px: float, py: float) -> bool:
    """Is the point inside the ring? Upright sides to its right that cross its row are counted."""
    return bool((((y > py) != (np.roll(y, -1) > py)) & (x > px)).sum() % 2)


def _multipolygon(outlines: list[tuple[int, np.ndarray, np.ndarray]], a: float, c: float, e: float, f: float) -> tuple[int, str]:
    """Number of parts (pixels that touch at corners are one part) and the text of rings (area, x, y)
    of one region. A hole belongs to the smallest outer ring around it."""
    turned = []
    for area, x, y in outlines:
        k = int(np.lexsort((y, x))[0])  # from its leftmost, then topmost corner
        turned.append((area, np.roll(x, -k), np.roll(y, -k)))
    outer = sorted((o for o in turned if o[0] > 0), key=lambda o: (o[0], o[1][0], o[2][0]))
    box = np.array([(x.min(), x.max(), y.min(), y.max()) for _, x, y in outer])
    holes: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in outer]
    for hole in sorted((o for o in turned if o[0] < 0), key=lambda o: (o[1][0], o[2][0])):
        px, py = hole[1][0] + 0.5, hole[2][0] + 0.5  # a hole's leftmost corner has its first pixel right below
        near = np.flatnonzero((box[:, 0] < px) & (box[:, 1] > px) & (box[:, 2] < py) & (box[:, 3] > py))
        holes[next(k for k in near if outer[k][0] > -hole[0] and _inside(outer[k][1], outer[k][2], px, py))].append(hole)

    root = list(range(len(outer)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    met: dict[tuple[int, int], int] = {}
    for k, own in enumerate(outer):
        for _, x, y in (own, *holes[k]):
            for q in zip(x.tolist(), y.tolist(), strict=True):
                root[find(k)] = find(met.setdefault(q, k))

    def text(x: np.ndarray, y: np.ndarray) -> str:
        return "(" + ", ".join(f"{c + u * a:.10g} {f + v * e:.10g}" for u, v in zip([*x, x[0]], [*y, y[0]], strict=True)) + ")"

    shapes = ["(" + ", ".join([text(*own[1:]), *(text(*h[1:]) for h in holes[k])]) + ")" for k, own in enumerate(outer)]
    return len({find(k) for k in range(len(outer))}), "MULTIPOLYGON (" + ", ".join(shapes) + ")"


def outline_polygons(labels: DataFrame, a: float = 1.0, c: float = 0.0, e: float = 1.0, f: float = 0.0, tile: int = 1024) -> DataFrame:
    """(adaptel_id, n_parts, wkt), as ``grow.polygonize`` gives, for regions of any extent: only the
    corners of a region's outline meet, which its text holds anyway."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        parts, wkt = _multipolygon([(int(s), np.asarray(x), np.asarray(y)) for s, x, y in zip(frame["area"], frame["xs"], frame["ys"], strict=True)], a, c, e, f)
        return pd.DataFrame({"adaptel_id": [int(frame["gid"].iloc[0])], "n_parts": [parts], "wkt": [wkt]})

    return rings(outline_pieces(labels, tile)).groupBy("gid").applyInPandas(run, "adaptel_id bigint, n_parts int, wkt string")
