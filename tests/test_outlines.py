"""Outlines over tiles against those of whole regions."""

import numpy as np
import pytest

from lumigrid.operators import grow, outlines


def rows_of(label):
    return [(int(label[r, c]), int(r), int(c)) for r, c in np.argwhere(label >= 0)]


def shapes(wkt):
    """Sets of polygons, each the set of its rings."""
    inner = wkt.removeprefix("MULTIPOLYGON ((").removesuffix("))")
    return {frozenset(p.strip("()").split("), (")) for p in inner.split(")), ((")}


def walk(follows, start):
    out = [start]
    while follows[out[-1]] < len(follows) and follows[out[-1]] != start:
        out.append(int(follows[out[-1]]))
    return out


def test_jumps_number_lists_and_rings():
    follows = np.array([3, 9, 4, 5, 2, 1, 7, 8, 6])  # 0 3 5 1, 2 4, 6 7 8
    at, low, last, left = outlines._jumps(follows)
    assert [at[k] < 9 for k in range(9)] == [False, False, True, False, True, False, True, True, True]
    for k in (0, 1, 3, 5):
        assert (last[k], left[k]) == (1, len(walk(follows, k)))
    assert [low[k] for k in (2, 4, 6, 7, 8)] == [2, 2, 6, 6, 6]


@pytest.mark.parametrize("tile", [3, 7, 64])
def test_outlines_over_tiles_equal_whole_ones(spark, tile):
    rng = np.random.default_rng(41)
    wide = rng.integers(-1, 3, (19, 23))
    wide[2:17, 3:21] = 5  # a ring of three tiles' width with an island that has a hole of its own
    wide[4:15, 5:19] = -1
    wide[6:13, 7:17] = 5
    wide[8:11, 9:15] = -1
    wide[5, 6] = 5  # touches the island at a corner only
    labels = spark.createDataFrame(rows_of(wide), "gid long, r int, c int")
    got = {r.adaptel_id: r for r in outlines.outline_polygons(labels, 0.5, 100.0, -0.5, 900.0, tile).collect()}
    want = {r.adaptel_id: r for r in grow.polygonize(labels, 0.5, 100.0, -0.5, 900.0).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k].n_parts == w.n_parts
        assert shapes(got[k].wkt) == shapes(w.wkt)


def test_a_region_wider_than_a_tile_is_one_closed_ring(spark):
    snake = np.full((41, 41), -1)
    snake[::2] = 8  # every other row, joined at alternate ends
    for k, r in enumerate(range(1, 41, 2)):
        snake[r, 40 if k % 2 == 0 else 0] = 8
    pieces = outlines.outline_pieces(spark.createDataFrame(rows_of(snake), "gid long, r int, c int"), 4)
    ring = outlines.rings(pieces).collect()
    assert len(ring) == 1 and ring[0].area == (snake == 8).sum() and pieces.count() > 300
    x, y = np.array(ring[0].xs), np.array(ring[0].ys)
    dx, dy = np.roll(x, -1) - x, np.roll(y, -1) - y
    assert ((dx == 0) != (dy == 0)).all() and (dx != 0)[::2].all() != (dx != 0)[1::2].all()
    stats = outlines.ring_statistics(pieces).first()
    assert stats.sides == np.abs(dx).sum() + np.abs(dy).sum() and stats.corners == len(x)


def test_overlaps_repeats_nulls_and_no_rows(spark):
    square = [(r, c) for r in range(5) for c in range(5)]
    rows = [(1, r, c) for r, c in square] * 2 + [(2, r + 2, c + 2) for r, c in square] + [(None, 0, 0), (3, None, 0)]
    labels = spark.createDataFrame(rows, "gid long, r int, c int")
    got = {r.adaptel_id: (r.n_parts, shapes(r.wkt)) for r in outlines.outline_polygons(labels, tile=3).collect()}
    assert got == {k: (1, {frozenset({f"{o} {o}, {o + 5} {o}, {o + 5} {o + 5}, {o} {o + 5}, {o} {o}"})}) for k, o in ((1, 0), (2, 2))}
    assert outlines.outline_polygons(labels.where("gid > 7"), tile=3).count() == 0


def test_windows_without_sides(spark):
    # the last row is a tile's last, so that the next window has a margin alone; the middle tile is full inside
    labels = spark.createDataFrame([(1, r, c) for r in range(9) for c in range(9)], "gid long, r int, c int")
    assert len(outlines.tile_paths(*np.full((3, 9), 8), 9, 9, 3)["gid"]) == 0
    stats = outlines.ring_statistics(outlines.outline_pieces(labels, 3)).collect()
    assert [(s.area, s.sides, s.corners) for s in stats] == [(81, 36, 4)]
    assert [r.wkt for r in outlines.outline_polygons(labels, tile=3).collect()] == ["MULTIPOLYGON (((0 0, 9 0, 9 9, 0 9, 0 0)))"]


def test_many_small_regions_share_tasks(spark):
    """A call for each region takes longer than its outline; regions that run over batches stay whole."""
    label = np.random.default_rng(43).integers(-1, 150, (40, 40))
    label[5:12, 5:12] = 200
    label[7:10, 7:10] = 201  # in a hole of the other
    labels = spark.createDataFrame(rows_of(label) + rows_of(label)[:50], "gid long, r int, c int")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        polygons = grow.polygonize(labels, 0.5, 100.0, -0.5, 900.0)
        assert "FlatMapGroups" not in polygons._jdf.queryExecution().toString()
        got = polygons.collect()
        want = {r.adaptel_id: r for r in outlines.outline_polygons(labels, 0.5, 100.0, -0.5, 900.0).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(got) == len(want) and {r.adaptel_id for r in got} == want.keys()
    for r in got:
        assert r.n_parts == want[r.adaptel_id].n_parts and shapes(r.wkt) == shapes(want[r.adaptel_id].wkt)
    assert grow.polygonize(labels.where("gid > 900")).count() == 0
