import heapq
import math

import numpy as np
import pytest

from lumigrid.operators.grow import fill_holes, grow_array, parts_of, rings_of
from lumigrid.operators.modes import GrowRecipe
from lumigrid.operators.segment import LEVELS, segment_array


def recipe(**k):
    return GrowRecipe(**({"space": "raw", "rule": "reach", "max_cost": 5.0, "band_weights": None, "taper": 0.0, "max_radius": 20.0, "fill_holes": False} | k))


def grow(data, seeds, valid=None, **k):
    data = np.asarray(data, float)
    data = data if data.ndim == 3 else data[None]
    valid = np.ones(data.shape[1:], bool) if valid is None else valid
    return grow_array(data, valid, np.array(seeds), recipe(**k))


def test_two_blobs():
    a = np.full((31, 47), -7.0)
    a[2:9, 3:20] = a[14:29, 33:40] = 55
    got = grow(a, [(5, 11), (21, 36)])
    assert (got == 0).sum() == 7 * 17 and (got == 1).sum() == 15 * 7


def test_radius_is_a_disc():
    got = grow(np.full((23, 37), 3.0), [(9, 26)], max_radius=7.3)
    rr, cc = np.mgrid[:23, :37]
    assert ((got == 0) == (np.hypot(rr - 9, cc - 26) <= 7.3)).all()


def test_missing_column_is_a_wall():
    valid = np.ones((17, 33), bool)
    valid[6] = False
    got = grow(np.ones((17, 33)), [(2, 30), (12, 1)], valid)
    assert set(np.unique(got[:6])) <= {-1, 0} and set(np.unique(got[7:])) <= {-1, 1} and (got[6] == -1).all()


def test_band_weights():
    a = np.zeros((3, 12, 26))
    a[2, :, 13:] = 4
    assert (grow(a, [(6, 8)], max_cost=6.0, band_weights=(1.0, 1.0, 1.4))[:, 18] == 0).any()
    assert (grow(a, [(6, 8)], max_cost=6.0, band_weights=(1.0, 1.0, 1.6))[:, 13:] == -1).all()
    with pytest.raises(ValueError):
        grow(a, [(6, 8)], band_weights=(1.0, 2.0))


def test_taper():
    a = np.full((35, 35), 3.2)
    a[17, 17] = 0
    far = lambda g: np.hypot(*(np.argwhere(g == 0) - 17).T).max()
    # a tolerance of 5 less 6 at the rim of 12 leaves 3.2 up to a distance of 3.6
    assert far(grow(a, [(17, 17)], max_radius=12.0, taper=6.0)) <= 3.6 < 11 < far(grow(a, [(17, 17)], max_radius=12.0)) <= 12


def test_first_of_two_seeds_on_a_pixel_and_seed_on_missing_data():
    valid = np.ones((9, 9), bool)
    valid[0, 0] = False
    assert set(np.unique(grow(np.zeros((9, 9)), [(4, 4), (4, 4), (0, 0)], valid))) == {-1, 0}


def test_partition_rule_cuts_afterwards():
    got = grow(np.zeros((30, 30)), [(5, 5), (25, 25)], rule="partition", max_radius=4.0)
    rr, cc = np.nonzero(got == 0)
    assert len(rr) and ((rr - 5) ** 2 + (cc - 5) ** 2 <= 16).all()


def test_holes_and_outlines():
    a = np.full((7, 7), -1)
    a[1:6, 1:6] = 0
    a[3, 3] = -1
    assert fill_holes(a, np.ones((7, 7), bool))[3, 3] == 0
    cells = {(r, c) for r, c in np.argwhere(a == 0).tolist()}
    rings = rings_of(cells)
    assert len(rings) == 2 and sorted(map(len, rings)) == [5, 5]
    assert len(parts_of({(0, 0), (1, 1), (5, 5)})) == 2


def slow_reach(data, seeds, radius, cost, taper):
    """Reach rule from its definition: bottleneck costs by repeated relaxation for each seed alone,
    then each pixel to the seed of least cost that comes to it through its own region."""
    n, (bands, h, w) = len(seeds), data.shape
    d = np.array([np.sqrt(((data - data[:, r, c][:, None, None]) ** 2).sum(axis=0)) for r, c in seeds])
    rr, cc = np.mgrid[:h, :w]
    away = np.array([np.hypot(rr - r, cc - c) for r, c in seeds])
    may = (away <= radius) & (d <= cost - taper * away / radius)
    label, best = np.full((h, w), -1), np.full((h, w), np.inf)
    for s, (r, c) in enumerate(seeds):
        if best[r, c] > 0:
            label[r, c], best[r, c] = s, 0.0
    done = np.zeros((h, w), bool)
    while True:  # settle the cheapest open pixel, ties by seed and place
        open_ = np.argwhere((label >= 0) & ~done)
        if not len(open_):
            return label
        r, c = min(map(tuple, open_.tolist()), key=lambda p: (best[p], label[p], p))
        done[r, c] = True
        s = label[r, c]
        for y in range(max(r - 1, 0), min(r + 2, h)):
            for x in range(max(c - 1, 0), min(c + 2, w)):
                step = max(best[r, c], d[s, y, x])
                if not done[y, x] and may[s, y, x] and step <= cost - taper * away[s, y, x] / radius and step < best[y, x]:
                    best[y, x], label[y, x] = step, s


@pytest.mark.parametrize("taper", [0.0, 3.0])
def test_reach_equals_a_slow_version(taper):
    rng = np.random.default_rng(12)
    data = np.cumsum(rng.normal(0, 0.8, (2, 24, 31)), axis=2)
    seeds = [(3, 4), (12, 15), (13, 18), (20, 27), (5, 25)]
    got = grow(data, seeds, max_cost=6.0, max_radius=8.0, taper=taper)
    assert (got == slow_reach(data, seeds, 8.0, 6.0, taper)).all() and len(np.unique(got)) == 6


def test_outlines_hold_exactly_their_cells():
    rng = np.random.default_rng(2)
    for k in range(20):
        cells = {(int(r), int(c)) for r, c in np.argwhere(rng.random((9, 11)) < 0.3 + k / 40)}
        inside = set()
        rings = [r for part in parts_of(cells) for r in rings_of(part)]
        for r in range(9):
            for c in range(11):
                crossings = sum((y1 > r + 0.5) != (y2 > r + 0.5) and x1 > c + 0.5 for ring in rings for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False))
                if crossings % 2:
                    inside.add((r, c))
        assert inside == cells


def slow_segments(stack, valid, granularity, spacing):
    """The rule of superpixels pixel by pixel, with a heap."""
    _, h, w = stack.shape
    stack, unit = stack.astype(np.float32), np.float32(granularity / LEVELS)
    owner, cost, done, seeds_of, side = {}, {}, set(), [], spacing
    free = {(int(r), int(c)) for r, c in np.argwhere(valid)}
    while free:
        squares = {}
        for r, c in sorted(free):
            away = (2 * (r % side) - side + 1) ** 2 + (2 * (c % side) - side + 1) ** 2
            squares.setdefault((r // side, c // side), []).append((away, r, c))
        seeds = sorted(min(v)[1:] for v in squares.values())
        seeds_of += seeds
        heap = []
        for s in seeds:
            owner[s], cost[s] = s, 0
            heapq.heappush(heap, (0, s, s))
        while heap:
            k, s, p = heapq.heappop(heap)
            if p in done or (cost[p], owner[p]) != (k, s):
                continue
            done.add(p)
            free.discard(p)
            for q in ((p[0] - 1, p[1]), (p[0] + 1, p[1]), (p[0], p[1] - 1), (p[0], p[1] + 1)):
                if q in free:
                    d = np.sqrt(((stack[:, q[0], q[1]] - stack[:, s[0], s[1]]) ** 2).sum()) / unit
                    new = k + max(1, math.ceil(min(d, LEVELS)))
                    if new < LEVELS and (new, s) < (cost.get(q, LEVELS), owner.get(q, (h, w))):
                        cost[q], owner[q] = new, s
                        heapq.heappush(heap, (new, s, q))
        side = max(1, side // 2)
    rank = {s: k for k, s in enumerate(seeds_of)}
    out = np.full((h, w), -1)
    for p in done:
        out[p] = rank[owner[p]]
    return out


@pytest.mark.parametrize(("granularity", "share"), [(15.0, 1.0), (60.0, 0.9), (400.0, 0.7)])
def test_superpixels_equal_a_slow_version(granularity, share):
    rng = np.random.default_rng(int(granularity))
    stack = np.cumsum(rng.normal(0, 3, (3, 60, 60)), axis=1) + rng.normal(0, 2, (3, 60, 60))
    valid = rng.random((60, 60)) < share
    got = segment_array(stack, valid, granularity)
    assert (got == slow_segments(stack, valid, granularity, 16)).all() and ((got >= 0) == valid).all()


def test_superpixels():
    rng = np.random.default_rng(1)
    a = rng.normal(50, 2, (1, 40, 40))
    a[0, 10:20, 10:20] = 200
    valid = np.ones((40, 40), bool)
    valid[:5, :5] = False
    few, many = segment_array(a, valid, 60.0), segment_array(a, valid, 6.0)
    assert ((few >= 0) == valid).all() and few.max() < many.max()
    assert not set(np.unique(few[10:20, 10:20])) & set(np.unique(few[21:, 21:]))
    assert segment_array(a, np.zeros((40, 40), bool), 60.0).max() == -1


def test_a_default_tile_of_superpixels_fits():
    """2400 pixels square: arrays stay under 500 MB."""
    import tracemalloc

    rng = np.random.default_rng(3)
    coarse = np.kron(rng.normal(100, 30, (4, 100, 100)), np.ones((24, 24))).astype(np.float32)
    tracemalloc.start()
    label = segment_array(coarse, np.ones((2400, 2400), bool), 60.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert label.min() == 0 and 10_000 < label.max() < 2_000_000 and peak < 500 << 20


def slow_partition(data, seeds, radius, cost):
    """Partition rule from its definition: the cheapest open pixel is settled (ties: seed, place) and
    offers its own seed's cost to its neighbours, without limits; tolerance and radius cut afterwards."""
    _, h, w = data.shape
    d = [np.sqrt(((data - data[:, r, c][:, None, None]) ** 2).sum(axis=0)) for r, c in seeds]
    best, done = {}, {}
    for s, (r, c) in enumerate(seeds):
        best.setdefault((r, c), (0.0, s))
    while best:
        p = min(best, key=lambda p: (*best[p], p))
        k, s = best.pop(p)
        done[p] = (k, s)
        for y in range(max(p[0] - 1, 0), min(p[0] + 2, h)):
            for x in range(max(p[1] - 1, 0), min(p[1] + 2, w)):
                new = max(k, d[s][y, x])
                if (y, x) not in done and new < best.get((y, x), (np.inf, 0))[0]:
                    best[y, x] = (new, s)
    out = np.full((h, w), -1)
    for (r, c), (k, s) in done.items():
        if k <= cost and (r - seeds[s][0]) ** 2 + (c - seeds[s][1]) ** 2 <= radius**2:
            out[r, c] = s
    return out


def test_partition_equals_a_slow_version():
    rng = np.random.default_rng(14)
    data = np.cumsum(rng.normal(0, 0.8, (2, 26, 29)), axis=2)
    seeds = [(3, 4), (12, 15), (13, 18), (20, 27), (5, 25), (24, 2)]
    got = grow(data, seeds, rule="partition", max_cost=5.0, max_radius=9.0)
    assert (got == slow_partition(data, seeds, 9.0, 5.0)).all() and len(np.unique(got)) == 7
