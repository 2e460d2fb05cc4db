"""Scene statistics: radiometric matching and robust feature normalisation."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from lumigrid.operators.components import cut

# Reference ranges of the training bands (2nd and 98th percentile), and the trigger.
REFERENCE = {"red": (29.0, 80.0), "green": (45.0, 94.0), "blue": (55.0, 79.0), "nir": (50.0, 144.0)}
OFFSET_DN, RANGE_RATIO, LEAST_VALUES = 15.0, 0.7, 1000
MAD_SCALE, MAD_FLOOR = 1.4826, 1e-6


#: Bits that a pass of the radix selection settles, and passes.
DIGIT, PASSES = 13, 5


def _ordered(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers of the same order, shifted up to PASSES * DIGIT bits less one."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def _plain(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else ~key & ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _histograms(frame: DataFrame, columns: Sequence[str], known: dict[int, list[int]], done: int) -> dict[tuple[int, int], np.ndarray]:
    """Counts by the next digit of the values of each column that begin with one of its ``known``
    prefixes of ``done`` bits: (column number, prefix) to counts."""
    left = max(0, 64 - done - DIGIT)
    bins = 1 << min(DIGIT, 64 - done)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for j, prefixes in known.items():
                v = b.column(j).fill_null(np.nan).to_numpy(zero_copy_only=False)
                key = _ordered(v[np.isfinite(v)])
                for p in prefixes:
                    mine = key[key >> np.uint64(64 - done) == p] if done else key
                    count = np.bincount(((mine >> np.uint64(left)) & np.uint64(bins - 1)).astype(np.int64), minlength=1)
                    at = np.flatnonzero(count)
                    rows.append((np.full(len(at), j), np.full(len(at), p, np.uint64).view(np.int64), at, count[at]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], names=["j", "prefix", "bin", "n"])

    slim = frame.select(*(F.col(f"`{c}`").cast("double").alias(f"v{k}") for k, c in enumerate(columns)))
    found = slim.mapInArrow(run, "j bigint, prefix bigint, bin bigint, n bigint").groupBy("j", "prefix", "bin").agg(F.sum("n").alias("n"))
    out: dict[tuple[int, int], np.ndarray] = {}
    for r in found.collect():  # 2 ** DIGIT rows a column and rank that is looked for, at most
        out.setdefault((r.j, r.prefix & ((1 << 64) - 1)), np.zeros(bins, np.int64))[r.bin] = r.n
    return out


def exact_quantiles(frame: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> dict[str, tuple[int, list[float]]]:
    """For each column with finite values their number and their quantiles, linear between the two
    values around a share's place.

    Radix selection: the bits of a double, put in order, are settled a digit a pass from the top,
    for all columns and shares at once. A pass counts the values of each prefix still of interest by
    their next digit, so what a task or the driver holds depends on the columns and shares alone,
    never on how many values are distinct."""
    if not columns:
        return {}
    frame = cut(frame.select(*(F.col(f"`{c}`").cast("double").alias(c) for c in dict.fromkeys(columns))), "values")
    known: dict[int, list[int]] = {j: [0] for j in range(len(columns))}
    sizes: dict[int, int] = {}
    places: dict[tuple[int, int], tuple[int, int]] = {}  # (column, place) to (prefix, place under it)
    done = 0
    while done < 64:
        counts = _histograms(frame, columns, known, done)
        if not done:
            sizes = {j: int(c.sum()) for (j, _), c in counts.items()}
            places = {(j, k): (0, k) for j, n in sizes.items() for q in shares for k in {math.floor(q * (n - 1)), math.ceil(q * (n - 1))}}
        width = min(DIGIT, 64 - done)
        for (j, k), (prefix, rest) in places.items():
            run = np.cumsum(counts[j, prefix])
            digit = int(np.searchsorted(run, rest, "right"))
            places[j, k] = (prefix << width | digit, rest - int(run[digit - 1] if digit else 0))
        known = {j: sorted({p for (i, _), (p, _) in places.items() if i == j}) for j in sizes}
        done += width
    out = {}
    for j, n in sizes.items():
        at = [q * (n - 1) for q in shares]
        ends = [(_plain(places[j, int(np.floor(x))][0]), _plain(places[j, int(np.ceil(x))][0]), x - int(x)) for x in at]
        out[columns[j]] = (n, [lo + (hi - lo) * part for lo, hi, part in ends])
    return out


def measure_bands(pixels: DataFrame, roles: Sequence[str], low: float = 2.0, high: float = 98.0, reference: Mapping[str, tuple[float, float]] = REFERENCE) -> DataFrame:
    """One row per role with finite values: (role, n, lo, hi, want, gain, dark, flat). lo and hi are
    the two exact percentiles; dark and flat say that the dark end lies too high or the range is too
    narrow for the reference range, which starts at want and is gain times as wide. Roles without a
    reference, or with under 1000 values, have null marks and are not matched."""
    rows = []
    for role, (n, (lo, hi)) in exact_quantiles(pixels, list(roles), (low / 100, high / 100)).items():
        want, top = reference.get(role, (None, None))
        judged = want is not None and n >= LEAST_VALUES
        rows.append((role, n, lo, hi, want, *(((top - want) / max(hi - lo, 1e-6), lo - want > OFFSET_DN, hi - lo < RANGE_RATIO * (top - want)) if judged else (None, None, None))))
    return pixels.sparkSession.createDataFrame(rows, "role string, n bigint, lo double, hi double, want double, gain double, dark boolean, flat boolean")


def needs_match(found: Sequence[Row], kind: str = "auto") -> bool:
    """Do measured bands call for a match? kind: auto, match (always) or off (never)."""
    if kind not in ("auto", "match", "off"):
        raise ValueError(f"radiometry is auto, match or off, not {kind!r}")
    return kind == "match" or (kind == "auto" and any(r["dark"] or r["flat"] for r in found))


def match_bands(pixels: DataFrame, found: Sequence[Row]) -> DataFrame:
    """Measured bands mapped linearly to their reference ranges and clipped to 0..255."""
    maps = {r["role"]: (F.col(r["role"]).cast("double") - r["lo"]) * r["gain"] + r["want"] for r in found if r["gain"] is not None and r["role"] in pixels.columns}
    return pixels.withColumns({k: F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0)) for k, v in maps.items()})


def every_fourth(valid_pixels: DataFrame, keys: Sequence[str] = ("tile_id",), row: str = "tr", col: str = "tc") -> DataFrame:
    """The systematic 1-in-4 sample, in row-major order of each tile."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(row, col)
    return valid_pixels.withColumn("__k", F.row_number().over(w)).where("__k % 4 = 1").drop("__k")


def robust_statistics(segments: DataFrame, columns: Sequence[str]) -> list[Row]:
    """Rows (name, med, mad) for the columns that have finite values: the median and the scaled
    median distance from it."""
    middle = {c: q[0] for c, (_, q) in exact_quantiles(segments, list(columns), (0.5,)).items()}
    if not middle:
        raise RuntimeError("no sampled tile has segments to normalise by")
    away = segments.select(*(F.abs(F.col(f"`{c}`").cast("double") - m).alias(c) for c, m in middle.items()))
    spread = exact_quantiles(away, list(middle), (0.5,))
    return [Row(name=c, med=m, mad=spread[c][1][0] * MAD_SCALE + MAD_FLOOR) for c, m in middle.items()]


def robust_scores(statistics: Sequence[Row], kind: str) -> dict[str, Column]:
    """Columns of z-scores from rows (name, med, mad), by the name that they take: that of the feature
    itself (kind zsr), or z_ before it (both)."""
    if kind not in ("zsr", "both"):
        raise ValueError(f"feature transform is zsr or both, not {kind!r}")
    return {("" if kind == "zsr" else "z_") + r["name"]: (F.col(f"`{r['name']}`") - r["med"]) / r["mad"] for r in statistics}
