"""Adjacency of segments, objects as connected components, and radius suppression."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumigrid.operators.components import connected_components, cut


def edges(tiled: DataFrame, keys: Sequence[str] = ("tile_id",), seg: str = "seg", row: str = "tr", col: str = "tc", valid: str = "valid") -> DataFrame:
    """Distinct pairs (keys, a, b), a < b, of segments that touch through a pixel's side."""
    px = tiled.where(F.col(valid) & F.col(seg).isNotNull()).select(*keys, seg, row, col)
    found = None
    for line, order in ((row, col), (col, row)):
        w = Window.partitionBy(*keys, line).orderBy(order)
        near = px.select(*keys, F.col(seg).alias("x"), F.lead(seg).over(w).alias("y"), (F.lead(order).over(w) - F.col(order)).alias("gap")).where("gap = 1 and x <> y")
        near = near.select(*keys, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        found = near if found is None else found.unionByName(near)
    return found.distinct()


def _merge_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of links and the smallest vertex of each one's component."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(names))
    while True:
        least = np.minimum(low[x], low[y])
        new = low.copy()
        np.minimum.at(new, low[x], least)
        np.minimum.at(new, low[y], least)
        while not (new[new] == new).all():
            new = new[new]
        if (new == low).all():
            return names, names[low]
        low = new


def _settled(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, v, low) for the ends of links (keys, a, b): the smallest vertex of each component inside
    the keys' group, which one task holds."""
    types = {k: links.schema[k].dataType.simpleString() for k in keys}

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        names, low = _merge_links(frame["a"].to_numpy(), frame["b"].to_numpy())
        return pd.DataFrame({**{k: frame[k].iloc[0] for k in keys}, "v": names, "low": low})

    return links.select(*keys, "a", "b").groupBy(*keys).applyInPandas(settle, ", ".join(f"{k} {t}" for k, t in types.items()) + ", v bigint, low bigint")


def stitched_components(links: DataFrame) -> DataFrame:
    """(v, low) for the ends of links (ta, a, tb, b), low the smallest vertex of the component; ta and
    tb name the tiles in which the ends lie, and a vertex lies in one tile.

    Links inside a tile are settled there in one task, whose size the tile bounds. Links between
    tiles then join the tiles' components, a graph as small as the borders, which is contracted in
    rounds. No task holds more than a tile."""
    inner = cut(_settled(links.where("ta = tb").withColumnRenamed("ta", "tile"), ["tile"]).select("v", "low"), "tile-roots")
    border = links.where("ta <> tb").select("a", "b").distinct()
    for end in ("a", "b"):
        border = border.join(inner.select(F.col("v").alias(end), F.col("low").alias(f"l{end}")), end, "left").withColumn(f"l{end}", F.coalesce(f"l{end}", end))
    border = cut(border.select("a", "b", "la", "lb"), "border-links")
    merged = connected_components(border, "la", "lb").select(F.col("vertex").alias("low"), "component")
    ends = inner.unionByName(border.select(F.col("a").alias("v"), F.col("la").alias("low"))).unionByName(border.select(F.col("b").alias("v"), F.col("lb").alias("low"))).distinct()
    return ends.join(merged, "low", "left").select("v", F.coalesce("component", "low").alias("low"))


def build_objects(predicted: DataFrame, links: DataFrame, keys: Sequence[str] = ("tile_id",), seg: str = "seg", place: str | None = None) -> DataFrame:
    """(keys, seg, obj) for predicted segments: obj is the smallest segment of the connected group;
    a segment without predicted neighbours is an object of its own.

    With keys, links never leave a tile and a tile is settled in one task, which its size bounds.
    Without, objects reach over the scene: ``place`` names the column of ``predicted`` that holds each
    segment's tile, and tiles are settled and then stitched; without it all links are contracted in
    rounds."""
    kind = predicted.schema[seg].dataType.simpleString()
    mine = predicted.select(*keys, F.col(seg).cast("long").alias("__s"), *([F.col(place).alias("__t")] if place else []))
    pairs = links.select(*keys, F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    for end in ("a", "b"):
        pairs = pairs.join(mine.withColumnsRenamed({"__s": end, "__t": f"t{end}"}), [*keys, end], "inner" if place else "left_semi")
    if keys:
        roots = _settled(pairs, keys)
    elif place:
        roots = stitched_components(pairs)
    else:
        roots = connected_components(pairs).select(F.col("vertex").alias("v"), F.col("component").alias("low"))
    out = mine.join(roots.withColumnRenamed("v", "__s"), [*keys, "__s"], "left")
    return out.select(*keys, F.col("__s").cast(kind).alias(seg), F.coalesce("low", "__s").alias("obj"))


def radius_pairs(points: DataFrame, radius: float, id_col: str = "id", x: str = "x", y: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    """Pairs (i, j) of different points within the radius (inclusive), both ways, by an equi-join on
    grid cells of the radius's size; each point is looked for in the nine cells around it."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    near = points.select(*keys, F.col(id_col).alias("j"), F.col(x).alias("jx"), F.col(y).alias("jy"), cell(x).alias("cx"), cell(y).alias("cy"))
    steps = F.array(*(F.lit(d) for d in (-1, 0, 1)))
    seek = points.select(*keys, F.col(id_col).alias("i"), F.col(x).alias("ix"), F.col(y).alias("iy"))
    seek = seek.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps))
    seek = seek.select(*keys, "i", "ix", "iy", (F.floor(F.col("ix") / radius) + F.col("dx")).cast("long").alias("cx"), (F.floor(F.col("iy") / radius) + F.col("dy")).cast("long").alias("cy"))
    close = (F.col("ix") - F.col("jx")) ** 2 + (F.col("iy") - F.col("jy")) ** 2 <= radius * radius
    return seek.join(near, [*keys, "cx", "cy"]).where((F.col("i") != F.col("j")) & close).select(*keys, "i", "j")


#: Suppression settles blocks of this many radii in one task, halved until none has more pairs.
BLOCK_RADII, BLOCK_PAIRS = 512, 4_000_000


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What blocks can decide of their open points. Rows (bx, by, i, j, inside) by block and in it
    best i first: j is a better point near i, inside: j lies in the block too; rows without i, the
    last of a block, only tell that j is here. A task holds the points of one block, never its pairs."""
    at, known = None, {}

    def decided() -> pa.RecordBatch:
        done = [(p, keep) for p, keep in known.items() if keep is not None]
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.int64()), pa.array([k for _, k in done], pa.bool_())], names=["p", "keep"])

    for batch in batches:
        for bx, by, i, j, inside in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (bx, by) != at:
                if known:
                    yield decided()
                at, known = (bx, by), {}
            better = known.setdefault(j, True) if inside else None  # without a better one of its own j stays
            if i is not None:
                fate = known.get(i, True)
                known[i] = False if better or fate is False else None if better is None else fate
    if known:
        yield decided()


def suppress(points: DataFrame, radius: float, id_col: str = "id", x: str = "x", y: str = "y", score: str = "score", keys: Sequence[str] = (), block: float = BLOCK_RADII) -> DataFrame:
    """Adds keep: points in falling order of score (ties: smaller id first) are kept unless one
    already kept lies within the radius. A radius of 0 or less keeps all. Ids are whole numbers.

    Points with near ones meet in blocks of ``block`` radii, and a task goes through a block's open
    points best first: a point goes if a better neighbour is kept, stays if all of them have gone,
    and is left open where one is open or lies in another block and is open. Where points are dense,
    blocks are halved until none has more than ``BLOCK_PAIRS`` pairs. Blocks are shifted by
    half from round to round. The best open point of all is always decided, so it ends; rounds grow
    with the number of blocks that a chain of ever worse points runs through, not with its length.
    """
    if radius <= 0:
        return points.withColumn("keep", F.lit(True))
    facts = points.select(F.col(id_col).cast("long").alias("p"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(score).cast("double").alias("s"))
    ends = [facts.select(*(F.col(c).alias(f"{c}{e}" if c != "p" else e) for c in facts.columns)) for e in ("i", "j")]
    better = (F.col("sj") > F.col("si")) | ((F.col("sj") == F.col("si")) & (F.col("j") < F.col("i")))
    near = radius_pairs(points.withColumn(id_col, F.col(id_col).cast("long")), radius, id_col, x, y, keys).select("i", "j")
    pairs = cut(near.join(ends[0], "i").join(ends[1], "j").where(better).select("i", "j", F.col("si").alias("is"), *(F.col(f"{c}{e}").alias(f"{e}{c}") for e in "ij" for c in "xy")), "pairs")
    side, gone, turn = radius * block, None, 0

    def spot(e: str, shift: float) -> list[F.Column]:
        return [F.floor((F.col(f"{e}{c}") + shift) / side).cast("long").alias(f"b{c}") for c in "xy"]

    while side > 2 * radius and (pairs.groupBy(*spot("i", 0.0)).count().agg(F.max("count")).first()[0] or 0) > BLOCK_PAIRS:
        side /= 2
    while pairs.limit(1).count():
        shift = side / 2 * (turn % 2)
        inside = F.struct(*spot("i", shift)) == F.struct(*spot("j", shift))
        told = pairs.select(*spot("i", shift), "i", "is", "j", inside.alias("inside"))
        here = pairs.where(~inside).select(*spot("j", shift), F.lit(None).cast("long").alias("i"), F.lit(None).cast("double").alias("is"), "j", F.lit(True).alias("inside")).distinct()
        rows = told.unionByName(here).repartition("bx", "by").sortWithinPartitions("bx", "by", F.desc_nulls_last("is"), "i")
        state = cut(rows.select("bx", "by", "i", "j", "inside").mapInArrow(_greedy, "p bigint, keep boolean"), "state")
        # a point is decided in its own block alone
        open_ = pairs.join(state.select(F.col("p").alias("i")), "i", "left_anti").join(state.select(F.col("p").alias("j"), F.col("keep").alias("jk")), "j", "left")
        open_ = cut(open_.where("jk is null or jk"), "open")
        beaten = open_.where("jk").select("i").distinct()
        lost = state.where("not keep").select("p").unionByName(beaten.select(F.col("i").alias("p")))
        gone = lost if gone is None else gone.unionByName(lost)
        left = open_.where("jk is null").drop("jk").join(beaten, "i", "left_anti").join(beaten.select(F.col("i").alias("j")), "j", "left_anti")
        pairs, turn = cut(left, "pairs"), turn + 1
    if gone is None:
        return points.withColumn("keep", F.lit(True))
    marks = gone.distinct().select(F.col("p").alias("__p"), F.lit(False).alias("__k"))
    return points.join(marks, F.col(id_col).cast("long") == F.col("__p"), "left").withColumn("keep", F.coalesce("__k", F.lit(True))).drop("__p", "__k")
