"""Features of objects, which are groups of adjacent segments, and of the ring around them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumigrid.operators.zonal import eigen_ratio


def _weighted(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)


def object_features(members: DataFrame, features: Sequence[str], keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    """One row per object of ``members`` (keys, obj, area, x, y, p and the feature columns): pow,
    nseg, elong, elong_seg, p statistics, centroid cx, cy and obj_<feature> area-weighted means.

    Elongation takes each segment as a disc: its area over 4 pi adds to the variances. Moments are
    taken about the object's first centroid in one pass over raw sums, which is exact enough for
    coordinates of a tile.
    """
    w, x, y = F.col("area").cast("double"), F.col("x").cast("double"), F.col("y").cast("double")
    disc = F.sum(w * w) / (4 * math.pi)
    total = F.sum(w)
    cx, cy = F.sum(w * x) / total, F.sum(w * y) / total
    means = [_weighted(F.col(f), w).alias(f"obj_{f}") for f in features]
    out = members.groupBy(*keys, "obj").agg(
        total.alias("pow"), F.count("*").alias("nseg"), cx.alias("cx"), cy.alias("cy"),
        ((F.sum(w * x * x) - total * cx * cx + disc) / total).alias("__xx"),
        ((F.sum(w * y * y) - total * cy * cy + disc) / total).alias("__yy"),
        ((F.sum(w * x * y) - total * cx * cy) / total).alias("__xy"),
        _weighted(F.col("wydluzenie"), w).alias("elong_seg"),
        F.max("p").alias("s_max"), _weighted(F.col("p"), w).alias("s_mean"), F.min("p").alias("s_min"), *means,
    )
    out = out.withColumn("elong", eigen_ratio(F.col("__xx"), F.col("__yy"), F.col("__xy")))
    return out.select(*keys, "obj", "cx", "cy", "pow", "nseg", "elong", "elong_seg", "s_max", "s_mean", "s_min", *(f"obj_{f}" for f in features))


def ring_features(objects_of: DataFrame, links: DataFrame, segments: DataFrame, index_col: str, keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    """(keys, obj, ring_n, ring_ndvi, ring_L) for objects with neighbours outside any object. Every
    edge counts, so a neighbour of two members counts twice, in the means too."""
    ends = links.select(*keys, F.col("a").alias("s"), F.col("b").alias("t")).unionByName(links.select(*keys, F.col("b").alias("s"), F.col("a").alias("t")))
    mine = objects_of.select(*keys, F.col("seg").alias("s"), "obj")
    outside = ends.join(mine, [*keys, "s"]).join(objects_of.select(*keys, F.col("seg").alias("t")), [*keys, "t"], "left_anti")
    facts = segments.select(*keys, F.col("seg").alias("t"), "area", F.col(index_col).alias("__i"), F.col("sr_L").alias("__l"))
    ring = outside.join(facts, [*keys, "t"])
    return ring.groupBy(*keys, "obj").agg(F.count("*").alias("ring_n"), _weighted(F.col("__i"), F.col("area")).alias("ring_ndvi"), _weighted(F.col("__l"), F.col("area")).alias("ring_L"))


def describe_objects(objects_of: DataFrame, segments: DataFrame, links: DataFrame, features: Sequence[str], keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Object and ring features together; objects without a ring have zeros there."""
    members = objects_of.join(segments, [*keys, "seg"])
    index_col = "sr_NDVI" if "sr_NDVI" in segments.columns else "sr_NDGR"
    ring = ring_features(objects_of, links, segments, index_col, keys)
    out = object_features(members, features, keys).join(ring, [*keys, "obj"], "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(t)) for c, t in (("ring_n", "long"), ("ring_ndvi", "double"), ("ring_L", "double"))})


def running_ids(frame: DataFrame, group: str, order: Sequence[str], name: str = "id") -> DataFrame:
    """Adds numbers from 1 in the order of (group, order). Two levels, numbers inside groups and the
    groups' offsets, so that no task holds all rows; the offsets take a row a group."""
    inner = frame.withColumn("__k", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    sizes = frame.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("__n"))
    sizes = sizes.withColumn("__base", F.sum("__n").over(Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n"))
    return inner.join(sizes, F.col(group).eqNullSafe(F.col("__g"))).withColumn(name, F.col("__base") + F.col("__k")).drop("__k", "__g", "__n", "__base")
