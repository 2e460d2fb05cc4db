"""Raster, point, height and stand views over the driver's tables.

The tables hold no rasters. Orders are pixels of a scene of 150 columns; their line items give the
bands, and orders without line items are missing data. Customers are points, parts heights, nations
square stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigrid.operators.segment import block_segments
from lumigrid.operators.tiles import to_tiles
from lumigrid.sources.raster import Scene

WIDTH, BLOCK = 150, 4
BANDS = ("red", "green", "blue", "nir")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tile_id, r, c, tr, tc, red, green, blue, nir, valid), the scene as one tile."""
    bands = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.least(F.lit(255.0), F.lit(20.0) * F.count("*")).alias("red"),
        (F.sum("l_partkey") % 256).cast("double").alias("green"),
        (F.sum("l_suppkey") % 256).cast("double").alias("blue"),
        F.least(F.lit(255.0), F.sum("l_quantity")).alias("nir"),
    )
    o = table(spark, sf_dir, "orders").select("o_orderkey").join(bands, F.col("o_orderkey") == F.col("k"), "left")
    r, c = F.floor(F.col("o_orderkey") / WIDTH).cast("int"), (F.col("o_orderkey") % WIDTH).cast("int")
    return o.select(F.lit(0).alias("tile_id"), r.alias("r"), c.alias("c"), r.alias("tr"), c.alias("tc"), *BANDS, F.col("k").isNotNull().alias("valid"))


def height(spark: SparkSession, sf_dir: str) -> int:
    return int(table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]) // WIDTH + 1


def scene(spark: SparkSession, sf_dir: str) -> Scene:
    return Scene(height(spark, sf_dir), WIDTH, BANDS, 1.0, 0.0, 1.0, 0.0)


def tiled_segments(spark: SparkSession, sf_dir: str, tile: int, overlap: int = 0) -> DataFrame:
    """Pixels of the scene's tiles with seg. Without overlap segments are blocks of the scene, named
    over it, and tiles must be multiples of a block; with overlap they are blocks of each tile."""
    px = to_tiles(pixels(spark, sf_dir).drop("tile_id", "tr", "tc"), height(spark, sf_dir), WIDTH, tile, overlap)
    return block_segments(px, BLOCK, row="tr", col="tc") if overlap else block_segments(px, BLOCK)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with seg, blocks of four by four pixels."""
    return block_segments(pixels(spark, sf_dir), BLOCK)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, score, r, c) of customers on a grid of 50 columns."""
    k = F.col("c_custkey")
    x, y = (k % 50).cast("int"), F.floor(k / 50).cast("int")
    return table(spark, sf_dir, "customer").select(k.alias("id"), x.cast("double").alias("x"), y.cast("double").alias("y"), F.col("c_acctbal").alias("score"), y.alias("r"), x.alias("c"))


def heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(r, c, h) of parts on a grid of 50 columns; sizes 13 and 26 are missing."""
    k = F.col("p_partkey")
    h = F.when(F.col("p_size") % 13 != 0, F.col("p_size").cast("double"))
    return table(spark, sf_dir, "part").select(F.floor(k / 50).cast("int").alias("r"), (k % 50).cast("int").alias("c"), h.alias("h"))


def stands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ring, age): squares of 8 units on a lattice of 10 for each nation."""
    k = F.col("n_nationkey")
    x, y = (k % 5 * 10).cast("double"), (F.floor(k / 5) * 10).cast("double")
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    ring = F.array(corner(x, y), corner(x + 8, y), corner(x + 8, y + 8), corner(x, y + 8))
    return table(spark, sf_dir, "nation").select(k.alias("sid"), ring.alias("ring"), (F.col("n_regionkey") * 5).cast("double").alias("age"))


def overlapping_stands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sid, ring, age): rectangles for each nation, 8 to 14 wide and 6 to 13 high, on the lattice of
    ``stands``: they touch, overlap and, with a small one inside each third, hold one another."""
    k = F.col("n_nationkey")
    x, y = (k % 5 * 10).cast("double"), (F.floor(k / 5) * 10).cast("double")
    large = F.struct(x.alias("x"), y.alias("y"), (8 + k % 3 * 3).cast("double").alias("w"), (6 + k % 2 * 7).cast("double").alias("h"))
    small = F.struct((x + 2).alias("x"), (y + 1).alias("y"), F.lit(4.0).alias("w"), F.lit(3.0).alias("h"))
    both = table(spark, sf_dir, "nation").select(k.alias("sid"), (F.col("n_regionkey") * 5).cast("double").alias("age"), F.explode(F.when(k % 3 == 0, F.array(large, small)).otherwise(F.array(large))).alias("b"))
    x, y, w, h = (F.col(f"b.{c}") for c in "xywh")
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return both.select("sid", F.array(corner(x, y), corner(x + w, y), corner(x + w, y + h), corner(x, y + h)).alias("ring"), "age")


# --- the same views in DuckDB's SQL -----------------------------------------------------------------

PX = """
agg AS (SELECT l_orderkey AS k, least(255e0, 20e0 * count(*)) AS red, CAST(sum(l_partkey) % 256 AS DOUBLE) AS green, CAST(sum(l_suppkey) % 256 AS DOUBLE) AS blue, least(255e0, sum(l_quantity)) AS nir FROM lineitem GROUP BY l_orderkey),
px AS (SELECT CAST(o_orderkey // 150 AS INT) AS r, CAST(o_orderkey % 150 AS INT) AS c, red, green, blue, nir, k IS NOT NULL AS valid FROM orders LEFT JOIN agg ON o_orderkey = k)"""
SEG = PX + """,
seg AS (SELECT *, CASE WHEN valid THEN CAST((r // 4) * 100 + c // 4 AS INT) END AS seg FROM px)"""
PT = "pt AS (SELECT c_custkey AS id, CAST(c_custkey % 50 AS DOUBLE) AS x, CAST(c_custkey // 50 AS DOUBLE) AS y, c_acctbal AS score, CAST(c_custkey // 50 AS INT) AS r, CAST(c_custkey % 50 AS INT) AS c FROM customer)"
HT = "ht AS (SELECT CAST(p_partkey // 50 AS INT) AS r, CAST(p_partkey % 50 AS INT) AS c, CASE WHEN p_size % 13 <> 0 THEN CAST(p_size AS DOUBLE) END AS h FROM part)"
ST = "st AS (SELECT n_nationkey AS sid, CAST(n_nationkey % 5 * 10 AS DOUBLE) AS x0, CAST(n_nationkey // 5 * 10 AS DOUBLE) AS y0, n_regionkey * 5 AS age FROM nation)"
