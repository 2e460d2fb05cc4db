"""Connected components of an edge table by alternating star contraction.

Every round replaces the neighbours of a vertex by links to the smallest vertex near it, with
grouped minima (partial aggregation on the map side) and equi-joins, so a hub is never gathered in
one task. Rounds are cut by tables in the shared checkpoint folder, never by local checkpoints.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_TABLES: list[str] = []
#: A write ends with the removal of the shuffles it made; batches to Python workers are kept small.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only where that is unset and the master is a local one
    it is a temporary folder, which goes when the process ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="lumigrid-")
        atexit.register(shutil.rmtree, _LOCAL["dir"], ignore_errors=True)
    return f"file://{_LOCAL['dir']}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write a frame to a fresh table in the shared folder and read it back, which cuts lineage."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    _TABLES.append(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_seen(df: DataFrame, name: str, **seen: Column) -> tuple[DataFrame, dict]:
    """``cut``, and what aggregates of the rows came to while they were written. A query of its own for
    each would plan, broadcast and run once more, all of which costs the driver memory."""
    watch = Observation()
    out = cut(df.observe(watch, *(c.alias(k) for k, c in seen.items())), name)
    return out, watch.get


def release(df: DataFrame) -> None:
    """Delete the tables of ``cut`` that a frame is read from. Nothing that is still to run may
    depend on them: write what was made of them first."""
    found = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for path in [p for p in _TABLES if any(_plain(f) == _plain(p) for f in found)]:
        _delete(df.sparkSession, path)


def settle(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, written as a table; the tables that were written on the way go."""
    before = set(_TABLES)
    out = cut(make(), name)
    for path in [p for p in _TABLES[:-1] if p not in before]:
        _delete(out.sparkSession, path)
    return out


def cleanup(spark: SparkSession) -> None:
    """Delete all tables that ``cut`` has written, once no frame of this session is needed any more."""
    for path in list(_TABLES):
        _delete(spark, path)


def _plain(path: str) -> str:
    return "/" + path.split(":", 1)[-1].lstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _TABLES.remove(path)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of edges (a, b); large: over all neighbours, else over smaller ones."""
    both = edges.select("a", "b")
    if large:
        both = both.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    joined = both.join(low, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows (vertex, component) for every vertex that has an edge; component is the smallest vertex.

    Self-loops and rows with a null end are ignored; edges may repeat and take either direction.
    """

    def settled(df: DataFrame) -> tuple[DataFrame, dict]:
        return cut_seen(df, "edges", n=F.count(F.lit(1)), mark=F.bit_xor(F.xxhash64("a", "b")))

    at, seen = settled(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    for _ in range(max_rounds if seen["n"] else 0):
        at, now = settled(_star(_star(at, True), False))
        if now == seen:
            break
        seen = now
    else:
        if seen["n"]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = at.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct()
    return at.select(F.col("a").alias("vertex"), F.col("b").alias("component")).union(roots)
