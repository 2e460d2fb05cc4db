"""Tables written in between, and joins on keys of which a few may be very frequent.

``spark.checkpoint.dir`` names the folder of such tables; only where it is unset on a local master
(as in tests) a local folder is used. A table written there cuts lineage and survives the loss of
any executor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigrid.operators.components import checkpoint_dir, cut, cut_seen, release, settle

__all__ = ["fresh", "materialise", "materialise_seen", "release", "settle", "shared_dir", "spread_join", "tasks"]


def shared_dir(spark: SparkSession) -> str:
    return checkpoint_dir(spark)


def materialise(df: DataFrame, name: str) -> DataFrame:
    return cut(df, name)


def materialise_seen(df: DataFrame, name: str, **seen: Column) -> tuple[DataFrame, dict]:
    return cut_seen(df, name, **seen)


def tasks(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_join(big: DataFrame, small: DataFrame, key: str, how: str = "left", keys: DataFrame | None = None, counts: DataFrame | None = None, hint: str | None = None, total: int | None = None) -> DataFrame:
    """``big`` joined with ``small`` (a row per key), hot keys spread over tasks.

    A key with more rows than a quarter of a task's share is dealt out by a salt, and its row of
    ``small`` repeated once a salt. There are fewer than four such keys a task, which bounds what is
    broadcast. ``keys`` are the keys of ``big``, a row each, where they can be had for less than by
    reading it once more; ``counts`` a table of (key, n), where the rows of each key are known; ``total``
    the rows of ``big``, where they are; ``hint`` the kind of join, where the planner shall not choose by
    size. Keys must not be null.
    """
    parts = tasks(big.sparkSession)
    at, n, salts, salt, row = fresh(big.select("*", *(F.lit(0).alias(c) for c in small.columns if c not in big.columns)), "at", "n", "salts", "salt", "key")
    if counts is None:
        counts = (big if keys is None else keys).groupBy(key).agg(F.count("*").alias("n"))
        total = (big if keys is None else keys).count() if total is None else total
    elif total is None:
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    share = max(1, total // (4 * parts))
    hot = counts.select(F.col(key).alias(row), F.col("n").alias(n)).where(F.col(n) > share).select(row, F.ceil(F.col(n) / share).cast("int").alias(salts))
    dealt = big.withColumn(at, F.monotonically_increasing_id()).join(F.broadcast(hot), F.col(key) == F.col(row), "left").withColumn(salt, F.pmod(F.xxhash64(at), F.coalesce(salts, F.lit(1))).cast("int")).drop(at, salts, row)
    copies = small.join(F.broadcast(hot), F.col(key) == F.col(row), "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(salts, F.lit(1)) - 1))).drop(salts, row)
    return dealt.join(copies.hint(hint) if hint else copies, [key, salt], how).drop(salt)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names for internal use that ``df`` does not have, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        k = 0
        while (made := f"__{name}{k or ''}") in taken:
            k += 1
        taken.add(made)
        out.append(made)
    return out
