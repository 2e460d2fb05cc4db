"""SimHash near-duplicates found with a Gray-order hierarchical index.

``fingerprints`` gives each text a 64-bit SimHash over word shingles. ``near_groups`` links
fingerprints that differ in at most ``radius`` bits and returns the connected groups.

Links are searched among distinct fingerprints only, so copies cost one row each. A fingerprint is
routed once per block of bits (pigeonhole: two fingerprints within the radius agree in one of
``radius + 1`` blocks), buckets beyond ``bucket_limit`` are routed again by blocks of the other
bits. In a bucket the fingerprints are sorted by Gray rank, runs of them become leaves whose shared
bits are factored into a (mask, pattern) pair, runs of leaves become upper nodes, and a search adds
up the differences from the top down and leaves a whole group as soon as they pass the radius. A
task returns spanning links of what it found rather than pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumigrid.llm import near
from lumigrid.llm.gray import GrayIndex, spanning
from lumigrid.llm.store import materialise, settle, spread_join
from lumigrid.llm.text import Shingles, Words, shingles, sliced, text_buffer, words, xxh64
from lumigrid.operators.components import connected_components

RADIUS, SHINGLE_WORDS = 3, 3
VOTE_ROWS = 1 << 15


def simhash(texts: pa.Array, k: int = SHINGLE_WORDS) -> np.ndarray:
    """SimHash of each text: a bit is 1 if it is set in over half the shingles' hashes."""
    buf, offsets = text_buffer(texts)
    w = words(buf, offsets)
    return votes_of(w, shingles(w, k))


def votes_of(w: Words, s: Shingles) -> np.ndarray:
    """Majority bits of the shingles' hashes, for each row."""
    per = np.diff(s.first)
    out = np.zeros(len(per), np.uint64)
    votes = np.zeros((len(per), 64), np.int32)
    for at in range(0, len(s.start), VOTE_ROWS):  # bounded, however long a text is
        h = xxh64(w.buf, s.start[at : at + VOTE_ROWS], s.length[at : at + VOTE_ROWS])
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row = np.searchsorted(s.first, np.arange(at, at + len(h)), "right") - 1
        own, first = np.unique(row, return_index=True)
        votes[own] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    full = np.flatnonzero(per)
    out[full] = np.packbits(2 * votes[full] > per[full, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(df: DataFrame, text: str = "text", id_col: str = "doc_id", k: int = SHINGLE_WORDS) -> DataFrame:
    """Rows (id, fp, mark): the SimHash as a signed long and a hash that names the text; one row per
    input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(simhash(b.column(1), k).view(np.int64)), b.column(2)], names=["id", "fp", "mark"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark")).mapInArrow(run, f"id {kind}, fp bigint, mark bigint")


def _bucket_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        key, fp = table["key"].to_numpy(), table["fp"].to_numpy().view(np.uint64)
        order = np.argsort(key, kind="stable")
        key, fp = key[order], fp[order]
        size = np.diff(np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)))
        on = np.repeat(size > 1, size)
        key, fp = key[on], fp[on]
        if not len(fp):
            return
        index = GrayIndex(key, fp)
        names, at = np.unique(index.fp, return_inverse=True)
        label, cost = np.arange(len(names)), np.repeat(size[size > 1], size[size > 1])
        group = np.cumsum(np.minimum(cost, 4096)) // 500_000
        for rows in np.split(np.arange(len(fp)), np.flatnonzero(np.diff(group)) + 1):
            q, p = index.pairs(rows, radius)
            label = spanning(at[q], at[p], len(names), label)
        moved = np.flatnonzero(label != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[moved].view(np.int64)), pa.array(names[label[moved]].view(np.int64))], names=["a", "b"])

    return run


def _blocks(parts: int, bits: int, base: int = 0) -> list[tuple[int, int]]:
    cuts = [base + bits * i // parts for i in range(parts + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def _field(lo: int, hi: int) -> Column:
    return F.shiftrightunsigned(F.col("fp"), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))


def near_links(distinct: DataFrame, radius: int = RADIUS, bucket_limit: int = 50_000, fp_col: str = "fp") -> DataFrame:
    """Links (a, b) between distinct fingerprints that span every group within the radius."""
    blocks = _blocks(radius + 1, 64)
    routed = distinct.select(F.col(fp_col).alias("fp")).select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("block"), _field(*b).alias("value")) for i, b in enumerate(blocks)])).alias("k")).select("fp", "k.block", "k.value")
    hot = routed.groupBy("block", "value").count().where(F.col("count") > bucket_limit).select("block", "value", F.lit(True).alias("hot"))
    rest = F.lit(None).cast("array<bigint>")
    for i, (lo, hi) in enumerate(blocks):
        others = [x for j, b in enumerate(blocks) if j != i for x in _blocks(1, b[1] - b[0], b[0])]
        bits = [p for b in others for p in range(*b)]
        subs = [bits[len(bits) * s // (radius + 1) : len(bits) * (s + 1) // (radius + 1)] for s in range(radius + 1)]
        keyed = F.array(*[F.xxhash64("block", "value", F.lit(s), F.col("fp").bitwiseAND(F.lit(sum(1 << p for p in sub) - (1 << 64) * (63 in sub)))) for s, sub in enumerate(subs)])
        rest = F.when((F.col("block") == i) & F.col("hot"), keyed).otherwise(rest)
    keyed = routed.join(hot, ["block", "value"], "left").select("fp", F.explode(F.coalesce(rest, F.array(F.xxhash64("block", "value")))).alias("key"))
    return keyed.repartition("key").mapInArrow(_bucket_links(radius), "a bigint, b bigint")


def near_groups(df: DataFrame, text: str = "text", id_col: str = "doc_id", k: int = SHINGLE_WORDS, radius: int = RADIUS, bucket_limit: int = 50_000) -> DataFrame:
    """Rows (id, fp, mark, root, component_id), one per input row.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the smallest id
    reachable. Null and empty texts have fingerprint 0 and are linked like any other; rows with a
    null id take part, and a group of only such rows has a null component_id. Repeated rows stay
    repeated. root is the smallest fingerprint (as a signed long) of the group.
    """
    fps = materialise(fingerprints(df, text, id_col, k), "simhash")
    distinct = materialise(fps.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n")), "simhash-distinct")
    roots = connected_components(near_links(distinct, radius, bucket_limit))
    named = distinct.join(roots.withColumnRenamed("vertex", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return spread_join(fps, named.select("fp", "root").join(lows, "root"), "fp", "inner", counts=distinct).select("id", "fp", "mark", "root", "component_id")


def drop_near_duplicates(df: DataFrame, text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``df`` without all but one of each group of ``near_groups``: the smallest id stays
    (a null id only where there is no other, of repeated rows one)."""
    groups = near_groups(df, text, id_col, **options)
    roots = groups.groupBy("mark").agg(F.min("root").alias("root"))
    return near.one_of_each(df, materialise(roots, "simhash-roots"), text, id_col)


def drop_near_copies(df: DataFrame, text: str = "text", id_col: str = "doc_id", k: int = near.SHINGLE_WORDS, likeness: float = near.LIKENESS) -> DataFrame:
    """The rows of ``df`` without all but one of each group of texts that Jaccard likenesses of
    ``likeness`` or more over k-word shingles connect; which stays is as in
    ``drop_near_duplicates``.

    Such texts differ in about 10 of 64 SimHash bits, too many to route fingerprints by blocks of
    bits. So bands of MinHash are the buckets, in which the Gray-order index over fingerprints of the
    shingle sets is searched at a radius of 24 bits, the sets decide, and what is not in one group
    by then is searched in full by its rarest shingles.
    """
    return near.one_of_each(df, settle(lambda: near.near_classes(df, text, k, likeness), "simhash-classes"), text, id_col)


def op5_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_groups(docs).select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
