"""Texts whose word shingles have a Jaccard likeness of a given least value, in classes.

Signature bands propose, shingle sets decide. 1. Every distinct text gets the keys of its MinHash
bands. 2. Texts that share a key with another are met with their shingle sets in the bucket of that
key. 3. In a bucket, each text is first held against a few leaders, then a Gray-order index over
SimHash fingerprints of the same sets gives the texts within ``RADIUS`` bits; the ``NEAREST`` of them
are compared unless they are in one component already. That finds most links soon. 4. What is not yet in one
component is then searched in full: of each set the rarest shingles of the bucket, so many that two
sets of the least likeness must share one of them, are listed by shingle, and all pairs that meet in
a list, fit in size and lie in different components are compared. So a bucket's links are those of
all its pairs, at any size. A task returns links that span what it found, never all pairs. Classes
are the connected components of the links.

Texts are told apart by 64-bit hashes; copies cost one row each. Buckets of more than ``BUCKET_ROWS``
texts or ``BUCKET_BYTES`` of sets are dealt out in pairs of blocks, so that each task is bounded and
no pair of texts is left out. Keys of many texts are spread over tasks where rows are joined by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigrid.llm.gray import GrayIndex, spanning
from lumigrid.llm.store import fresh, materialise, materialise_seen, spread_join
from lumigrid.llm.text import mix64, sliced, text_buffer, xxh64
from lumigrid.operators.components import connected_components

BANDS, LIKENESS, SHINGLE_WORDS = 21, 0.8, 5
RADIUS, LEADERS, NEAREST, SEARCH_ROWS, MEET_ROWS, VOTE_ROWS = 24, 8, 8, 64, 1 << 18, 1 << 15
BUCKET_ROWS, BUCKET_BYTES = 4096, 16 << 20


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Likeness of two sorted sets of shingle hashes; two empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def leader_likeness(leader: np.ndarray, flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Likeness of one set to each of the sets flat[first[i]:first[i+1]]."""
    size = np.diff(first)
    hit = np.concatenate([[0], np.cumsum(np.isin(flat, leader))])
    both = hit[first[1:]] - hit[first[:-1]]
    union = size + len(leader) - both
    return np.where(union > 0, both / np.maximum(union, 1), 1.0)


def set_fingerprints(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SimHash of sets of 32-bit hashes: a bit is 1 if it is set in over half of the hashes, each
    drawn out to 64 bits."""
    n, size = len(first) - 1, np.diff(first)
    votes = np.zeros((n, 64), np.int32)
    for at in range(0, len(flat), VOTE_ROWS):  # bounded, however long a text is
        h = mix64(flat[at : at + VOTE_ROWS].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        row = np.searchsorted(first, np.arange(at, at + len(h)), "right") - 1
        own, start = np.unique(row, return_index=True)
        votes[own] += np.add.reduceat(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), start, axis=0, dtype=np.int32)
    return np.packbits(2 * votes > size[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def meeting_pairs(flat: np.ndarray, first: np.ndarray, least: float, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets of different labels that share one of their rarest members, in portions: all
    pairs of likeness ``least`` or more are among them.

    Two sets of sizes s and t with that likeness share ``least`` * s members or more, so in any common
    order of members they share one of the first s - ceil(least * s) + 1 of each.
    """
    size = np.diff(first)
    names, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(names), np.int64)
    rank[np.lexsort((names, count))] = np.arange(len(names))
    row = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((rank[code], row))
    head = np.arange(len(flat)) - first[row] < (size - np.ceil(least * size - 1e-9) + 1)[row]
    shingle, row = rank[code][order][head], row[head]
    order = np.lexsort((label[row], shingle))
    shingle, row = shingle[order], row[order]
    own = label[row]
    # each member of a list meets those of the labels before its own
    start = np.searchsorted(shingle, shingle)
    run = np.flatnonzero(np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (own[1:] != own[:-1])])) if len(row) else np.zeros(0, np.int64)
    many = np.repeat(run, np.diff(np.append(run, len(row)))) - start
    total = np.concatenate([[0], np.cumsum(many)])
    at = 0
    while at < len(row):
        stop = max(at + 1, int(np.searchsorted(total, total[at] + MEET_ROWS, "right")) - 1)
        n = many[at:stop]
        q = np.repeat(np.arange(at, stop), n)
        p = np.repeat(start[at:stop] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        if len(q):
            pair = np.unique(row[q] * len(size) + row[p])
            yield pair // len(size), pair % len(size)
        at = stop


def bucket_labels(sets: list[np.ndarray], fps: np.ndarray, least: float, own: np.ndarray | None = None) -> np.ndarray:
    """For each text of a bucket, the first text of its component under links of likeness
    ``least`` or more; texts with equal ``own`` are not compared."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    label = np.arange(n)

    def settle(q: np.ndarray, p: np.ndarray) -> None:
        """Compare pairs until all that are left are in one component; each text takes one a round."""
        nonlocal label
        fit = np.minimum(size[q], size[p]) >= least * np.maximum(size[q], size[p]) - 1e-9
        if own is not None:
            fit &= own[q] != own[p]
        q, p = q[fit], p[fit]
        while len(q):
            on = label[q] != label[p]
            q, p = q[on], p[on]
            _, take = np.unique(q, return_index=True)
            near = np.array([jaccard(sets[a], sets[b]) >= least for a, b in zip(q[take], p[take], strict=True)], bool)
            label = spanning(q[take][near], p[take][near], n, label)
            rest = np.ones(len(q), bool)
            rest[take] = False
            q, p = q[rest], p[rest]

    if n == 2:
        settle(np.array([1]), np.array([0]))
        return label
    flat, first = np.concatenate(sets), np.concatenate([[0], np.cumsum(size)])
    empty = np.flatnonzero(size == 0)
    if len(empty):
        label = spanning(empty, np.full(len(empty), empty[0]), n, label)
    for _ in range(LEADERS):
        alone = np.flatnonzero(np.bincount(label, minlength=n)[label] == 1)
        if len(alone) < 2:
            break
        lead = alone[len(alone) // 2]
        near = leader_likeness(sets[lead], flat, first) >= least
        if own is not None:
            near &= own != own[lead]
        hit = np.flatnonzero(near)
        label = spanning(hit, np.full(len(hit), lead), n, label)
    most = np.bincount(label, minlength=n).argmax()
    index = GrayIndex(np.zeros(n, np.int64), fps)
    place = np.flatnonzero(label[index.order] != most)
    for at in range(0, len(place), SEARCH_ROWS):
        q, p = index.pairs(place[at : at + SEARCH_ROWS], RADIUS, both_ways=True)
        order = np.lexsort((np.bitwise_count(index.fp[q] ^ index.fp[p]), q))
        q, p = q[order], p[order]
        few = np.arange(len(q)) - np.searchsorted(q, q) < NEAREST  # the others are left to the search in full
        settle(index.order[q[few]], index.order[p[few]])
    if (label != label[0]).any():
        for q, p in meeting_pairs(flat, first, least, label):
            settle(q, p)
    return label


def _walk(least: float):
    """Rows (key, mark, own, fp, shingles) sorted by key in; spanning links of marks out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def found() -> pa.RecordBatch | None:
            if len(held) < 2:
                return None
            marks = np.array([h[0] for h in held], np.int64)
            own = None if held[0][1] is None else np.array([h[1] for h in held])
            label = bucket_labels([np.frombuffer(h[3], np.uint32) for h in held], np.array([h[2] for h in held], np.int64).view(np.uint64), least, own)
            moved = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(marks[moved]), pa.array(marks[label[moved]])], names=["a", "b"]) if len(moved) else None

        for b in batches:
            for k, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != key:
                    if (out := found()) is not None:
                        yield out
                    key, held = k, []
                held.append(row)
        if (out := found()) is not None:
            yield out

    return run


def near_classes(docs: DataFrame, text: str = "text", k: int = SHINGLE_WORDS, least: float = LIKENESS, bands: int = BANDS, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Rows (mark, root), one per distinct text that is linked to another: mark is xxhash64 of the
    text (null: empty), root the smallest mark of its class."""
    from lumigrid.llm.minhash import PERMS, minhash, shingle_hashes

    width = PERMS // bands
    plain = docs.select(F.coalesce(text, F.lit("")).alias("text")).select(F.xxhash64("text").alias("mark"), "text")

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            sig = minhash(*shingle_hashes(*text_buffer(b.column(1)), k))
            n = len(sig)
            keys = np.stack([xxh64(np.frombuffer(np.ascontiguousarray(sig[:, j * width : (j + 1) * width]).tobytes(), np.uint8), np.arange(n) * width * 2, np.full(n, width * 2), seed=j) for j in range(bands)], axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))], names=["mark", "keys"])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            h, first = shingle_hashes(*text_buffer(b.column(1)), k)
            sets = [np.unique(h[x:y]) for x, y in zip(first, first[1:], strict=False)]
            fps = set_fingerprints(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), pa.array([x.tobytes() for x in sets], pa.binary())], names=["mark", "fp", "shingles"])

    keyed = materialise(plain.mapInArrow(keys_of, "mark bigint, keys array<bigint>"), "near-keys")
    # copies of one text, however many, come down to a row before anything is gathered by key
    members = keyed.groupBy("mark").agg(F.first("keys").alias("keys")).select("mark", F.explode("keys").alias("key"))
    many, seen = materialise_seen(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "near-buckets", total=F.sum("n"))
    total = seen["total"] or 0
    met = materialise(spread_join(members, many.select("key"), "key", "left_semi", counts=many, total=total), "near-members")
    wanted = met.select("mark").distinct()
    # copies are dropped on the map side, and what is left moves once; a merge join at any size
    sets = materialise(plain.dropDuplicates(["mark"]).join(wanted.hint("merge"), "mark", "left_semi").mapInArrow(sets_of, "mark bigint, fp bigint, shingles binary"), "near-sets")
    sized = met.join(sets.select("mark", F.octet_length("shingles").cast("long").alias("bytes")), "mark").groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / F.lit(bucket_rows)), F.ceil(F.col("bytes") / F.lit(bucket_bytes)), F.lit(1)).cast("int")
    dealt = spread_join(met, sized.select("key", blocks.alias("blocks")), "key", "inner", counts=many, total=total).withColumn("own", F.pmod(F.xxhash64("mark"), F.col("blocks")).cast("int"))
    dealt = dealt.select("mark", "key", "blocks", "own", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    dealt = dealt.select("mark", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), F.when((F.col("blocks") > 1) & (F.col("own") != F.col("other")), F.col("own")).alias("own"))
    walked = dealt.join(sets, "mark").select("key", "mark", "own", "fp", "shingles").repartition("key").sortWithinPartitions("key", "mark")
    roots = connected_components(walked.mapInArrow(_walk(least), "a bigint, b bigint"))
    return roots.select(F.col("vertex").alias("mark"), F.col("component").alias("root"))


def one_of_each(docs: DataFrame, roots: DataFrame, text: str, id_col: str) -> DataFrame:
    """The rows of ``docs`` without all but one of each class of ``roots`` (mark, root): the smallest
    id stays, a null id only where there is no other, and of repeated rows one."""
    names = fresh(docs, "mark", "root", "id", "count")
    mark, root, own, count = names
    named, seen = materialise_seen(docs.select(F.col(id_col).alias(own), F.xxhash64(F.coalesce(text, F.lit(""))).alias(mark)), "near-names", total=F.count(F.lit(1)))
    named = spread_join(named, roots.select(F.col("mark").alias(mark), F.col("root").alias(root)), mark, total=seen["total"]).withColumn(root, F.coalesce(root, mark))
    rows = named.groupBy(root, own, mark).agg(F.count("*").alias(count))
    best = rows.groupBy(root).agg(F.min(F.struct(F.col(own).isNull().alias("none"), F.col(own), F.col(mark), F.col(count))).alias("f"))
    chosen, seen = materialise_seen(best.select(F.col("f")[own].alias(own), F.col("f")[mark].alias(mark), F.col("f")[count].alias(count)), "near-kept", most=F.max(count))
    out = docs.join(chosen.select(own, mark), F.col(id_col).eqNullSafe(F.col(own)) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col(mark)), "left_semi")
    if (seen["most"] or 0) > 1:
        out = out.withColumn(mark, F.xxhash64(F.coalesce(text, F.lit("")))).dropDuplicates([id_col, mark]).drop(mark)
    return out
