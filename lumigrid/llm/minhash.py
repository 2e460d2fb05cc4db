"""Document fingerprints by MinHash, and near-duplicates found through signature bands.

A fingerprint holds, for each of ``PERMS`` universal hash permutations of the 32-bit integers, the
least value over the text's word shingles (five words, A-Z lower-cased), as a 16-bit hash of that
value: its own leading bits are zero in long texts. The share of equal components estimates the
Jaccard likeness of two texts' shingle sets.

``near_duplicates`` joins texts that share a signature band and verifies the Jaccard likeness of
their shingle sets; classes are the connected components of the verified links (``near``).

Null and empty texts have no shingles; their components all hold 65535, they equal each other and
nothing else. Texts of fewer than five words have their whole word sequence as only shingle.
Repeated rows are separate documents; ties of the id are ordered by text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumigrid.llm import near
from lumigrid.llm.store import materialise, settle, spread_join
from lumigrid.llm.text import binary, mix64, shingles, sliced, text_buffer, words, xxh64

PERMS, SHINGLE_WORDS, SEED = 128, near.SHINGLE_WORDS, 20240131


def _permutations(n: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 1 << 32, n, dtype=np.uint64) | 1).astype(np.uint32), rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)


def shingle_hashes(buf: np.ndarray, offsets: np.ndarray, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of all shingles and the shingle range of each text. A shingle's hash combines
    the hashes of its words in order, so each word is hashed once."""
    w = words(buf, offsets)
    s = shingles(w, k)
    h = xxh64(w.buf, w.start, w.length)
    row = np.repeat(np.arange(len(w.counts)), np.diff(s.first))
    at = w.first[:-1][row] + np.arange(len(row)) - s.first[:-1][row]
    size = np.minimum(w.counts[row], k)
    out = size.astype(np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            on = size > j
            part = h[np.minimum(at + j, len(h) - 1)] if len(h) else h
            out = np.where(on, (out ^ part) * np.uint64(0x9FB21C651E98DF25), out)
            out ^= out >> np.uint64(29)
    return (mix64(out) >> np.uint64(32)).astype(np.uint32), s.first


def minhash(hashes: np.ndarray, first: np.ndarray, perms: int = PERMS) -> np.ndarray:
    """Signatures (texts x perms, 16 bits each) of runs of shingle hashes: hashes of the minima, 65535
    where a run is empty."""
    a, b = _permutations(perms)
    out = np.full((len(first) - 1, perms), 0xFFFF, np.uint16)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        starts = first[:-1][full]
        for p in range(perms):
            least = np.minimum.reduceat(hashes * a[p] + b[p], starts)
            out[full, p] = mix64(least.astype(np.uint64) + np.uint64(1)) >> np.uint64(48)
    return out


def signatures(texts: pa.Array) -> np.ndarray:
    buf, offsets = text_buffer(texts)
    return minhash(*shingle_hashes(buf, offsets))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal components of signatures (rows of both)."""
    return (a == b).mean(axis=1)


# --- each document against its edited text and the next document ----------------------------------

PAIR_SCHEMA = "n_chars bigint, edited_sha256 string, sig binary, edited_sig binary, near_edited double, near_next double, mark bigint"


def _pair_columns(texts: list[str], following: list[str], sig: np.ndarray, next_sig: np.ndarray) -> list[pa.Array]:
    edited = []
    for t, n in zip(texts, following, strict=True):
        k = len(t) // 4
        edited.append(t[: len(t) - k] + n[:k])
    digests = [hashlib.sha256(e.encode()).hexdigest() for e in edited]
    esig = np.concatenate([signatures(b.column(0)) for b in sliced(iter([pa.RecordBatch.from_arrays([pa.array(edited, pa.string())], names=["t"])]), "t")]) if edited else sig[:0]
    return [
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array(digests, pa.string()),
        binary_rows(sig),
        binary_rows(esig),
        pa.array(likeness(sig, esig)),
        pa.array(likeness(sig, next_sig)),
        pa.array(np.array([xxhash.xxh64_intdigest(t, 42) for t in texts], np.uint64).view(np.int64)),
    ]


def binary_rows(sig: np.ndarray) -> pa.Array:
    """Signatures as big-endian bytes, one binary value a row."""
    return binary(np.frombuffer(sig.astype(">u2").tobytes(), np.uint8), np.arange(len(sig) + 1) * sig.shape[1] * 2)


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, columns of PAIR_SCHEMA): each document beside its edited text and the next
    document by ascending id, after the last the first.

    Documents are range-partitioned by id. A partition handles all of its documents but the last;
    the first and last of each partition are written with their texts, and a join of partition
    numbers gives every last document the first one of the next partition that has any.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "part", "is_first", "is_last", "text", *[x.split()[0] for x in PAIR_SCHEMA.split(", ")]]

    def batch(ids: pa.Array, part: int, flags: tuple[list, list], texts: list, rest: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array([part] * len(ids), pa.int32()), *(pa.array(f, pa.bool_()) for f in flags), pa.array(texts, pa.string()), *rest], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, held = TaskContext.get().partitionId(), True, None
        for b in sliced(batches, "text"):
            ids, texts, sig = b.column(0), b.column(1).to_pylist(), signatures(b.column(1))
            if held is not None:
                ids = pa.concat_arrays([held[0], ids])
                texts, sig = [held[1], *texts], np.concatenate([held[2], sig])
            held = (ids.slice(len(ids) - 1), texts[-1], sig[-1:])
            n = len(texts) - 1
            if n:
                first = [start and i == 0 for i in range(n)]
                yield batch(ids.slice(0, n), part, (first, [False] * n), [t if f else None for t, f in zip(texts, first, strict=False)], _pair_columns(texts[:-1], texts[1:], sig[:-1], sig[1:]))
                start = False
        if held is not None:
            yield batch(held[0], part, ([start], [True]), [held[1]], [pa.array([len(held[1])], pa.int64()), pa.nulls(1, pa.string()), binary_rows(held[2]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.int64())])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    done = materialise(rows.mapInArrow(run, f"doc_id {kind}, part int, is_first boolean, is_last boolean, text string, {PAIR_SCHEMA}"), "minhash-pairs")
    firsts = done.where("is_first").select(F.col("part").alias("p"), F.col("text").alias("next_text"), F.col("sig").alias("next_sig"))
    # one row for each partition that has documents
    order = firsts.select("p").withColumn("after", F.lead("p").over(Window.orderBy("p"))).withColumn("after", F.coalesce("after", F.min("p").over(Window.partitionBy(F.lit(1)))))
    lasts = done.where("is_last").select("doc_id", "part", "text", "sig").join(order, F.col("part") == F.col("p")).drop("p").join(firsts, F.col("after") == F.col("p")).select("doc_id", "text", "sig", "next_text", "next_sig")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            sig, after = (np.frombuffer(b"".join(b.column(k).to_pylist()), ">u2").reshape(-1, PERMS).astype(np.uint16) for k in (2, 4))
            yield pa.RecordBatch.from_arrays([b.column(0), *_pair_columns(b.column(1).to_pylist(), b.column(3).to_pylist(), sig, after)], names=[names[0], *names[5:]])

    fixed = lasts.mapInArrow(finish, f"doc_id {kind}, {PAIR_SCHEMA}")
    return done.where("not is_last").select(fixed.columns).union(fixed)


# --- near-duplicates ---------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, bands: int = near.BANDS, least: float = near.LIKENESS, **limits) -> DataFrame:
    """Rows (doc_id, class_id), one per input row: class_id is the smallest id among texts reached
    by links of Jaccard likeness ``least`` or more between texts that share a band of their
    signatures. Equal texts are always in one class; a class of null ids only has a null class_id."""
    roots = settle(lambda: near.near_classes(docs, least=least, bands=bands, **limits), "minhash-roots")
    marked = materialise(docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")), "minhash-marks")
    return spread_join(marked, _class_of(marked, roots), "mark").select("doc_id", "class_id")


def _class_of(marked: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (mark, class_id) from rows (doc_id, mark) and (mark, root)."""
    # copies come down to a row before they meet their class, so a hot text is not joined row by row
    lows = materialise(marked.groupBy("mark").agg(F.min("doc_id").alias("low")), "minhash-texts").join(roots, "mark", "left").withColumn("root", F.coalesce("root", "mark"))
    low = lows.groupBy("root").agg(F.min("low").alias("class_id"))
    return lows.join(low, "root").select("mark", "class_id")


def op1_minhash_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, their likenesses, and the smallest id
    of the document's near-duplicate class."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    roots = settle(lambda: near.near_classes(docs), "minhash-roots")
    pairs = settle(lambda: with_next(docs), "minhash-rows")
    out = spread_join(pairs, _class_of(pairs, roots), "mark", hint="merge")
    return out.select("doc_id", "n_chars", "edited_sha256", F.lower(F.hex("sig")).alias("fingerprint"), F.lower(F.hex("edited_sig")).alias("edited_fingerprint"), "near_edited", "near_next", "class_id")
