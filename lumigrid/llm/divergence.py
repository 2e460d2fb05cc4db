"""Divergence of the term distributions of sources, per language, with exact counts.

Two passes over the texts. The first adds up a count-min sketch of document frequencies: every task
counts, per slice of texts, the documents that hold a (language, term), in ``DEPTH`` rows of
``WIDTH`` cells. Counters stop at the least frequency that is asked for, which a sum of such
counters still never underestimates, so a cell is one byte; tasks hand over their sketch in chunks,
and chunks of all tasks are added by number. What the second pass needs is a bit for each cell,
DEPTH * WIDTH / 8 bytes (2 MB) at any size of the input, which is broadcast: a term one of whose
cells is below the least frequency cannot reach it and is dropped before anything is shuffled. The
rest is counted exactly by (language, source, term), summed in the task first; terms that passed the
sketch by chance go by their exact document frequency.

With N the occurrences of kept terms in a group, V the kept terms of the language and c a term's
occurrences in the group, p = 1 + floor(SCALE * (c + 2) / (N + 2 * V)); two groups differ at a term by
floor((p - q)**2 / (p + q)). Sums over all kept terms never build the dense table: all terms are
taken as absent in both groups, terms of one group correct that by their count (terms of equal count
together), and a join of sparse counts by term corrects those of both. All of it is whole-number
arithmetic, in decimals where it may pass the range of a long.

Null texts, languages and sources are empty strings; a group without terms has N = 0 and takes part.
Repeated rows are documents each. Empty tables give no rows. Columns other than the named ones are
not read. Whole texts are read, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumigrid.llm.store import materialise
from lumigrid.llm.text import Words, mix64, sliced, text_buffer, words, xxh64

DEPTH, WIDTH, CHUNK = 4, 1 << 22, 1 << 18
LEAST_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
SLICE = 4 << 20

#: Letters and all bytes of other alphabets are kept, A-Z in lower case; the rest parts terms.
_TERM = np.full(256, 0x20, np.uint8)
_TERM[97:123] = _TERM[65:91] = np.arange(97, 123, dtype=np.uint8)
_TERM[128:] = np.arange(128, 256, dtype=np.uint8)


def _coded(w: Words) -> tuple[pa.Array, np.ndarray]:
    """Distinct terms of a batch, each with the space that follows it, and the term of each word."""
    offsets = np.append(w.start, len(w.buf)).astype(np.int64)
    flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(w.start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(w.buf))])
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Per slice of texts: names and number of each row's group of leading columns, distinct terms,
    and the row and term of each word."""
    for b in sliced(batches, "text", SLICE):
        w = words(*text_buffer(b.column(b.num_columns - 1)), table=_TERM)
        groups = [c.dictionary_encode() for c in b.columns[:-1]]
        code = np.zeros(b.num_rows, np.int64)
        for g in groups:
            code = code * len(g.dictionary) + g.indices.to_numpy(zero_copy_only=False)
        held, own = np.unique(code, return_inverse=True)
        names, rest = [], held
        for g in reversed(groups):
            names.insert(0, g.dictionary.take(pa.array(rest % len(g.dictionary))))
            rest = rest // len(g.dictionary)
        terms, term = _coded(w)
        yield names, own, terms, w.rows(), term


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(key, return_counts=True)


def _cells(langs: pa.Array, terms: pa.Array, lang: np.ndarray, term: np.ndarray, depth: int, width: int) -> np.ndarray:
    """The sketch cells (depth rows, one column for each pair) of pairs of language and term."""

    def hashed(a: pa.Array, seed: int) -> np.ndarray:
        buf, offsets = text_buffer(a)
        return xxh64(buf, offsets[:-1], np.diff(offsets), seed)

    with np.errstate(over="ignore"):
        h = mix64(hashed(langs, 1)[lang] + hashed(terms, 2)[term] * np.uint64(0x9E3779B97F4A7C15))
        step = mix64(h) | np.uint64(1)
        return np.stack([((h + np.uint64(d) * step) >> np.uint64(20)) % np.uint64(width) for d in range(depth)]).astype(np.int64) + np.arange(depth)[:, None] * width


def _doc_freq(own: np.ndarray, row: np.ndarray, term: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, term and number of documents for each group and term that meet."""
    once = np.unique(row * n_terms + term)
    key, n = _counted(own[once // n_terms] * n_terms + once % n_terms)
    return key // n_terms, key % n_terms, n


def frequency_bits(docs: DataFrame, least: int, depth: int = DEPTH, width: int = WIDTH, chunk: int = CHUNK) -> list[tuple[int, bytes]]:
    """The chunks (number, bits) of the merged sketch over ``docs`` (lang, text): a cell's bit is set
    where its count is ``least`` or more. Chunks without a set bit are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(depth * width, np.uint8)
        for names, own, terms, row, term in _slices(batches):
            if len(term):
                g, t, n = _doc_freq(own, row, term, len(terms))
                for at in _cells(names[0], terms, g, t, depth, width):
                    cell, where = np.unique(at, return_inverse=True)
                    sketch[cell] = np.minimum(sketch[cell] + np.bincount(where, n), least)
        made = sketch.reshape(-1, chunk)
        used = np.flatnonzero(made.any(axis=1))
        pack = zstandard.ZstdCompressor(level=1)
        for k in used:  # a chunk at a time
            yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([pack.compress(made[k].tobytes())], pa.binary())], names=["chunk", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for k, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                more = np.frombuffer(unpack.decompress(cells), np.uint8).astype(np.uint16)
                held[k] = np.minimum(held.get(k, np.uint16(0)) + more, least).astype(np.uint8)
        for k, cells in held.items():
            bits = np.packbits(cells >= least)
            if bits.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["chunk", "bits"])

    parts = docs.mapInArrow(count, "chunk int, cells binary").repartition(depth * width // chunk, "chunk")
    return [tuple(r) for r in parts.mapInArrow(merge, "chunk int, bits binary").collect()]  # DEPTH * WIDTH / 8 bytes at most


def term_counts(docs: DataFrame, least: int = LEAST_DOCS, depth: int = DEPTH, width: int = WIDTH, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """Rows (lang, source, term, n): exact occurrences of the terms that at least ``least`` documents
    of the language hold, where there are any."""
    if least > 255 or width % 8:
        raise ValueError("counters are bytes: least may be 255, width a multiple of 8")
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(o) for c, o in ((lang, "lang"), (source, "source"), (text, "text"))))
    chunk = min(CHUNK, width)
    bits = docs.sparkSession.sparkContext.broadcast(frequency_bits(plain.select("lang", "text"), least, depth, width, chunk))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((depth * width // chunk, chunk // 8), np.uint8)
        for k, b in bits.value:
            table[k] = np.frombuffer(b, np.uint8)
        table = table.ravel()
        for names, own, terms, row, term in _slices(batches):
            if not len(term):
                continue
            g, t, docs_of = _doc_freq(own, row, term, len(terms))
            at = _cells(names[0], terms, g, t, depth, width)
            may = ((table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)
            key, n = _counted(own[row] * len(terms) + term)  # in the order of the keys of _doc_freq
            out = [c.take(pa.array(g[may])) for c in names] + [terms.take(pa.array(t[may])).cast(pa.binary()), pa.array(n[may]), pa.array(docs_of[may])]
            yield pa.RecordBatch.from_arrays(out, names=["lang", "source", "term", "n", "docs"])

    found = plain.mapInArrow(count, "lang string, source string, term binary, n bigint, docs bigint")
    exact = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = exact.withColumn("all", F.sum("docs").over(Window.partitionBy("lang", "term"))).where(F.col("all") >= least)
    return kept.select("lang", "source", F.expr("substring(cast(term as string), 1, char_length(cast(term as string)) - 1)").alias("term"), "n")


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)) as a long."""
    top = (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", top, (total + 2 * kept).cast("decimal(20,0)")) + 1


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / (p + q)); shares are at most SCALE + 1, so that squares fit a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, lang: str = "lang", source: str = "source", text: str = "text", depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """Rows (lang, source, part, item, value, rank). ``pair``: the summed gaps of a group to every
    other source of its language; ``term``: the ``top`` terms that a group uses more than its
    language, by their gap. Ranks fall with value; ties go by the item."""
    groups = materialise(docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).distinct(), "divergence-groups")
    counts = materialise(term_counts(docs, least, depth, width, lang, source, text), "divergence-counts")
    by_term = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    langs = by_term.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sized = groups.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["kept", "lang_total", "total"])
    sized = materialise(sized.withColumn("p0", F.when(F.col("kept") > 0, _share(F.lit(0).cast("long"), F.col("total"), F.col("kept")))), "divergence-groups")
    shares = counts.join(sized, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("kept")))

    over = shares.join(by_term.withColumnRenamed("n", "lang_n"), ["lang", "term"]).withColumn("q", _share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))).where("p > q")
    over = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))

    other = sized.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    # absent in both: every kept term
    none = sized.join(other, "lang").where("source <> item").select("lang", "source", "item", F.coalesce(F.col("kept") * _gap(F.col("p0"), F.col("q0")), F.lit(0)).alias("value"))
    # in one of them: terms of equal share together
    alike = shares.groupBy("lang", "source", "p0", "p").agg(F.count("*").alias("terms"))
    single = alike.join(other, "lang").where("source <> item").select("lang", "source", "item", (F.col("terms") * (_gap(F.col("p"), F.col("q0")) - _gap(F.col("p0"), F.col("q0")))).alias("value"))
    single = single.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    mirrored = single.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    # in both
    right = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    p, p0, q, q0 = (F.col(c) for c in ("p", "p0", "q", "q0"))
    meet = shares.select("lang", "term", "source", "p", "p0").join(right, ["lang", "term"]).where("source < item")
    meet = meet.groupBy("lang", "source", "item").agg(F.sum(_gap(p, q) - _gap(p, q0) - _gap(p0, q) + _gap(p0, q0)).alias("value"))
    meet = meet.unionByName(meet.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = none.unionByName(single).unionByName(mirrored).unionByName(meet).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    order = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = [f.withColumn("rank", order) for f in (pairs, over)]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top)).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    """How far the sources of every language lie from one another, and the terms that mark them."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
o AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(t, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
tc AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY ALL),
kt AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT k) >= {LEAST_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
dense AS (SELECT g.lang, g.source, kt.term, coalesce(n, 0) AS n FROM g JOIN kt ON g.lang = kt.lang LEFT JOIN tc ON tc.lang = g.lang AND tc.source = g.source AND tc.term = kt.term),
gp AS (SELECT lang, source, term, n, 1 + CAST({SCALE} AS HUGEINT) * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p FROM dense),
ln AS (SELECT lang, term, sum(n) AS n FROM dense GROUP BY ALL),
lp AS (SELECT lang, term, 1 + CAST({SCALE} AS HUGEINT) * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q FROM ln),
pr AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN gp x ON x.lang = a.lang AND x.source = a.source LEFT JOIN gp y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
tm AS (SELECT gp.lang, source, gp.term AS item, (p - q) * (p - q) // (p + q) AS value FROM gp JOIN lp ON gp.lang = lp.lang AND gp.term = lp.term WHERE n > 0 AND p > q),
u AS (SELECT lang, source, 'pair' AS part, item, value FROM pr UNION ALL SELECT lang, source, 'term', item, value FROM tm),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM r WHERE part = 'pair' OR rank <= {TOP}"""
