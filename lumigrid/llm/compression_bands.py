"""Quality rules from compression: zstandard ratios of whole documents and of fixed chunks.

A text compresses in proportion to how much it says. Each length band has limits for the ratio of
compressed to plain bytes: below them the text repeats itself, above them it is noise. The whole
text and each of its chunks of ``CHUNK`` bytes are judged by the band of their own length; a
document goes if the whole is outside its band or too many chunks are. Lengths under the first
band are not judged. Word and line counts come with the verdict, computed over whole batches.

Null and empty texts count nothing and fail the base rule (under 50 words). Each input row gives
one row; null ids and repeated rows pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigrid.llm.text import mix64, shingles, sliced, text_buffer, words, xxh64

#: (bytes from, lowest ratio, highest ratio): a band reaches to the next one's start.
BANDS = ((64, 0.35, 1.25), (256, 0.33, 0.90), (1024, 0.30, 0.75), (4096, 0.26, 0.68))
CHUNK, MIN_CHUNK, BAD_CHUNKS, LEVEL = 4096, 1024, 0.3, 3
MIN_WORDS, REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"

SCHEMA = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, ratio double, n_chunks bigint, bad_chunks bigint, verdict boolean"


def in_band(size: int, ratio: float, bands=BANDS) -> bool:
    for start, low, high in reversed(bands):
        if size >= start:
            return low <= ratio <= high
    return True


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: does it occur twice or more in its row; has it occurred before."""
    if not len(h):
        return np.zeros(0, bool), np.zeros(0, bool)
    with np.errstate(over="ignore"):
        key = mix64(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = np.concatenate([[False], key[order][1:] == key[order][:-1]])
    again, many = np.zeros(len(h), bool), np.zeros(len(h), bool)
    again[order] = same
    many[order] = same | np.append(same[1:], False)
    return many, again


def measure(texts: pa.Array, bands=BANDS) -> list[np.ndarray]:
    """The columns of SCHEMA for a batch of whole texts."""
    buf, offsets = text_buffer(texts)
    rows = len(offsets) - 1
    w = words(buf, offsets, lower=False)
    table = np.zeros(256, bool)
    table[list(SYMBOLS)] = True
    symbols = _per_row(table[buf], offsets)
    head = (w.buf != 0x20) & ((w.buf & 0xC0) != 0x80)
    word_at = np.append(w.start, len(w.buf))[w.first]
    chars = _per_row(head, word_at)
    # lines
    breaks = np.flatnonzero(buf == 10)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    line_row = np.concatenate([np.arange(rows), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((starts, line_row))
    starts, line_row = starts[order], line_row[order]
    ends = np.append(starts[1:] - 1, len(buf))
    last = np.append(line_row[1:] != line_row[:-1], True)
    ends[last] = offsets[line_row[last] + 1]
    space = np.isin(buf, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
    solid = np.concatenate([[0], np.cumsum(~space, dtype=np.int64)])
    on = solid[ends] > solid[starts]
    starts, ends, line_row = starts[on], ends[on], line_row[on]
    _, again = _repeats(line_row, xxh64(buf, starts, ends - starts))
    dup_lines = np.bincount(line_row[again], minlength=rows)
    # words in repeated three-word windows
    s = shingles(w, 3)
    s_row = np.repeat(np.arange(rows), np.diff(s.first))
    first_word = w.first[:-1][s_row] + np.arange(len(s_row)) - s.first[:-1][s_row]
    on = w.counts[s_row] >= 3
    many, _ = _repeats(s_row[on], xxh64(w.buf, s.start[on], s.length[on]))
    hit = first_word[on][many]
    edge = np.zeros(len(w.start) + 4, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + 3, -1)
    repeat = _per_row(np.cumsum(edge)[: len(w.start)] > 0, w.first)
    # compression
    z = zstandard.ZstdCompressor(level=LEVEL)
    raw = memoryview(np.ascontiguousarray(buf))
    ratio, n_chunks, bad, verdict = np.zeros(rows), np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, bool)
    for r in range(rows):
        a, b = int(offsets[r]), int(offsets[r + 1])
        if a == b:
            continue
        ratio[r] = len(z.compress(raw[a:b])) / (b - a)
        parts = [(x, min(x + CHUNK, b)) for x in range(a, b, CHUNK)] if b - a > CHUNK else []
        judged = [(y - x, len(z.compress(raw[x:y])) / (y - x)) for x, y in parts if y - x >= MIN_CHUNK]
        n_chunks[r], bad[r] = len(judged), sum(not in_band(*c, bands) for c in judged)
        verdict[r] = in_band(b - a, ratio[r], bands) and bad[r] <= BAD_CHUNKS * len(judged)
    return [w.counts, chars, symbols, dup_lines, repeat, ratio, n_chunks, bad, verdict]


def quality(df: DataFrame, text: str = "text", id_col: str = "doc_id", bands=BANDS) -> DataFrame:
    """Rows (id, columns of SCHEMA), one per input row; verdict false where a band is left."""
    kind = df.schema[id_col].dataType.simpleString()
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, measure(b.column(1), bands))], names=["id", *names])

    return df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, {SCHEMA}")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts, base rule and verdict of every document."""
    out = quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("verdict")).alias("kept"), "ratio", "n_chunks", "bad_chunks")
