"""Packing documents into training sequences by non-negative least squares on their lengths.

A document is its token ids and an end id. Whole windows are cut off first; what remains is cut
into a body of a multiple of ``QUANTUM`` tokens and a tail of fewer. Combinations of up to
``DEPTH`` body lengths that fill a window exactly are enumerated, and the number of times each is
used is the non-negative least-squares solution against the histogram of body lengths, rounded
down. Bodies that no combination takes, then tails, are packed greedily: laid end to end, cut where
a window is full. Only the last window can be partly filled; it is cut into powers of two, which
need no padding.

Tokenizing writes one row per document, with running counts per task. From there every place is
arithmetic on a document's rank among the bodies of its length: the driver sees a histogram of
``WINDOW / QUANTUM`` rows, and combinations in use are at most as many, which bounds what is
broadcast. Token ids are shuffled once, to meet their task's offsets.

Null and empty texts are the end id alone. Repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumigrid.llm.store import materialise, materialise_seen
from lumigrid.llm.text import binary, sliced, text_buffer, words

WINDOW, QUANTUM, DEPTH, END_ID = 2048, 16, 3, 1
TOKENIZE_BYTES = 4 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# --- tokens ------------------------------------------------------------------------------------------


class WordTokenizer:
    """Ids as ``tokenizers`` gives them for a BPE file with word ends (add_special_tokens=False).

    Such a tokenizer never joins text across white space, so each distinct word of a batch is encoded
    once, and all of them in one call: as a text of pieces that each close with a line feed, which no
    word holds and which stands for the word end in the file's own vocabulary. A space as a piece of
    its own parts words. Pieces go through the byte-pair core of ``tiktoken``; texts with a special
    token's string go through ``tokenizers`` itself, and so do words with a character that its tables,
    of another version of Unicode, know otherwise.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken._tiktoken as core
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        names = {t["content"] for t in spec["added_tokens"]}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            if token not in names:
                end = token.endswith("</w>")
                ranks[bytes(byte[c] for c in (token[:-4] if end else token)) + b"\n" * end] = i
        self.core = core.CoreBPE(ranks, {}, r"[^\n]+\n")
        self.gap = ranks[b" \n"]
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(f"{split}| ").findall
        self.shown = {b: c for c, b in byte.items()}
        self.same = {" "}
        self.differ: set[str] = set()

    def split(self, text: str) -> list[str]:
        """Pieces of words that each close with a space, and that space."""
        if not text.isascii():
            # only a sigma's lower case depends on what stands around it
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()
        return self.pieces(text)

    def parts(self, word: str) -> list[str]:
        """Pieces by ``tokenizers``, a character for each byte."""
        return [piece for piece, _ in self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(word))]

    def odd(self, text: str) -> set[str]:
        """Characters of a text that ``tokenizers`` knows otherwise; each is tried once."""
        if text.isascii():
            return set()
        found = set(text) - self.same
        for c in found - self.differ:
            word = f"a{c}b1{c}1{c}'s"
            same = unicodedata.category(c) != "Cn" and ["".join(self.shown[b] for b in x.encode()) for x in self.split(word)] == self.parts(word)
            (self.same if same else self.differ).add(c)
        return found & self.differ

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch and the range of each text, each text closed by END_ID."""
        buf, offsets = text_buffer(texts)
        w = words(buf, offsets)
        rows = len(offsets) - 1
        spaced = np.append(w.start, len(w.buf)).astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(w.start), [None, pa.py_buffer(spaced), pa.py_buffer(w.buf)]).dictionary_encode()
        text = text_buffer(coded.dictionary)[0].tobytes().decode()
        ids = np.array(self.core.encode_ordinary("\n".join([*self.split(text), ""])), np.uint32)
        gaps = np.flatnonzero(ids == self.gap)
        begin = np.concatenate([[0], gaps + 1])  # the last is that of END_ID
        size = np.append(gaps - begin[:-1], 1)
        ids = np.append(ids, np.uint32(END_ID))
        if odd := self.odd(text):
            # a special token's string in such a word is none: parts are taken before
            other = [(k, [t.id for x in self.parts(word) for t in self.whole.model.tokenize(x)]) for k, word in enumerate(text.split(" ")) if not odd.isdisjoint(word)]
            at, sizes = [k for k, _ in other], np.array([len(x) for _, x in other])
            begin[at], size[at] = len(ids) + np.cumsum(sizes) - sizes, sizes
            ids = np.append(ids, np.array([i for _, x in other for i in x], np.uint32))
        ends = w.first[1:] + np.arange(rows)
        code = np.full(len(w.start) + rows, len(gaps))
        inside = np.ones(len(code), bool)
        inside[ends] = False
        code[inside] = coded.indices.to_numpy()
        per = size[code]
        stop = np.cumsum(per)
        out = ids[np.repeat(begin[code] - (stop - per), per) + np.arange(per.sum())]
        first = np.concatenate([[0], stop[ends]])
        raw = buf.tobytes()
        if any(s in raw for s in self.special):
            return self._special(raw, offsets, out, first)
        return out, first

    def _special(self, raw: bytes, offsets: np.ndarray, out: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        for r in range(len(offsets) - 1):
            text = raw[offsets[r] : offsets[r + 1]]
            if any(s in text for s in self.special):
                parts.append(np.array([*self.whole.encode(text.decode(), add_special_tokens=False).ids, END_ID], np.uint32))
            else:
                parts.append(out[first[r] : first[r + 1]])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


# --- the plan ----------------------------------------------------------------------------------------


def combinations(bins: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Ascending tuples of 1 to ``depth`` lengths below ``bins`` that add up to ``bins``."""
    out: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int, least: int) -> None:
        if least <= left < bins and len(head) < depth:
            out.append((*head, left))
        if len(head) + 1 < depth:
            for x in range(least, left // 2 + 1):
                grow((*head, x), left - x, x)

    grow((), bins, 1)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Non-negative least squares by active sets (Lawson and Hanson)."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tol = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[passive] = -np.inf
        if not len(w) or w.max() <= tol:
            break
        passive[int(np.argmax(w))] = True
        while True:
            s = np.zeros_like(x)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            bad = passive & (s <= 0)
            if not bad.any():
                x = s
                break
            step = (x[bad] / (x[bad] - s[bad])).min()
            x = x + step * (s - x)
            passive &= x > 1e-12
            x[~passive] = 0
    return x


def plan(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """How often to use which combination of lengths, given counts by length (index 0 unused)."""
    bins = len(histogram)
    combos = [c for c in combinations(bins, depth) if all(histogram[x] for x in c)]
    if not combos:
        return []
    use = np.zeros((bins, len(combos)))
    for j, c in enumerate(combos):
        for x in c:
            use[x, j] += 1
    scale = float(histogram.max())
    x = nnls(use, histogram / scale) * scale
    left, out = histogram.astype(np.int64).copy(), []
    for j in sorted(np.flatnonzero(x >= 1), key=lambda j: (-x[j], combos[j])):
        need = use[:, j].astype(np.int64)
        times = int(min(np.floor(x[j] + 1e-6), *(left[need > 0] // need[need > 0])))
        if times > 0:
            left -= need * times
            out.append((combos[j], times))
    return out


def last_cuts(total: int, window: int = WINDOW) -> list[int]:
    """Where the last, partly filled window starts and is cut so that parts are powers of two."""
    at, out, m = total - total % window, [], total % window
    for bit in range(window.bit_length(), -1, -1):
        if m >> bit & 1:
            out.append(at)
            at += 1 << bit
    return out


def token_table(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", window: int = WINDOW, quantum: int = QUANTUM) -> DataFrame:
    """Rows (id, ids, n, part, bin, bin_rank, full_rank, tail_rank): ids as little-endian 32-bit
    integers; ranks count within the writing task."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, fulls, tails = TaskContext.get().partitionId(), np.zeros(window // quantum, np.int64), 0, 0
        for b in sliced(batches, "text", TOKENIZE_BYTES):
            ids, first = tokenizer(path).batch(b.column(1))
            n = np.diff(first)
            full, bins, tail = n // window, n % window // quantum, n % quantum
            order = np.argsort(bins, kind="stable")
            count = np.bincount(bins, minlength=len(seen))
            rank = np.empty(len(n), np.int64)
            rank[order] = np.arange(len(n)) - np.repeat(np.cumsum(count) - count, count)
            rank += seen[bins]
            seen += count
            full_rank, tail_rank = fulls + np.cumsum(full) - full, tails + np.cumsum(tail) - tail
            fulls, tails = fulls + int(full.sum()), tails + int(tail.sum())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), binary(ids.astype("<u4").view(np.uint8), first * 4), pa.array(n), pa.array([part] * len(n), pa.int32()), pa.array(bins.astype(np.int32)), pa.array(rank), pa.array(full_rank), pa.array(tail_rank)],
                names=["id", "ids", "n", "part", "bin", "bin_rank", "full_rank", "tail_rank"],
            )

    schema = f"id {kind}, ids binary, n bigint, part int, bin int, bin_rank bigint, full_rank bigint, tail_rank bigint"
    return docs.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str | None = None, text: str = "text", id_col: str = "doc_id", window: int = WINDOW, quantum: int = QUANTUM, depth: int = DEPTH) -> DataFrame:
    """Rows (id, start, length, doc_tokens, sequence_id, offset, ids), one per piece; ids is
    little-endian 32-bit integers. Sequences are full windows, or powers of two at the very end."""
    spark = docs.sparkSession
    tokens, seen = materialise_seen(token_table(docs, path or default_tokenizer(), text, id_col, window, quantum), "pack-tokens", tails=F.sum(F.col("n") % quantum))
    by_bin = materialise(tokens.groupBy("part", "bin").agg(F.count("*").alias("c")), "pack-bins")
    histogram = np.zeros(window // quantum, np.int64)
    for row in by_bin.groupBy("bin").agg(F.sum("c").alias("c")).collect():  # at most window / quantum rows
        histogram[row["bin"]] = row["c"]
    histogram[0] = 0
    slots, taken, sequences = [], np.zeros_like(histogram), 0
    for combo, times in plan(histogram, depth):
        at = 0
        for size in combo:
            slots.append((int(size), int(taken[size]), int(taken[size]) + times, sequences, at))
            taken[size] += times
            at += int(size) * quantum
        sequences += times
    left = (histogram - taken) * np.arange(len(histogram)) * quantum
    left_base = np.cumsum(left) - left
    sums = materialise(tokens.groupBy("part").agg(F.sum(F.expr(f"n div {window}")).alias("fulls"), F.sum(F.expr(f"n % {quantum}")).alias("tails")), "pack-parts")
    total = int(left.sum()) + int(seen["tails"] or 0)
    cuts = last_cuts(total, window)
    whole = total - total % window

    # offsets of each task: a row for each task and length, a row for each task
    parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bin_base = by_bin.select("part", "bin", F.coalesce(F.sum("c").over(Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("bin_base"))
    part_base = sums.select("part", *(F.coalesce(F.sum(c).over(parts), F.lit(0)).alias(f"{c}_base") for c in ("fulls", "tails")))
    bases = bin_base.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("bin", "bin_base"))).alias("bin_bases")).join(part_base, "part")
    sized = spark.createDataFrame([(i, int(taken[i]), int(left_base[i])) for i in range(len(histogram))], "bin int, taken bigint, left_base bigint")
    slot_table = spark.createDataFrame(slots, "sbin int, lo bigint, hi bigint, seq bigint, at int")

    t = tokens.join(bases, "part").withColumn("rank", F.col("bin_rank") + F.element_at("bin_bases", F.col("bin"))).drop("bin_bases")
    t = t.join(F.broadcast(sized), "bin")
    # bounded: at most window / quantum combinations of depth lengths
    t = t.join(F.broadcast(slot_table), (F.col("bin") == F.col("sbin")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left")
    body, tail = F.col("bin") * quantum, F.col("n") % quantum
    head = F.expr(f"n - n % {window}")

    def piece(start, length, seq, offset):
        return F.struct(start.cast("long").alias("start"), length.cast("long").alias("length"), seq.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))

    none = F.array().cast("array<struct<start:bigint,length:bigint,sequence_id:bigint,offset:bigint>>")
    after = sequences + whole // window + len(cuts)
    cut_array = "array(" + ",".join(f"{c}L" for c in cuts) + ")" if cuts else "cast(array() as array<bigint>)"

    def spread(prefix: str) -> F.Column:
        """Pieces of a run of ``{prefix}_len`` tokens at ``{prefix}_pos`` of the residual stream,
        which is cut at full windows and in the last one at its powers of two."""
        edges = f"array_distinct(array_sort(concat(array({prefix}_pos), filter(array(({prefix}_pos div {window} + 1) * {window}), x -> x < {prefix}_pos + {prefix}_len and x <= {whole}), filter({cut_array}, x -> x > {prefix}_pos and x < {prefix}_pos + {prefix}_len))))"
        nth = f"size(filter({cut_array}, y -> y <= x))"
        return F.expr(f"""transform({edges}, (x, i) -> named_struct(
          'start', cast({prefix}_start + x - {prefix}_pos as bigint),
          'length', cast(coalesce(try_element_at({edges}, i + 2), {prefix}_pos + {prefix}_len) - x as bigint),
          'sequence_id', cast({sequences} + if(x < {whole}, x div {window}, {whole // window} + {nth} - 1) as bigint),
          'offset', cast(if(x < {whole}, x % {window}, x - element_at({cut_array}, {nth})) as bigint)))""") if total else none

    t = t.withColumns({
        "b_start": head, "b_len": body.cast("long"), "b_pos": F.col("left_base") + (F.col("rank") - F.col("taken")) * body,
        "t_start": head + body, "t_len": tail, "t_pos": F.lit(int(left.sum())) + F.col("tails_base") + F.col("tail_rank"),
    })
    pieces = F.concat(
        F.when(F.col("n") >= window, F.expr(f"transform(sequence(0L, n div {window} - 1), k -> named_struct('start', k * {window}, 'length', {window}L, 'sequence_id', {after} + fulls_base + full_rank + k, 'offset', 0L))")).otherwise(none),
        F.when(F.col("bin") == 0, none).when(F.col("seq").isNotNull(), F.array(piece(F.col("b_start"), F.col("b_len"), F.col("seq") + F.col("rank") - F.col("lo"), F.col("at")))).otherwise(spread("b")),
        F.when(tail == 0, none).otherwise(spread("t")),
    )
    out = t.select("id", "n", "ids", F.explode(pieces).alias("p"))
    return out.select("id", "p.start", "p.length", F.col("n").alias("doc_tokens"), "p.sequence_id", "p.offset", F.expr("substring(ids, cast(p.start * 4 + 1 as int), cast(p.length * 4 as int))").alias("ids"))


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place."""
    out = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
