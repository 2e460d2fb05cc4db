"""Language-model scores from a probabilistic suffix tree over words.

A text is its lower-cased words and one end. The tree's states are contexts of up to ``DEPTH``
preceding words (an end stands before the first word). A context is a candidate if it occurs
``MIN_COUNT`` times in training, whatever the input's size, and its suffix is a state; it is
retained if its next-word counts diverge from its suffix's distribution by ``MIN_GAIN`` nats or more
in total (count times Kullback-Leibler divergence). A state's
distribution is its counts, smoothed by ``LOWER`` parts of its suffix's; the root's is the add-one
distribution over the training words and one unknown word, so every distribution adds up to one and
a model without states equals the base. Each word is scored by its longest suffix that is a state.

Counts cover all training documents. Texts are read once: batches of them are kept as numbers in
their own sorted vocabularies. Then, for words and for each depth of contexts, a batch lists its
distinct keys in partitions by hash; a partition adds up what all batches ask for and answers each,
a row for each batch and partition, so nothing, however frequent, is gathered row by row. The next
words of a context seen ``HOT`` times or more are dealt over several partitions, each of which gives
its share of the gain; the shares are added by context, and where one fails the test, its grams are
marked in the answers before any batch reads them. Words are told apart by 64-bit hashes, next
words of one context by 32 bits, contexts of a partition by 40 bits.

Null and empty texts are the end alone. A null id counts as the empty string in the split. Repeated
rows train as often as they occur and score alike. Without training documents N is 0 and the model
is uniform.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumigrid.llm.store import materialise, spread_join, tasks
from lumigrid.llm.text import expand, mix64, sliced, squeeze, text_buffer, words, xxh64

DEPTH, MIN_COUNT, MIN_GAIN, LOWER, HOT = 2, 2, 4.0, 0.6, 1 << 15
GROUP_BYTES = 6 << 20
END_HASH = np.uint64(0xA0761D6478BD642F)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_HOME, _STEP = np.uint64(40), 8.0  # bits of a context's name; lower probabilities in eighths of a bit


def held_out(column: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 7 == 2


# --- one batch of texts ------------------------------------------------------------------------------


@dataclass
class Grams:
    """Distinct (context, next word) of one depth in a batch. ``at`` gives each token's gram, -1
    where the context is no candidate; ``name`` is the context's hash, ``n`` its training count."""

    at: np.ndarray
    name: np.ndarray
    word: np.ndarray
    n: np.ndarray
    order: np.ndarray
    home: np.ndarray
    key: np.ndarray
    hot: np.ndarray


@dataclass
class Texts:
    """Tokens of a batch: ``code`` numbers in ``vocabulary`` (its length stands for the end), which
    closes each of the texts that begin at ``first``."""

    vocabulary: np.ndarray
    code: np.ndarray
    first: np.ndarray
    train: np.ndarray

    @property
    def inside(self) -> np.ndarray:
        """Place of each token in its text."""
        return np.arange(len(self.code)) - np.repeat(self.first[:-1], np.diff(self.first))

    def learnt(self) -> np.ndarray:
        return np.repeat(self.train, np.diff(self.first))


def grams(texts: Texts, previous: Grams | None, counts: np.ndarray, value: np.ndarray | None, hot: int = HOT) -> Grams:
    """Grams one word deeper than ``previous``, whose answers are ``value``; the first depth follows
    from the training counts of the vocabulary and of the end."""
    code, hashes = texts.code, np.append(texts.vocabulary, END_HASH)
    before = np.append(len(texts.vocabulary), code[:-1]) if len(code) else code
    before[texts.first[:-1]] = len(texts.vocabulary)
    with np.errstate(over="ignore"):
        if previous is None:
            n_of, name_of, owner = counts, mix64(hashes), before
            on = n_of[owner] >= MIN_COUNT
        else:
            n_of, name_of = value >> 1, mix64(previous.name ^ (hashes[previous.word] * _MULT))
            owner = np.append(-1, previous.at[:-1])
            owner[texts.first[:-1]] = -1
            own = previous.at
            on = (owner >= 0) & (own >= 0)
            on[on] = (n_of[owner[on]] >= MIN_COUNT) & ((value[own[on]] & 1) == 1)
        spot = np.flatnonzero(on)
        pair, inverse = np.unique(owner[spot] * np.int64(len(hashes)) + code[spot], return_inverse=True)
        context, word = pair // len(hashes), pair % len(hashes)
        at = np.full(len(code), -1, np.int64)
        at[spot] = inverse
        name, n = name_of[context], n_of[context].astype(np.int64)
        key = mix64(hashes[word] + np.uint64(1)) >> np.uint64(32)
        salts = (1 + n // hot).astype(np.uint64)
        home = mix64(name + (key % salts) * _MULT) >> (np.uint64(64) - _HOME)
        order = np.argsort((home << np.uint64(24)) | (key >> np.uint64(8)), kind="stable")
    return Grams(at, name, word, n, order, home[order], key[order].astype(np.uint32), (salts > 1)[order])


def mixed(texts: Texts, base: np.ndarray, depths: list[tuple[Grams, np.ndarray]]) -> np.ndarray:
    """Probability of each token after its longest suffix among the states of the given depths."""
    p = base[texts.code]
    for g, value in depths:
        on = np.flatnonzero(g.at >= 0)
        own = g.at[on]
        state = (value[own] & 1) == 1
        on, own = on[state], own[state]
        p[on] = (1 - LOWER) * (value[own] >> 1) / g.n[own] + LOWER * p[on]
    return p


def cells(home: np.ndarray, parts: int) -> np.ndarray:
    """Where each partition of sorted names begins."""
    edge = (np.arange(parts + 1, dtype=np.uint64) << _HOME) // np.uint64(parts)
    edge[1:-1] += (np.arange(1, parts, dtype=np.uint64) << _HOME) % np.uint64(parts) > 0
    return np.searchsorted(home, edge)


# --- passes over batches ----------------------------------------------------------------------------


def _batches(id_type: pa.DataType):
    """Texts in. A row of kind 0 for each batch (vocabulary, numbers, lengths, training marks), rows
    of kind 9 for its documents."""

    names = ["batch", "k", "part", "doc_id", "train", "words", "codes", "sizes", "marks"]

    def flush(batch: int, held: list) -> Iterator[pa.RecordBatch]:
        vocabulary, code = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        sizes, train = (np.concatenate([x[k] for x in held]) for k in (1, 2))
        blobs = [squeeze(vocabulary, rising=True), squeeze(code.astype(np.uint32)), squeeze(sizes.astype(np.uint32)), np.packbits(train).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([batch], pa.int64()), pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.nulls(1, id_type), pa.nulls(1, pa.bool_()), *(pa.array([x], pa.binary()) for x in blobs)], names=names)
        n = len(sizes)
        yield pa.RecordBatch.from_arrays([pa.array([batch] * n, pa.int64()), pa.array([9] * n, pa.int32()), pa.array(np.arange(n, dtype=np.int32)), pa.concat_arrays([x[3] for x in held]), pa.array(train), *(pa.nulls(n, pa.binary()) for _ in range(4))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, held, size = TaskContext.get().partitionId() << 24, [], 0
        for b in sliced(batches, "text"):
            w = words(*text_buffer(b.column(1)))
            held.append((xxh64(w.buf, w.start, w.length), w.counts, b.column(2).to_numpy(zero_copy_only=False), b.column(0)))
            size += len(w.buf)
            if size > GROUP_BYTES:
                yield from flush(batch, held)
                batch, held, size = batch + 1, [], 0
        if held:
            yield from flush(batch, held)

    return run


_PASSED = ["batch", "k", "part", "words", "codes", "sizes", "marks"]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Texts, dict[int, np.ndarray], list]]:
    """(batch, texts, answers by depth, document rows) of rows sorted by batch, kind and part."""
    batch, texts, told, docs = None, None, {}, []

    def done():
        return batch, texts, {k: np.concatenate(v) for k, v in told.items()}, docs

    for b in batches:
        kinds = b.column(1).to_numpy()
        for i, own in enumerate(b.column(0).to_pylist()):
            if own != batch:
                if texts is not None:
                    yield done()
                batch, texts, told, docs = own, None, {}, []
            if kinds[i] == 0:
                vocabulary, code, sizes = expand(b.column(3)[i].as_py(), "u8", rising=True), expand(b.column(4)[i].as_py(), "u4").astype(np.int64), expand(b.column(5)[i].as_py(), "u4").astype(np.int64)
                ends = np.cumsum(sizes + 1) - 1
                full = np.full(len(code) + len(sizes), len(vocabulary), np.int64)
                full[np.delete(np.arange(len(full)), ends)] = code
                texts = Texts(vocabulary, full, np.concatenate([[0], ends + 1]), np.unpackbits(np.frombuffer(b.column(6)[i].as_py(), np.uint8), count=len(sizes)).astype(bool))
            elif kinds[i] == 9:
                docs.append((b, i))
            else:
                told.setdefault(int(kinds[i]), []).append(expand(b.column(3)[i].as_py(), "u4").astype(np.int64))
    if texts is not None:
        yield done()


def _ask_words(parts: int):
    """Each batch's vocabulary with its training counts, a row for each partition of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, _, _ in _read(batches):
            counts = np.bincount(texts.code[texts.learnt()], minlength=len(texts.vocabulary) + 1)[:-1].astype(np.uint32)
            cut = cells(texts.vocabulary >> (np.uint64(64) - _HOME), parts)
            found = np.flatnonzero(cut[1:] > cut[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch] * len(found), pa.int64()), pa.array(found.astype(np.int32)), pa.array([squeeze(texts.vocabulary[cut[p] : cut[p + 1]], rising=True) for p in found], pa.binary()), pa.array([squeeze(counts[cut[p] : cut[p + 1]]) for p in found], pa.binary())],
                names=["batch", "part", "keys", "counts"],
            )

    return run


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """(part, rows) of rows that come sorted by part."""
    part, rows = None, []
    for b in batches:
        for batch, own, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if own != part:
                if rows:
                    yield part, rows
                part, rows = own, []
            rows.append((batch, *rest))
    if rows:
        yield part, rows


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words' training counts for each batch; the first row of a partition has its totals."""
    for part, rows in _by_part(batches):
        keys = [expand(r[1], "u8", rising=True) for r in rows]
        vocabulary, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([expand(r[2], "u4") for r in rows])).astype(np.int64)
        cut = np.cumsum([0, *map(len, keys)])
        n, v = int(total.sum()), int((total > 0).sum())
        for i, (batch, *_) in enumerate(rows):
            yield pa.RecordBatch.from_arrays([pa.array([batch], pa.int64()), pa.array([part], pa.int32()), pa.array([squeeze(total[inverse[cut[i] : cut[i + 1]]].astype(np.uint32))], pa.binary()), pa.array([n if i == 0 else 0]), pa.array([v if i == 0 else 0])], names=["batch", "part", "words", "n", "v"])


def _deepen(texts: Texts, told: dict[int, np.ndarray], n: int, v: int, ends: int, depth: int, hot: int) -> tuple[np.ndarray, list[tuple[Grams, np.ndarray]], Grams | None]:
    """Root probabilities, the answered depths, and the grams of ``depth`` to ask for."""
    counts = np.append(told.get(1, np.zeros(0, np.int64)), ends)
    base, done, g = (counts + 1.0) / (n + v + 1.0), [], None
    for d in range(1, depth + 1):
        g = grams(texts, g, counts, done[-1][1] if done else None, hot)
        if d + 1 in told or (d < depth and not len(g.order)):
            value = np.empty(len(g.order), np.int64)
            value[g.order] = told.get(d + 1, value)
            done.append((g, value))
    return base, done, g


def _ask_grams(parts: int, n: int, v: int, ends: int, depth: int, hot: int):
    """Each batch's grams of one depth with training counts and lower probabilities, a row for each
    partition of contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, told, _ in _read(batches):
            base, done, g = _deepen(texts, told, n, v, ends, depth, hot)
            if not len(g.order):
                continue
            on = np.flatnonzero(g.at >= 0)
            lower = np.empty(len(g.order))
            lower[g.at[on]] = mixed(texts, base, done)[on]
            counts = np.bincount(g.at[on][texts.learnt()[on]], minlength=len(g.order)).astype(np.uint32)[g.order]
            bits = np.clip(np.rint(-np.log2(lower[g.order]) * _STEP), 0, 255).astype(np.uint8)
            cut = cells(g.home, parts)
            found = np.flatnonzero(cut[1:] > cut[:-1])
            out: list[list[bytes]] = [[], [], [], [], [], []]
            title = g.name[g.order]
            for p in found:
                own = slice(cut[p], cut[p + 1])
                name = g.home[own]
                begin = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
                size = np.diff(np.append(begin, len(name)))
                for blob, x in zip(out, (squeeze(name[begin], rising=True), squeeze((2 * size + g.hot[own][begin]).astype(np.uint32)), squeeze(g.key[own]), squeeze(counts[own]), squeeze(bits[own]), squeeze(title[own][begin][g.hot[own][begin]])), strict=True):
                    blob.append(x)
            yield pa.RecordBatch.from_arrays([pa.array([batch] * len(found), pa.int64()), pa.array(found.astype(np.int32)), *(pa.array(x, pa.binary()) for x in out)], names=["batch", "part", "names", "sizes", "keys", "counts", "lower", "hots"])

    return run


#: Answers to a batch (batch, part, words), a hot context's share of its gain (name, n, gain), and
#: where a batch's answers hold a hot context (batch, part, name, start, stop).
_COUNTED = "batch bigint, part int, words binary, name bigint, n bigint, gain double, start bigint, stop bigint"


def _count_grams(min_gain: float):
    """For each batch, twice the training count of each gram it asked for, plus one where the
    context is a state. Hot contexts count as states here; what they gain goes out in shares."""
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in _COUNTED.split(", ")]

    def rows_of(many: int, /, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(many, t) for c, t in zip(names, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _by_part(batches):
            homes = [expand(r[1], "u8", rising=True) for r in rows]
            sizes = [expand(r[2], "u4") for r in rows]
            titles = [expand(r[6], "u8") for r in rows]
            context, owner = np.unique(np.concatenate(homes), return_inverse=True)
            size = np.concatenate(sizes)
            dealt = owner[(size & 1) == 1]
            hot, title = np.zeros(len(context), bool), np.zeros(len(context), np.uint64)
            hot[dealt], title[dealt] = True, np.concatenate(titles)
            key = (np.repeat(owner, size >> 1).astype(np.uint64) << np.uint64(32)) | np.concatenate([expand(r[3], "u4") for r in rows])
            gram, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            total = np.bincount(inverse, weights=np.concatenate([expand(r[4], "u4") for r in rows])).astype(np.int64)
            lower = np.concatenate([expand(r[5], "u1") for r in rows])[first] / -_STEP
            of = (gram >> np.uint64(32)).astype(np.int64)
            n = np.bincount(of, weights=total, minlength=len(context))
            seen = total > 0
            share = np.bincount(of[seen], weights=total[seen] * (np.log(total[seen]) - lower[seen] * np.log(2)), minlength=len(context))
            gain = share - n * np.log(np.maximum(n, 1))
            value = (2 * total + (hot | (gain >= min_gain))[of]).astype(np.uint32)
            if hot.any():
                yield rows_of(int(hot.sum()), name=title[hot].view(np.int64), n=n[hot].astype(np.int64), gain=share[hot])
            cut = np.cumsum([0, *((s >> 1).sum() for s in sizes)]).astype(np.int64)
            for i, (batch, *_) in enumerate(rows):
                yield rows_of(1, batch=[batch], part=[part], words=[squeeze(value[inverse[cut[i] : cut[i + 1]]])])
                if len(titles[i]):
                    stop = np.cumsum(sizes[i] >> 1).astype(np.int64)
                    at = np.flatnonzero(sizes[i] & 1)
                    yield rows_of(len(at), batch=[batch] * len(at), part=[part] * len(at), name=titles[i].view(np.int64), start=stop[at] - (sizes[i][at] >> 1), stop=stop[at])

    return run


def _without_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers (batch, part, words, runs) whose runs hold grams of contexts that are no states."""
    for b in batches:
        blobs = []
        for blob, runs in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            if runs:
                value = expand(blob, "u4").copy()
                for r in runs:
                    value[r["start"] : r["stop"]] &= np.uint32(0xFFFFFFFE)
                blob = squeeze(value)
            blobs.append(blob)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(blobs, pa.binary())], names=["batch", "part", "words"])


def _tested(found: DataFrame, min_gain: float, name: str) -> DataFrame:
    """Answers (batch, part, words) from rows of ``_COUNTED``, hot contexts tested by the sum of their
    shares."""
    told = found.where("words is not null").select("batch", "part", "words")
    sums = found.where("n is not null").groupBy("name").agg(F.sum("n").alias("n"), F.sum("gain").alias("gain"))
    failed = sums.where(F.col("gain") - F.col("n") * F.log(F.greatest("n", F.lit(1))) < min_gain).select("name")
    if not failed.limit(1).count():
        return told
    runs = spread_join(found.where("start is not null").select("batch", "part", "name", "start", "stop"), failed, "name", "left_semi")
    runs = runs.groupBy("batch", "part").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))
    return materialise(told.join(runs, ["batch", "part"], "left").select("batch", "part", "words", "runs").mapInArrow(_without_states, "batch bigint, part int, words binary"), name)


def _score(n: int, v: int, ends: int, depth: int, hot: int):
    """Both scores of each document of the batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, told, docs in _read(batches):
            base, done, _ = _deepen(texts, told, n, v, ends, depth, hot)
            own = np.log10(mixed(texts, base, done))
            known = np.append(told.get(1, np.zeros(0, np.int64)), ends) > 0
            each = [np.add.reduceat(x, texts.first[:-1]) for x in (known[texts.code].astype(np.int64), np.log10(base)[texts.code], own)]
            ids, train = ([b.column(c)[i].as_py() for b, i in docs] for c in (7, 8))
            yield pa.RecordBatch.from_arrays([pa.array(ids, docs[0][0].schema.field(7).type), pa.array(train, pa.bool_()), pa.array(np.diff(texts.first)), *map(pa.array, each)], names=["doc_id", "train", "n_tokens", "n_known", "base_score", "score"])

    return run


def lm_scores(docs: DataFrame, depth: int = DEPTH, min_gain: float = MIN_GAIN, hot: int = HOT) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one per row."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    parts = tasks(spark)
    kind = docs.schema["doc_id"].dataType
    marked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", (~held_out()).alias("train"))
    schema = f"batch bigint, k int, part int, doc_id {kind.simpleString()}, train boolean, words binary, codes binary, sizes binary, marks binary"
    held = materialise(marked.mapInArrow(_batches(to_arrow_type(kind)), schema), "lm-texts")
    texts = held.where("k = 0").select(*_PASSED)
    ends = held.where("k = 9 and train").count()

    def meet(answers: list[DataFrame]) -> DataFrame:
        """Batches with what they were told, in order."""
        out = texts
        for k, told in enumerate(answers, 1):
            out = out.unionByName(told.select("batch", F.lit(k).alias("k"), "part", "words"), allowMissingColumns=True)
        return out

    def gather(asked: DataFrame, how, schema: str, name: str) -> DataFrame:
        return materialise(asked.repartition(parts, "part").sortWithinPartitions("part", "batch").mapInArrow(how, schema), name)

    asked = texts.mapInArrow(_ask_words(parts), "batch bigint, part int, keys binary, counts binary")
    answers = [gather(asked, _count_words, "batch bigint, part int, words binary, n bigint, v bigint", "lm-words")]
    totals = answers[0].agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    n, v = int(totals[0]) + ends, int(totals[1]) + (ends > 0)
    for d in range(1, depth + 1):
        rows = meet(answers).repartition(parts, "batch").sortWithinPartitions("batch", "k", "part")
        asked = rows.mapInArrow(_ask_grams(parts, n, v, ends, d, hot), "batch bigint, part int, names binary, sizes binary, keys binary, counts binary, lower binary, hots binary")
        answers.append(_tested(gather(asked, _count_grams(min_gain), _COUNTED, f"lm-grams{d}"), min_gain, f"lm-states{d}"))
    rows = meet(answers).unionByName(held.where("k = 9").select("batch", "k", "part", "doc_id", "train"), allowMissingColumns=True)
    rows = rows.select(*_PASSED, "doc_id", "train").repartition(parts, "batch").sortWithinPartitions("batch", "k", "part")
    scored = rows.mapInArrow(_score(n, v, ends, depth, hot), f"doc_id {kind.simpleString()}, train boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Base and model scores of every document."""
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
