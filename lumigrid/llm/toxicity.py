"""Toxicity: a convolutional text classifier trained in numpy.

A token is a lower-cased word without ASCII punctuation; it is embedded as the sum of three hashed
rows (the word and its first 4 and 6 bytes, so that inflected forms share rows). Filters of several
widths slide over the whole text, the maximum of each over the text is pooled, and a logistic layer
gives the score. Gradients flow only through the pooled positions. Decision thresholds are
calibrated by language on labelled rows kept back from fitting; language, source, id and labels
never enter a score.

The fit uses at most ``max_toxic`` + ``max_clean`` labelled documents, those with the lowest hash
of their id; weights undo the uneven sampling. Scoring reads every text whole.

Null and empty texts are scored by the bias alone. Without labels, or with one class only, every
score is the share of toxic labels. Null ids are scored and never learned from; repeated rows are
scored alike. Labels that are null, or of ids without a document, are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumigrid.llm.store import fresh
from lumigrid.llm.text import PLAIN, mix64, sliced, text_buffer, words, xxh64

ROWS, DIM, WIDTHS, FILTERS = 1 << 16, 16, (1, 2, 3), 8
MAX_TOXIC, MAX_CLEAN, EPOCHS, MIN_STEPS, BATCH, RATE, SEED = 3000, 6000, 12, 1200, 64, 0.1, 7
OFFSETS = sum(WIDTHS)
SCORE_BYTES = 1 << 20
LEAST_TOXIC = 30  # calibration documents of a language


def token_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows (tokens x 3) of a batch and the token range of each text."""
    buf, offsets = text_buffer(texts)
    w = words(buf, offsets, table=PLAIN)
    padded = np.concatenate([w.buf, np.zeros(8, np.uint8)])
    head = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))[w.start] if len(w.start) else np.zeros(0, np.uint64)
    out = np.empty((len(w.start), 3), np.uint16)
    out[:, 0] = xxh64(w.buf, w.start, w.length) & np.uint64(ROWS - 1)
    for k, n in ((1, 4), (2, 6)):
        keep = (np.uint64(1) << (8 * np.minimum(w.length, n)).astype(np.uint64)) - np.uint64(1)
        out[:, k] = mix64((head & keep) + np.uint64(n)) & np.uint64(ROWS - 1)
    return out, w.first


@dataclass
class Model:
    """Weights of the classifier; ``prior`` is the score where there was nothing to learn from."""

    prior: float = 0.0
    embed: np.ndarray | None = None
    conv: np.ndarray | None = None  # DIM x (OFFSETS * FILTERS)
    bias: np.ndarray | None = None
    dense: np.ndarray | None = None
    shift: float = 0.0
    thresholds: dict = field(default_factory=dict)
    default: float = 0.5


PAD = max(WIDTHS) - 1
COLUMN = np.repeat(np.arange(len(WIDTHS)), FILTERS)  # width of each filter
BASE = np.cumsum([0, *WIDTHS[:-1]])[COLUMN] * FILTERS + np.tile(np.arange(FILTERS), len(WIDTHS))


def _padded(rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token rows with PAD zero rows (index ROWS) after each text, and where each text starts."""
    counts = np.diff(first)
    start = first[:-1] + PAD * np.arange(len(counts))
    out = np.full((len(rows) + PAD * len(counts), 3), ROWS, np.int32)
    out[np.arange(len(rows)) + PAD * np.repeat(np.arange(len(counts)), counts)] = rows
    return out, start


def _convolve(model: Model, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedded tokens and the filter outputs (tokens x filters) of padded texts."""
    x = model.embed[rows[:, 0]]
    x += model.embed[rows[:, 1]]
    x += model.embed[rows[:, 2]]
    z = x @ model.conv
    out = np.empty((len(x), len(COLUMN)), np.float32)
    at = 0
    for k, width in enumerate(WIDTHS):
        acc = out[:, k * FILTERS : (k + 1) * FILTERS]
        acc[:] = z[:, at : at + FILTERS]
        for o in range(1, width):
            acc[: len(z) - o] += z[o:, at + o * FILTERS : at + (o + 1) * FILTERS]
        at += width * FILTERS
    return x, out


def score(model: Model, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    n, counts = len(first) - 1, np.diff(first)
    if model.embed is None:
        return np.full(n, model.prior)
    padded, start = _padded(rows, first)
    _, conv = _convolve(model, padded)
    full = np.flatnonzero(counts)
    pooled = np.zeros((n, conv.shape[1]), np.float32)
    if len(full):
        edges = np.column_stack([start[full], start[full] + counts[full]]).ravel()
        pooled[full] = np.maximum.reduceat(conv, edges[:-1], axis=0)[::2] + model.bias
    return 1 / (1 + np.exp(-(np.maximum(pooled, 0).astype(np.float64) @ model.dense + model.shift)))


def fit(docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, lang: list, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Train on token rows of whole texts; every fifth document calibrates the thresholds."""
    model = Model(prior=float((weight * y).sum() / (weight.sum() + 1)) if len(y) else 0.0)
    if not len(y) or y.min() == y.max():
        return model
    rng = np.random.default_rng(seed)
    model.embed = np.vstack([rng.normal(0, 0.1, (ROWS, DIM)), np.zeros((1, DIM))]).astype(np.float32)
    model.conv = rng.normal(0, 0.3, (DIM, OFFSETS * FILTERS)).astype(np.float32)
    model.bias, model.dense = np.zeros(len(WIDTHS) * FILTERS, np.float32), rng.normal(0, 0.3, len(WIDTHS) * FILTERS)
    model.shift = float(np.log(model.prior / (1 - model.prior)))
    sums = {k: 1e-3 for k in ("embed", "conv", "bias", "dense", "shift")}
    sums["embed"] = np.full((ROWS + 1, 1), 1e-3, np.float32)
    sums = {k: v if k == "embed" else np.zeros_like(getattr(model, k), dtype=np.float64) + v for k, v in sums.items()}
    held = np.arange(len(y)) % 5 == 4
    learn = np.flatnonzero(~held)

    def step(name: str, grad) -> None:
        sums[name] += np.square(grad)
        setattr(model, name, (getattr(model, name) - RATE * grad / np.sqrt(sums[name])).astype(np.asarray(getattr(model, name)).dtype))

    for _ in range(max(epochs, -(-MIN_STEPS * BATCH // max(len(learn), 1)))):
        rng.shuffle(learn)
        for at in range(0, len(learn), BATCH):
            pick = learn[at : at + BATCH]
            pick = pick[[len(docs[i]) > 0 for i in pick]]
            if not len(pick):
                continue
            counts = np.array([len(docs[i]) for i in pick])
            rows, start = _padded(np.concatenate([docs[i] for i in pick]), np.concatenate([[0], np.cumsum(counts)]))
            x, conv = _convolve(model, rows)
            hit = np.array([a + conv[a : a + c].argmax(axis=0) for a, c in zip(start, counts, strict=True)])
            raw = conv[hit, np.arange(conv.shape[1])] + model.bias
            act = np.maximum(raw, 0)
            p = 1 / (1 + np.exp(-(act @ model.dense + model.shift)))
            g = (p - y[pick]) * weight[pick] / BATCH
            dz = (g[:, None] * model.dense) * (raw > 0)
            d_conv, touched, grads = np.zeros(model.conv.shape), [], []
            for o in range(max(WIDTHS)):
                d, f = np.nonzero((np.array(WIDTHS)[COLUMN] > o)[None, :] & (hit + o < (start + counts)[:, None]) & (dz != 0))
                if not len(d):
                    continue
                t, v = hit[d, f] + o, dz[d, f]
                np.add.at(d_conv.T, BASE[f] + o * FILTERS, x[t] * v[:, None])
                touched.append(t)
                grads.append(model.conv[:, BASE[f] + o * FILTERS].T * v[:, None])
            step("dense", act.T @ g)
            step("shift", float(g.sum()))
            step("bias", dz.sum(axis=0))
            step("conv", d_conv)
            if touched:
                unique, inverse = np.unique(rows[np.concatenate(touched)].ravel(), return_inverse=True)
                total = np.zeros((len(unique), DIM))
                np.add.at(total, inverse, np.repeat(np.concatenate(grads), 3, axis=0))
                sums["embed"][unique] += np.square(total).mean(axis=1, keepdims=True)
                model.embed[unique] -= RATE * total / np.sqrt(sums["embed"][unique])
    _calibrate(model, [docs[i] for i in np.flatnonzero(held)], y[held], weight[held], [lang[i] for i in np.flatnonzero(held)])
    return model


def _best_cut(p: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Middle of the widest-margin threshold with the highest F1."""
    order = np.argsort(-p, kind="stable")
    p, hit, miss = p[order], np.cumsum((w * y)[order]), np.cumsum((w * (1 - y))[order])
    f1 = 2 * hit / (hit + miss + (w * y).sum())
    f1[np.append(p[1:] == p[:-1], False)] = -1
    k = len(f1) - 1 - int(np.argmax(f1[::-1]))
    return float((p[k] + (p[k + 1] if k + 1 < len(p) else 0.0)) / 2)


def _calibrate(model: Model, docs: list[np.ndarray], y: np.ndarray, w: np.ndarray, lang: list) -> None:
    """The common cut and those of the languages, each drawn towards the next wider one as if that
    had been seen on LEAST_TOXIC toxic documents."""
    if not len(docs) or y.min() == y.max():
        return
    p = np.concatenate([score(model, np.concatenate(part), np.concatenate([[0], np.cumsum([len(d) for d in part])])) for part in (docs[k : k + BATCH] for k in range(0, len(docs), BATCH))])
    trust = lambda n: float(n) / (float(n) + LEAST_TOXIC)
    model.default = 0.5 + trust(y.sum()) * (_best_cut(p, y, w) - 0.5)
    for name in sorted({x for x in lang if x is not None}):
        on = np.array([x == name for x in lang])
        if 0 < y[on].sum() < on.sum():
            model.thresholds[name] = model.default + trust(y[on].sum()) * (_best_cut(p[on], y[on], w[on]) - model.default)


def id_hash(column: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Fit on labelled rows whose crc32(doc_id) mod 5 is not 0, at most so many of each class."""
    usable = labels.select("doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").where(id_hash() % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    chosen = None
    for value, most in ((1, max_toxic), (0, max_clean)):
        part = usable.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.union(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            rows, first = token_rows(b.column(1))
            data = pa.array([rows[x:y].tobytes() for x, y in zip(first, first[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), data, b.column(2), b.column(3)], names=["doc_id", "rows", "lang", "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # bounded: chosen has at most max_toxic + max_clean rows
    joined = docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "lang", F.col("toxic").cast("int").alias("toxic"))
    # one row an id, however often the documents repeat it
    joined = joined.groupBy("doc_id").agg(F.min(F.struct("text", "lang", "toxic")).alias("d")).select("doc_id", "d.text", "d.lang", "d.toxic")
    share = counts.get(1, 0) / max(1, counts.get(0, 0) + counts.get(1, 0))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["doc_id"], r["rows"]))
        y = np.array([r["toxic"] for r in got], np.float64)
        weight = np.ones(len(y))
        if len(y) and 0 < y.sum() < len(y):  # sampled classes weigh as the labelled ones
            weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
        tokens = [np.frombuffer(r["rows"], np.uint16).reshape(-1, 3) for r in got]
        order = np.random.default_rng(SEED).permutation(len(y))
        model = fit([tokens[i] for i in order], y[order], weight[order], [got[i]["lang"] for i in order])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # the sample is bounded, so one task can hold it; the driver gets the weights alone
    sample = joined.mapInArrow(run, f"doc_id {kind}, rows binary, lang string, toxic int").repartition(1)
    found = sample.mapInArrow(learn, "model binary").collect()
    return pickle.loads(bytes(found[0]["model"])) if found else Model()


def scores(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """``docs`` with a column of scores appended, over whole texts; other columns pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", SCORE_BYTES):
            p = score(shared.value, *token_rows(b.column(at)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=[*columns, name])

    return docs.mapInArrow(run, docs.limit(0).withColumn(name, F.lit(0.0)).schema)


def threshold_column(model: Model, lang: str = "lang") -> Column:
    out = F.lit(model.default)
    for name, value in sorted(model.thresholds.items()):
        out = F.when(F.col(lang) == name, F.lit(value)).otherwise(out)
    return out


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose score stays under their language's threshold."""
    model = train(docs, labels, **options)
    (name,) = fresh(docs, "toxicity")
    return scores(docs, model, name).where(F.col(name) < threshold_column(model)).select(*docs.columns)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, with the held-out mark and the language's verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scores(docs.select("doc_id", "text", "lang"), model)
    return out.select("doc_id", (id_hash() % 5 == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), (F.col("toxicity") >= threshold_column(model)).alias("rejected"))
