"""Exact top-k search by inner product over KD-trees, one per shard.

Vectors are made of whole numbers, floor(SCALE * x) of each component. Equal vectors become one row
with their k + 1 smallest ids, as no more of them can be among the k best of a query. Median splits
fitted on at most ``SAMPLE`` vectors cut space into at most ``CELLS`` cells, every vector goes to
its cell, and cells larger than ``SHARD_ROWS`` are dealt into shards by a hash. Each cell's tight
bounding box comes from all its vectors.

A query first searches one shard of its own cell, which gives it a k-th score. With that it goes to
the shards of all cells whose box allows as much: the largest inner product of a query with a box
takes, for each component, the end of the box on the query's side. In a shard the vectors make a
KD-tree (median splits on the widest component, tight boxes, leaves of ``LEAF`` rows). Queries are
taken in blocks; in every round each query opens the node of the largest bound among those it has
met and not opened, an inner node adds its children, a leaf is scored, and a query ends once no
bound reaches its k-th score, the best of what it has found and what it came with. Bounds that
equal the k-th score are still opened, as a smaller id may lie there.

A task holds one shard and a block of queries; queries beyond ``BLOCK_QUERIES`` meet further copies
of the shard. What the driver holds and sends is bounded by CELLS: splits and boxes.

Vectors that are null or hold a null or non-finite component take no part. A shorter vector counts
as ending in zeros. Null ids are never queries and order after all others; repeated rows are rows
each, so a repeated query gives its result once a row and finds its copies. Numbers and scores
beyond a long stop at its ends. Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumigrid.llm.store import materialise, spread_join, tasks

TOP, SCALE, EVERY = 10, 1024, 100
SAMPLE, CELLS, SHARD_ROWS, LEAF = 8192, 1024, 16384, 256
QUERY_ROWS, BLOCK_QUERIES = 256, 65536
EXACT = 2.0**53
LOW, HIGH = -(2**63) + 1, 2**63 - 1


# --- vectors as bytes -------------------------------------------------------------------------------


def packed(values: pa.Array) -> pa.Array:
    """Lists of whole numbers as bytes: the width of a number (2, 4 or 8), then the numbers."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    flat = np.clip(values.flatten().to_numpy(zero_copy_only=False), LOW, HIGH)
    first = np.concatenate([[0], np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    out = []
    for a, b in zip(first, first[1:], strict=False):
        most = int(np.abs(flat[a:b]).max(initial=0))
        width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
        out.append(bytes([width]) + flat[a:b].astype(f"<i{width}").tobytes())
    return pa.array(out, pa.binary())


def unpacked(rows: list[bytes], width: int | None = None) -> np.ndarray:
    """A matrix of what ``packed`` was given, with zeros up to ``width`` (the longest by default);
    longer vectors are cut there."""
    sizes = [(len(r) - 1) // r[0] for r in rows]
    width = max(sizes, default=0) if width is None else width
    if rows and len(set(sizes)) == 1 and len({r[0] for r in rows}) == 1 and sizes[0]:
        made = np.frombuffer(b"".join(r[1:] for r in rows), f"<i{rows[0][0]}").reshape(len(rows), -1)[:, :width].astype(np.int64)
        return made if made.shape[1] == width else np.pad(made, ((0, 0), (0, width - made.shape[1])))
    out = np.zeros((len(rows), width), np.int64)
    for k, r in enumerate(rows):
        v = np.frombuffer(r, f"<i{r[0]}", offset=1)[:width]
        out[k, : len(v)] = v
    return out


def _number(m: np.ndarray, most: float) -> np.ndarray:
    """Floats where all sums are exact in them, else Python's whole numbers."""
    return m.astype(np.float64) if most < EXACT else m.astype(object)


def _in_range(scores: np.ndarray) -> np.ndarray:
    """Scores that stop at the ends of a long; those in floats lie inside."""
    return np.minimum(np.maximum(scores, LOW), HIGH) if scores.dtype == object else scores


# --- trees ------------------------------------------------------------------------------------------


@dataclass
class Tree:
    """A KD-tree; node 0 is the root. Rows are in leaf order, node i holds rows start[i]:stop[i],
    left and right are -1 at leaves."""

    order: np.ndarray
    rows: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    left: np.ndarray
    right: np.ndarray
    low: np.ndarray
    high: np.ndarray


def grow_tree(m: np.ndarray, leaf: int = LEAF) -> Tree:
    """Median splits on the widest component until ``leaf`` rows are left."""
    order, nodes = np.arange(len(m)), [[0, len(m), -1, -1]]
    low, high = [m.min(axis=0)], [m.max(axis=0)]
    at = 0
    while at < len(nodes):
        a, b = nodes[at][:2]
        if b - a > leaf:
            axis = int(np.argmax(high[at] - low[at]))
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(m[order[a:b], axis], half)]
            nodes[at][2:] = len(nodes), len(nodes) + 1
            for x, y in ((a, a + half), (a + half, b)):
                nodes.append([x, y, -1, -1])
                low.append(m[order[x:y]].min(axis=0))
                high.append(m[order[x:y]].max(axis=0))
        at += 1
    start, stop, left, right = np.array(nodes).T
    return Tree(order, m[order], start, stop, left, right, np.array(low), np.array(high))


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest inner product of each query with any vector in each box."""
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


def median_cells(m: np.ndarray, cells: int) -> list[tuple[int, int]]:
    """Splits (component, cut) of a full binary tree of ``cells`` (a power of two) leaves in level
    order: vectors below the cut go left."""
    splits: list[tuple[int, int]] = []
    level = [np.arange(len(m))]
    while len(level) < cells:
        below = []
        for rows in level:
            axis, cut = 0, 0
            if len(rows) > 1 and m.shape[1]:
                spread = m[rows].astype(np.float64)
                axis = int(np.argmax(spread.max(axis=0) - spread.min(axis=0)))
                cut = int(np.sort(m[rows, axis])[len(rows) // 2])
            splits.append((axis, cut))
            left = m[rows, axis] < cut if len(rows) and m.shape[1] else np.zeros(len(rows), bool)
            below += [rows[left], rows[~left]]
        level = below
    return splits


def cell_of(m: np.ndarray, splits: list[tuple[int, int]]) -> np.ndarray:
    """The cell of each row under ``median_cells``."""
    if not splits:
        return np.zeros(len(m), np.int64)
    axis, cut = np.array([s[0] for s in splits]), np.array([s[1] for s in splits])
    node = np.zeros(len(m), np.int64)
    for _ in range((len(splits) + 1).bit_length() - 1):
        inside = axis[node] < m.shape[1]
        value = np.where(inside, m[np.arange(len(m)), np.minimum(axis[node], max(m.shape[1] - 1, 0))] if m.shape[1] else 0, 0)
        node = 2 * node + 1 + (value >= cut[node])
    return node - len(splits)


# --- search in a shard ------------------------------------------------------------------------------


class Best:
    """The k best (score, id, row of the shard) of each query of a block; least holds each query's
    k-th score, or what it came with."""

    def __init__(self, k: int, least: np.ndarray):
        self.k, self.least = k, least
        self.q = self.row = self.id = np.zeros(0, np.int64)
        self.score, self.none = np.zeros(0, least.dtype), np.zeros(0, bool)

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray, none: np.ndarray, row: np.ndarray) -> None:
        q, score, ids, none, row = (np.concatenate(x) for x in ((self.q, q), (self.score, score), (self.id, ids), (self.none, none), (self.row, row)))
        order = np.argsort(ids, kind="stable")
        for key in (none, -score, q):
            order = order[np.argsort(key[order], kind="stable")]
        place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        order = order[place < self.k]
        self.q, self.score, self.id, self.none, self.row = q[order], score[order], ids[order], none[order], row[order]
        last = np.flatnonzero(place[place < self.k] == self.k - 1)
        self.least[self.q[last]] = np.maximum(self.least[self.q[last]], self.score[last])


def search(tree: Tree, ids: np.ndarray, none: np.ndarray, first: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> Best:
    """The k best rows of a shard for each query, as far as they reach ``least``. Row r of the shard
    stands for the ids first[r]:first[r+1]."""
    best = Best(k, least.copy())
    reach = _in_range(bounds(queries, tree.low, tree.high))
    lowest = -np.inf if queries.dtype != object else -(1 << 140)
    queue = np.full((len(queries), len(tree.start)), lowest, queries.dtype)
    queue[:, 0] = reach[:, 0]
    live = np.arange(len(queries))
    while len(live):
        node = queue[live].argmax(axis=1)
        value = queue[live, node]
        on = (value >= best.least[live]) & (value > lowest)
        live, node = live[on], node[on]
        queue[live, node] = lowest
        inner = tree.left[node] >= 0
        for child in (tree.left, tree.right):
            into = child[node[inner]]
            queue[live[inner], into] = reach[live[inner], into]
        asking, leaf = live[~inner], node[~inner]
        order, hits = np.argsort(leaf, kind="stable"), []
        for rows in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1) if len(order) else ():
            q, at = asking[rows], int(leaf[rows[0]])
            a, b = int(tree.start[at]), int(tree.stop[at])
            score = _in_range(queries[q] @ tree.rows[a:b].T)
            cut = best.least[q]
            if b - a > k:
                cut = np.maximum(cut, (np.sort if score.dtype == object else lambda x, axis: np.partition(x, -k, axis=axis))(score, axis=1)[:, -k])
            i, j = np.nonzero(score >= cut[:, None])
            hits.append((q[i], tree.order[a + j], score[i, j]))
        if hits:
            q, row, score = (np.concatenate(x) for x in zip(*hits, strict=True))
            many = first[row + 1] - first[row]
            at = np.repeat(first[row] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            best.add(np.repeat(q, many), np.repeat(score, many), ids[at], none[at], np.repeat(row, many))
    return best


def _walk(k: int, leaf: int):
    """Rows (shard, block, kind, vec, ids, q, least) sorted by shard, block and kind in, vectors (kind
    0) before queries (kind 1); rows (q, vec_id, score, same) out, same where a vector equals the
    query."""

    def answer(shard, rows: list[tuple]) -> pa.RecordBatch:
        m, ids, none, first, most, made = shard
        whole = unpacked([r[0] for r in rows])
        # what lies beyond the shard's longest vector meets zeros
        width = m.shape[1]
        asked, longer = (whole[:, :width], whole[:, width:].any(axis=1)) if whole.shape[1] > width else (np.pad(whole, ((0, 0), (0, width - whole.shape[1]))), np.zeros(len(rows), bool))
        size = float(np.abs(asked.astype(np.float64)).max(initial=0)) * most * max(1, width)
        kind = size < EXACT
        if kind not in made:
            made[kind] = grow_tree(_number(m, size), leaf)
        lowest = -np.inf if kind else -(1 << 130)
        least = np.array([lowest if r[2] is None else r[2] for r in rows], np.float64 if kind else object)
        best = search(made[kind], ids, none, first, _number(asked, size), least, k)
        score = best.score.astype(np.int64)
        same = (m[best.row] == asked[best.q]).all(axis=1) & ~longer[best.q]
        return pa.RecordBatch.from_arrays([pa.array([rows[q][1] for q in best.q], pa.binary()), pa.array(best.id, mask=best.none), pa.array(score), pa.array(same)], names=["q", "vec_id", "score", "same"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, shard, asked = None, [], None, []
        for b in batches:
            for s, block, kind, vec, ids, q, least in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (s, block) != key:
                    if asked:
                        yield answer(shard, asked)
                    key, held, shard, asked = (s, block), [], None, []
                if kind == 0:
                    held.append((vec, ids))
                    continue
                if shard is None:
                    m = unpacked([h[0] for h in held])
                    flat = [i for h in held for i in h[1]]
                    first = np.concatenate([[0], np.cumsum([len(h[1]) for h in held])]).astype(np.int64)
                    shard = (m, np.array([i or 0 for i in flat], np.int64), np.array([i is None for i in flat], bool), first, float(np.abs(m.astype(np.float64)).max(initial=0)), {})
                    held = []
                asked.append((vec, q, least))
                if len(asked) == QUERY_ROWS:
                    yield answer(shard, asked)
                    asked = []
        if asked:
            yield answer(shard, asked)

    return run


# --- plan -------------------------------------------------------------------------------------------


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def whole_vectors(frame: DataFrame, vector: str, id_col: str, scale: int = SCALE) -> DataFrame:
    """Rows (id, vec): usable vectors as packed whole numbers."""
    plain = frame.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(_usable(F.col("v")))
    # zeros at the end say nothing
    numbers = plain.select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))
    last = F.array_position(F.transform(F.reverse("v"), lambda x: x != 0), True)
    kept = F.when(last > 0, F.size("v") + 1 - last).otherwise(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), packed(b.column(1))], names=["id", "vec"])

    return numbers.select("id", F.slice("v", 1, kept.cast("int")).alias("v")).mapInArrow(run, "id bigint, vec binary")


def _in_cells(vectors: DataFrame, splits: list[tuple[int, int]]) -> DataFrame:
    """Adds cell to rows (vec, ...)."""
    names = vectors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = cell_of(unpacked(b.column(names.index("vec")).to_pylist()), splits)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], names=[*names, "cell"])

    return vectors.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in vectors.dtypes) + ", cell int")


def cell_boxes(celled: DataFrame) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(cell, rows, low, high) of every cell that holds vectors, over all of them: CELLS at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            if not b.num_rows:
                continue
            cells, m = b.column(0).to_numpy(), unpacked(b.column(1).to_pylist())
            sizes = np.array([(len(v.as_py()) - 1) // v.as_py()[0] for v in b.column(1)])
            for c in np.unique(cells).tolist():
                rows = m[cells == c]
                low, high, n, full = rows.min(axis=0), rows.max(axis=0), len(rows), sizes[cells == c].min()
                low[full:], high[full:] = np.minimum(low[full:], 0), np.maximum(high[full:], 0)
                if c in held:
                    low2, high2, n2 = held[c]
                    w = max(len(low), len(low2))
                    low, low2 = (np.pad(x, (0, w - len(x))) for x in (low, low2))
                    high, high2 = (np.pad(x, (0, w - len(x))) for x in (high, high2))
                    low, high, n = np.minimum(low, low2), np.maximum(high, high2), n + n2
                held[c] = [low, high, n]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([h[2] for h in held.values()], pa.int64()), pa.array([h[0].tolist() for h in held.values()], pa.list_(pa.int64())), pa.array([h[1].tolist() for h in held.values()], pa.list_(pa.int64()))], names=["cell", "n", "low", "high"])

    parts = celled.select("cell", "vec").mapInArrow(run, "cell int, n bigint, low array<bigint>, high array<bigint>")
    sizes = {r.cell: (r.n, r.w) for r in parts.groupBy("cell").agg(F.sum("n").alias("n"), F.max(F.size("low")).alias("w")).collect()}
    # a part's box ends where its longest vector does; the rest of it is zero
    ends = parts.select("cell", F.posexplode(F.arrays_zip("low", "high")).alias("at", "z")).groupBy("cell", "at").agg(F.min("z.low").alias("low"), F.max("z.high").alias("high"), F.count("*").alias("k")).join(parts.groupBy("cell").agg(F.count("*").alias("parts")), "cell")
    low, high = ({c: np.zeros(w, np.int64) for c, (_, w) in sizes.items()} for _ in range(2))
    for r in ends.select("cell", "at", F.when(F.col("k") < F.col("parts"), F.least("low", F.lit(0))).otherwise(F.col("low")).alias("low"), F.when(F.col("k") < F.col("parts"), F.greatest("high", F.lit(0))).otherwise(F.col("high")).alias("high")).toLocalIterator():
        low[r.cell][r.at], high[r.cell][r.at] = r.low, r.high
    return [(c, n, low[c], high[c]) for c, (n, _) in sorted(sizes.items())]


def _routes(queries: DataFrame, boxes, shards: dict[int, int]) -> DataFrame:
    """Queries (shard, q, vec, least), a row for every shard but a query's first whose cell may hold
    a score of ``least``."""
    base = dict(zip(shards, np.cumsum([0, *shards.values()]).tolist(), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m, least, first = unpacked(b.column(1).to_pylist()), b.column(2).to_pylist(), b.column(3).to_numpy()
            pick, shard = [], []
            for c, _, low, high in boxes:
                w = len(low)
                q = m[:, :w] if m.shape[1] >= w else np.pad(m, ((0, 0), (0, w - m.shape[1])))
                size = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(np.concatenate([low, high]).astype(np.float64)).max(initial=0)) * max(1, w)
                reach = _in_range(bounds(_number(q, size), _number(low[None], size), _number(high[None], size)))[:, 0]
                may = np.array([x is None or r >= x for r, x in zip(reach, least, strict=True)], bool)
                for part in range(base[c], base[c] + shards[c]):
                    pick.append(np.flatnonzero(may & (first != part)))
                    shard.append(np.full(len(pick[-1]), part))
            out = b.take(pa.array(np.concatenate(pick)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shard).astype(np.int32)), *out.columns[:3]], names=["shard", "q", "vec", "least"])

    return queries.select("q", "vec", "least", "first").mapInArrow(run, "shard int, q binary, vec binary, least bigint")


def top_k(frame: DataFrame, vector: str = "embedding", id_col: str = "vec_id", k: int = TOP, scale: int = SCALE, every: int = EVERY, sample: int = SAMPLE, cells: int = CELLS, shard_rows: int = SHARD_ROWS, leaf: int = LEAF, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` the k
    rows of the largest inner products with it among all others, ties to smaller ids."""
    spark = frame.sparkSession
    rows = materialise(whole_vectors(frame, vector, id_col, scale), "kd-rows")
    place = F.row_number().over(Window.partitionBy("vec").orderBy(F.col("id").asc_nulls_last()))
    firsts = rows.withColumn("rn", place).where(F.col("rn") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list(F.struct("rn", "id"))).alias("ids"))
    distinct = materialise(firsts.select("vec", F.col("ids.id").alias("ids")), "kd-vectors")
    count = distinct.count()
    if not count:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    leaves = 1 << (min(cells, -(-count // shard_rows)) - 1).bit_length()
    seen = [bytes(r.vec) for r in distinct.select("vec").orderBy(F.xxhash64("vec")).limit(sample).collect()] if leaves > 1 else []
    splits = median_cells(unpacked(seen), leaves) if seen else []
    celled = materialise(_in_cells(distinct, splits), "kd-cells")
    boxes = cell_boxes(celled)
    shards = {c: -(-n // shard_rows) for c, n, *_ in boxes}
    table = [F.create_map(*(F.lit(x) for c, v in zip(shards, values, strict=False) for x in (c, int(v)))) for values in (np.cumsum([0, *shards.values()]), list(shards.values()))]
    base, parts = (F.element_at(t, F.col("cell")) for t in table)
    shard = (base + F.pmod(F.xxhash64("vec"), parts)).cast("int")

    asked = rows.where(F.col("id") % every == 0).select("id", "vec", F.unhex(F.sha2("vec", 256)).alias("q"))
    # equal queries are searched once, for one more row than wanted, as each leaves out its own
    queries = materialise(_in_cells(asked.groupBy("vec", "q").agg(F.count("*").alias("times")).select("vec", "q"), splits), "kd-queries").withColumn("first", shard)
    blocks = max(1, -(-queries.count() // block_queries))
    copies = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    vectors = celled.select(shard.alias("shard"), copies, F.lit(0).alias("kind"), "vec", "ids", F.lit(None).cast("binary").alias("q"), F.lit(None).cast("bigint").alias("least"))
    width = max(tasks(spark), min(sum(shards.values()) * blocks, 1 << 15))

    def met(wanted: DataFrame) -> DataFrame:
        wanted = wanted.select("shard", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("kind"), "vec", F.lit(None).cast("array<bigint>").alias("ids"), "q", "least")
        both = vectors.unionByName(wanted).repartition(width, "shard", "block").sortWithinPartitions("shard", "block", "kind")
        return both.mapInArrow(_walk(k + 1, leaf), "q binary, vec_id bigint, score bigint, same boolean")

    home = materialise(met(queries.select(F.col("first").alias("shard"), "q", "vec", F.lit(None).cast("bigint").alias("least"))), "kd-home")
    lasts = home.groupBy("q").agg(F.min("score").alias("least"), F.count("*").alias("n")).select("q", F.when(F.col("n") > k, F.col("least")).alias("least"))
    found = home.unionByName(met(_routes(queries.select("q", "vec", "first").join(lasts, "q", "left"), boxes, shards)))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    best = found.withColumn("rn", rank).where(F.col("rn") <= k + 1).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rn", "vec_id", "score", "same"))).alias("hits"))
    met_by = spread_join(asked.select("id", "q"), best, "q", "inner")
    own = F.array_position(F.transform("hits", lambda h: h["same"] & (h["vec_id"].eqNullSafe(F.col("id")))), True)
    rest = F.filter("hits", lambda h, i: i + 1 != own)
    out = met_by.select(F.col("id").alias("query_id"), F.posexplode(F.slice(rest, 1, k)).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")


def op11_topk_search(spark, sf_dir: str) -> DataFrame:
    """The ten nearest rows by inner product of every hundredth embedding."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = f"""WITH v AS (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.k, q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0) AS score FROM v q JOIN v c ON q.k <> c.k WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= {TOP}"""
