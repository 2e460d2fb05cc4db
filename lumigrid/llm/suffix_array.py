"""Removal of repeated passages with a distributed sparse suffix array over bytes.

Every byte covered by a ``LENGTH``-byte string that also starts earlier (in a document of smaller
id, or earlier in the same one) is removed; strings don't cross documents.

Suffixes are sorted at anchors instead of at every byte. The anchor of a ``LENGTH``-byte window is
the place of its smallest ``SEED``-byte hash (the last of equal ones), which depends on the window's
bytes alone, so equal windows have equal anchors at equal offsets: comparing the windows of equal
anchors compares all windows. 1. Copies of whole texts are set aside (all but the first of equal
texts goes, if it is long enough). 2. Anchor hashes are packed per batch and partition; partitions
by hash keep those that occur more than once. 3. The documents that hold any are met with their
anchors, and for each anchor the bytes around it that its windows span go out as a suffix entry.
Anchors whose bytes an earlier anchor of the same document has are settled in the scan: their windows
recur, and others compare with the earlier ones, so periodic text makes no more entries than a period.
4. Sampled splitters over (leading bytes, id, place) range-partition the entries, so that a passage
that very many documents share spreads over several buckets. 5. A bucket sorts its entries by
multikey quicksort on 8-byte words, and marks windows that an earlier entry of its run of equal
leading bytes has. Where a run crosses bucket boundaries, the first occurrence of each of its
windows goes on, and a grouped minimum over them compares across boundaries.

Null and empty texts are kept as they are (nothing to remove). Ids may be of any type that sorts;
null ids sort first. Repeated rows are copies: of rows equal in id and text all but one are removed,
each with a row of its own in the result. Windows are told apart by 64-bit hashes of their bytes;
anchors are compared byte by byte over the ``SEED`` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigrid.llm.store import fresh, materialise, materialise_seen, spread_join, tasks
from lumigrid.llm.text import binary, mix64, sliced, text_buffer

LENGTH, SEED = 100, 32
SPAN = LENGTH - SEED  # windows reach that far before their anchor
SAMPLE_PER_BUCKET, PIECE = 64, 1 << 19
_MULT = np.uint64(0x9E3779B97F4A7C15)


# --- anchors -----------------------------------------------------------------------------------------


def seed_hashes(buf: np.ndarray) -> np.ndarray:
    """Hash of the SEED bytes at each place: four 8-byte words, mixed (doubling not needed)."""
    n = len(buf) - SEED + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    wide = np.ndarray((len(buf),), "<u8", padded, 0, (1,))
    with np.errstate(over="ignore"):
        h = wide[:n] * _MULT
        for k in range(8, SEED, 8):
            h ^= h >> np.uint64(32)
            h += wide[k : n + k]
            h *= _MULT
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(32)
    return h


def sliding_last_min(h: np.ndarray, width: int) -> np.ndarray:
    """For each start, the place of the smallest of ``width`` values (the last of equal ones)."""
    n = len(h) - width + 1
    at, value, have = np.arange(len(h)), h, 1
    while have < width:
        step = min(have, width - have)
        m = len(value) - step
        right = value[step : step + m] <= value[:m]
        value = np.where(right, value[step : step + m], value[:m])
        at = np.where(right, at[step : step + m], at[:m])
        have += step
    return at[:n]


def anchors(buf: np.ndarray, offsets: np.ndarray, step: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a batch: place in ``buf``, hash, first and last window start that it owns. Long
    buffers are taken in pieces of ``step`` windows."""
    size = np.diff(offsets)
    long = np.flatnonzero(size >= LENGTH)
    out = []
    if len(long):
        begin, end = offsets[:-1][long], offsets[1:][long] - LENGTH + 1  # windows inside one document
        for at in range(0, len(buf) - LENGTH + 1, step):
            h = seed_hashes(buf[at : at + step + LENGTH - 1])
            own = sliding_last_min(h, SPAN + 1)
            x, y = np.clip(begin - at, 0, len(own)), np.clip(end - at, 0, len(own))
            inside = np.zeros(len(own) + 1, np.int32)
            np.add.at(inside, x, 1)
            np.add.at(inside, y, -1)
            start = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
            if len(start):
                own = own[start]
                cut = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1)))
                out.append((own[cut] + at, h[own[cut]], start[cut] + at, start[np.append(cut[1:], len(start)) - 1] + at))
    if not out:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    place, h, lo, hi = (np.concatenate([x[k] for x in out]) for k in range(4))
    on = np.append(True, (place[1:] != place[:-1]) | (lo[1:] != hi[:-1] + 1))  # a piece's end may part an anchor
    return place[on], h[on], lo[on], hi[np.append(np.flatnonzero(on)[1:], len(on)) - 1]


def recurring(buf: np.ndarray, offsets: np.ndarray, place: np.ndarray, h: np.ndarray, lo: np.ndarray, hi: np.ndarray, chunk: int = 1 << 14) -> np.ndarray:
    """Anchors all of whose windows occur earlier in the same document: their bytes equal, one by
    one, those of the document's first anchor of the same hash and reach."""
    row = np.searchsorted(offsets, place, "right").astype(np.uint64)
    with np.errstate(over="ignore"):
        kind = mix64(h ^ mix64((row << np.uint64(20)) ^ ((place - lo).astype(np.uint64) << np.uint64(10)) ^ (hi - lo).astype(np.uint64)))
    _, first, inverse = np.unique(kind, return_index=True, return_inverse=True)
    first = first[inverse]
    out = np.zeros(len(place), bool)
    todo = np.flatnonzero((first != np.arange(len(place))) & (row[first] == row) & (place - lo == (place - lo)[first]) & (hi - lo == (hi - lo)[first]))
    col = np.arange(SPAN + 1 + LENGTH)
    for at in range(0, len(todo), chunk):
        own = todo[at : at + chunk]
        width = (hi - lo)[own] + LENGTH
        x, y = (np.minimum(k[:, None] + col, len(buf) - 1) for k in (lo[own], lo[first[own]]))
        out[own] = ((buf[x] == buf[y]) | (col >= width[:, None])).all(axis=1)
    return out


# --- the local sort ----------------------------------------------------------------------------------


def multikey_sort(lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of fixed-width strings given as big-endian 8-byte words (rows x words), and the class
    of equal strings of each place in that order. Strings are split by one word at a time; only
    classes that are still equal are split further."""
    order, group = np.arange(len(lanes)), np.zeros(len(lanes), np.int64)
    for k in range(lanes.shape[1]):
        size = np.bincount(group) if len(group) else np.zeros(0, np.int64)
        live = np.flatnonzero(size[group] > 1)
        if not len(live):
            break
        word = lanes[order[live], k]
        by = np.lexsort((word, group[live]))
        order[live] = order[live][by]
        word = word[by]
        g = group[live]
        new = np.zeros(len(order), np.int64)
        edge = np.concatenate([[False], (word[1:] != word[:-1]) & (g[1:] == g[:-1])])
        new[live] = edge
        new[np.flatnonzero(np.concatenate([[False], group[1:] != group[:-1]]))] = 1
        group = np.cumsum(new)
    return order, group


def window_hashes(data: np.ndarray) -> np.ndarray:
    """Prefix hashes of rows of bytes (rows x width+1): the hash of [a, b) is pre[b] - pre[a]*B**(b-a)."""
    pre = np.zeros((len(data), data.shape[1] + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(data.shape[1]):
            pre[:, k + 1] = pre[:, k] * _BASE + data[:, k].astype(np.uint64) + np.uint64(1)
    return pre


_BASE = np.uint64(0xD6E8FEB86659FD93)
_POWER = np.uint64(pow(int(_BASE), LENGTH, 1 << 64))
WIDTH = SPAN + LENGTH  # bytes around an anchor that its windows can span


def first_windows(ctx: np.ndarray, lead: np.ndarray, lo: np.ndarray, hi: np.ndarray, anchor: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of entries: (entry, offset, key). Entry e's bytes ctx[e] begin ``lead[e]`` bytes
    before its anchor; it owns the windows that start ``lo`` to ``hi`` bytes after there."""
    count = hi - lo + 1
    entry = np.repeat(np.arange(len(ctx)), count)
    at = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    pre = window_hashes(ctx)
    with np.errstate(over="ignore"):
        h = pre[entry, at + LENGTH] - pre[entry, at] * _POWER
        key = mix64(h ^ (anchor[entry] * _MULT)) + (lead[entry] - at).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    return entry, at, mix64(key)


# --- over a table ------------------------------------------------------------------------------------


_LISTED = "kind int, batch bigint, part int, key bigint, data binary, codes binary"
_NAMES = ["kind", "batch", "part", "key", "data", "codes"]


def _list_anchors(parts: int, sample: float):
    """Batches of texts in. Rows of kind 0 hold a document's anchor places, each with a number in
    the batch's list of distinct hashes; of kind 1 that list in one partition of hashes, with a
    mark where the batch itself has the hash twice; of kind 2 sampled leading bytes; of kind 3 the
    spans of windows that recur inside a document."""

    def rows(kind: int, batch: int, part: list, key: list, data: list, codes: list) -> pa.RecordBatch:
        n = len(data)
        return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array([batch] * n, pa.int64()), pa.array(part, pa.int32()), pa.array(key, pa.int64()), pa.array(data, pa.binary()), pa.array(codes, pa.binary())], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, limit = TaskContext.get().partitionId() << 24, np.uint64(min(sample, 1.0) * (2**64 - 2**12))
        for b in sliced(batches, "text"):
            buf, offsets = text_buffer(b.column(1))
            place, h, lo, hi = anchors(buf, offsets)
            if not len(place):
                continue
            batch += 1
            keys = b.column(0).to_numpy()
            again = recurring(buf, offsets, place, h, lo, hi)
            if again.any():
                row = np.searchsorted(offsets, place[again], "right") - 1
                row, x, y = join_spans(row, lo[again] - offsets[row], hi[again] + LENGTH - offsets[row])
                have, edge = np.unique(row, return_index=True)
                edge = np.append(edge, len(row))
                yield rows(3, batch, [-1] * len(have), keys[have].tolist(), [x[p:q].astype(np.int64).tobytes() for p, q in zip(edge, edge[1:], strict=False)], [y[p:q].astype(np.int64).tobytes() for p, q in zip(edge, edge[1:], strict=False)])
            place, h = place[~again], h[~again]
            row = np.searchsorted(offsets, place, "right") - 1
            distinct, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
            part = (distinct >> np.uint64(40)).astype(np.int64) % parts
            order = np.argsort(part, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            found = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
            h_of, twice = distinct[order], (count[order] > 1)
            yield rows(1, batch, found, [None] * len(found), [h_of[cuts[p] : cuts[p + 1]].tobytes() for p in found], [np.packbits(twice[cuts[p] : cuts[p + 1]]).tobytes() for p in found])
            have, first = np.unique(row, return_index=True)
            edge = np.append(first, len(row))
            near, codes = (place - offsets[row]).astype(np.int32), rank[inverse]
            yield rows(0, batch, [-1] * len(have), keys[have].tolist(), [near[x:y].tobytes() for x, y in zip(edge, edge[1:], strict=False)], [codes[x:y].tobytes() for x, y in zip(edge, edge[1:], strict=False)])
            pick = np.flatnonzero(mix64(h ^ (keys[row].astype(np.uint64) * _MULT) ^ near.astype(np.uint64)) <= limit)
            if len(pick):
                yield rows(2, batch, [-1] * len(pick), keys[row[pick]].tolist(), [x.tobytes() for x in heads(buf, place[pick])], [None] * len(pick))

    return run


def heads(buf: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The eight leading bytes at places, as integers in the order of the bytes."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    wide = np.ndarray((len(buf),), ">u8", padded, 0, (1,))
    return (wide[place].astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash lists of some partitions in; for each list, which of its hashes occur elsewhere too.
    A hash comes once per batch at most, however often the batch has it."""
    asked: dict[int, list] = {}
    for b in batches:
        for batch, part, data, twice in zip(*(c.to_pylist() for c in b.columns), strict=True):
            h = np.frombuffer(data, np.uint64)
            asked.setdefault(part, []).append((batch, h, np.unpackbits(np.frombuffer(twice, np.uint8), count=len(h)).astype(bool)))
    for part, rows in asked.items():
        h, twice = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])
        order = np.argsort(h, kind="stable")
        same = np.append(False, h[order][1:] == h[order][:-1])
        twice[order] |= same | np.append(same[1:], False)
        cuts = np.cumsum([0, *(len(r[1]) for r in rows)])
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array([twice[x:y].astype(np.uint8).tobytes() for x, y in zip(cuts, cuts[1:], strict=False)], pa.binary())], names=["batch", "part", "data"])


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch's answers in partition order, then its documents, in; repeated places out."""
    batch, flags, known = None, [], None
    for b in batches:
        keys, places = [], []
        for own, kind, key, data, codes in zip(*(b.column(c).to_pylist() for c in (0, 1, 3, 4, 5)), strict=True):
            if own != batch:
                batch, flags, known = own, [], None
            if kind == 0:
                flags.append(np.frombuffer(data, np.uint8))
                continue
            known = np.concatenate(flags).astype(bool) if known is None else known
            on = known[np.frombuffer(codes, np.uint32)]
            if on.any():
                keys.append(key)
                places.append(np.frombuffer(data, np.int32)[on].tobytes())
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(places, pa.binary())], names=["key", "places"])


def _entries(split_head: np.ndarray, split_ord: np.ndarray):
    """Documents with their repeated anchors in; suffix entries with their buckets out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            buf, offsets = text_buffer(b.column(1))
            place, _, lo, hi = anchors(buf, offsets)
            row = np.searchsorted(offsets, place, "right") - 1
            keep = np.zeros(len(buf) + 1, bool)
            for r, blob in enumerate(b.column(2).to_pylist()):
                keep[np.frombuffer(blob, np.int32) + offsets[r]] = True
            on = keep[place]
            place, lo, hi, row = place[on], lo[on], hi[on], row[on]
            if not len(place):
                continue
            head, key = heads(buf, place), b.column(0).to_numpy()[row]
            left, right = np.searchsorted(split_head, head), np.searchsorted(split_head, head, "right")
            for h in np.unique(head[left < right]):  # equal leading bytes: by document
                tie = np.flatnonzero(head == h)
                x, y = left[tie[0]], right[tie[0]]
                left[tie] = x + np.searchsorted(split_ord[x:y], key[tie], "right")
            size = hi + LENGTH - lo
            begin = np.concatenate([[0], np.cumsum(size)])
            data = buf[np.repeat(lo - begin[:-1], size) + np.arange(begin[-1])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(left.astype(np.int32)), pa.array(head), pa.array(key), pa.array(lo - offsets[row]), pa.array((place - lo).astype(np.int32)), pa.array((hi - lo).astype(np.int32)), binary(data, begin)],
                names=["bucket", "head", "ord", "start", "lead", "more", "bytes"],
            )

    return run


ENTRY = "bucket int, head bigint, ord bigint, start bigint, lead int, more int, bytes binary"
FOUND = "ord bigint, start bigint, stop bigint, key bigint"


def _resolve(shared: set[int]):
    """A bucket's entries in. Out: spans (start, stop) of windows that occur earlier in the bucket,
    and for runs whose leading bytes are in ``shared`` (they reach other buckets) the first
    occurrence of each window with its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got).combine_chunks()
        head, ord_, start = (table[c].to_numpy() for c in ("head", "ord", "start"))
        lead, more = table["lead"].to_numpy().astype(np.int64), table["more"].to_numpy().astype(np.int64)
        flat, off = text_buffer(table["bytes"])
        # runs of equal leading bytes, whole runs at a time in pieces of bounded size
        by = np.lexsort((start, ord_, head))
        edges = np.flatnonzero(np.append(True, head[by][1:] != head[by][:-1]))
        pieces, size = [], np.diff(np.append(edges, len(by)))
        group = np.cumsum(size) // 20_000
        for g in np.split(np.arange(len(edges)), np.flatnonzero(np.diff(group)) + 1):
            pieces.append(by[edges[g[0]] : edges[g[-1]] + size[g[-1]]])
        for rows in pieces:
            yield from one(head[rows], ord_[rows], start[rows], lead[rows], more[rows], flat, off[:-1][rows], off[1:][rows])

    def one(head, ord_, start, lead, more, flat, a, b) -> Iterator[pa.RecordBatch]:
        # each entry laid out with its anchor at byte SPAN
        ctx = np.zeros((len(head), WIDTH + 8), np.uint8)
        width = b - a
        row = np.repeat(np.arange(len(head)), width)
        col = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        ctx[row, col + np.repeat(SPAN - lead, width)] = flat[np.repeat(a, width) + col]
        shape = np.zeros((len(head), 8), np.uint8)
        shape[:, 0], shape[:, 1] = lead, more
        right = np.ascontiguousarray(np.concatenate([ctx[:, SPAN : SPAN + SEED], ctx[:, :SPAN], ctx[:, SPAN + SEED : SPAN + LENGTH], np.zeros((len(head), -(LENGTH + SPAN) % 8), np.uint8), shape], axis=1)).view(">u8").astype(np.uint64)
        # sort the suffixes, equal ones by document and place; runs share the whole anchor
        base = np.lexsort((start, ord_))
        order, same = multikey_sort(right[base])
        order = base[order]
        seeds = right[:, : SEED // 8]
        anchor_edge = np.append(True, (seeds[order][1:] != seeds[order][:-1]).any(axis=1))
        anchor = np.cumsum(anchor_edge)
        crossing = np.array([int(x) in shared for x in head[order]]) if shared else np.zeros(len(order), bool)
        again = np.append(False, same[1:] == same[:-1])
        spans = [(ord_[order[again]], start[order[again]], start[order[again]] + more[order[again]] + LENGTH)]
        fresh = order[~again]
        in_run = np.bincount(anchor[~again])[anchor[~again]]
        need = (in_run > 1) | crossing[~again]
        fresh, anchor_of, cross = fresh[need], anchor[~again][need], crossing[~again][need]
        keys = []
        if len(fresh):
            name = mix64(seeds[fresh, 0])
            for k in range(1, SEED // 8):
                name = mix64(name ^ seeds[fresh, k])
            entry, at, key = first_windows(ctx[fresh][:, :WIDTH], np.full(len(fresh), SPAN), SPAN - lead[fresh], SPAN - lead[fresh] + more[fresh], name, fresh)
            where = start[fresh][entry] + at - (SPAN - lead[fresh][entry])
            sort = np.lexsort((where, ord_[fresh][entry], key))
            later = np.append(False, key[sort][1:] == key[sort][:-1])
            hit = np.sort(sort[later])
            spans.append((ord_[fresh][entry[hit]], where[hit], where[hit] + LENGTH))
            on = sort[~later]
            on = on[cross[entry[on]]]
            keys.append((ord_[fresh][entry[on]], where[on], where[on] + LENGTH, key[on]))
        o, s, e = (np.concatenate([x[k] for x in spans]) for k in range(3))
        o, s, e = join_spans(o, s, e)
        yield pa.RecordBatch.from_arrays([pa.array(o), pa.array(s), pa.array(e), pa.nulls(len(o), pa.int64())], names=["ord", "start", "stop", "key"])
        for o, s, e, k in keys:
            yield pa.RecordBatch.from_arrays([pa.array(o), pa.array(s), pa.array(e), pa.array(k.view(np.int64))], names=["ord", "start", "stop", "key"])

    return run


def join_spans(o: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document, overlapping or touching ones joined."""
    if not len(o):
        return o, s, e
    by = np.lexsort((e, s, o))
    o, s, e = o[by], s[by], e[by]
    shift = np.cumsum(np.append(0, o[1:] != o[:-1])) * (int(e.max()) + 2)
    reach = np.maximum.accumulate(e + shift)
    edge = np.flatnonzero(np.append(True, (s + shift)[1:] > reach[:-1]))
    return o[edge], s[edge], reach[np.append(edge[1:], len(o)) - 1] - shift[edge]


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of packed spans in, one row a span out."""
    for b in batches:
        for key, starts, stops in zip(*(b.column(c).to_pylist() for c in (b.schema.get_field_index(k) for k in ("key", "data", "codes"))), strict=True):
            x, y = np.frombuffer(starts, np.int64), np.frombuffer(stops, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(x), pa.int64()), pa.array(x), pa.array(y)], names=["ord", "start", "stop"])


def repeated_spans(docs: DataFrame, chosen: DataFrame, n_bytes: int) -> DataFrame:
    """Rows (ord, start, stop): spans of bytes to remove from the documents (key, text) whose key is
    in ``chosen``; smaller keys are earlier. Spans of a document may overlap."""
    spark = docs.sparkSession
    parts = tasks(spark)
    texts = docs.where(F.octet_length("text") >= LENGTH)
    sample = parts * SAMPLE_PER_BUCKET / max(1, n_bytes * 2 // (SPAN + 2))
    listed = materialise(texts.mapInArrow(_list_anchors(parts, sample), _LISTED), "suffix-anchors")
    asked = listed.where("kind = 1").select("batch", "part", "data", "codes").repartition(parts, "part")
    answers = asked.mapInArrow(_answer, "batch bigint, part int, data binary")
    told = answers.select("batch", F.lit(0).alias("k"), "part", F.lit(None).cast("bigint").alias("key"), "data", F.lit(None).cast("binary").alias("codes"))
    waiting = listed.where("kind = 0").select("batch", F.lit(1).alias("k"), "part", "key", "data", "codes")
    marked = told.union(waiting).repartition(parts, "batch").sortWithinPartitions("batch", "k", "part").mapInArrow(_mark, "key bigint, places binary")
    marked = materialise(marked.join(chosen, "key", "left_semi"), "suffix-marked")
    # splitters by (leading bytes, document), from a sample of about parts * SAMPLE_PER_BUCKET
    found = sorted((int(np.frombuffer(r["data"], np.int64)[0]), r["key"]) for r in listed.where("kind = 2").orderBy(F.xxhash64("data", "key")).limit(4 * parts * SAMPLE_PER_BUCKET).select("data", "key").collect())
    splits = sorted({found[len(found) * i // parts] for i in range(1, parts)}) if len(found) >= parts else []
    split_head, split_ord = np.array([x[0] for x in splits], np.int64), np.array([x[1] for x in splits], np.int64)
    shared = {h for h, _ in splits}
    entries = texts.join(marked, "key").select("key", "text", "places").mapInArrow(_entries(split_head, split_ord), ENTRY)
    spans = materialise(entries.repartition(parts, "bucket").mapInArrow(_resolve(shared), FOUND), "suffix-spans")
    inner = listed.where("kind = 3").join(chosen, "key", "left_semi").mapInArrow(_unpack, "ord bigint, start bigint, stop bigint")
    local = spans.where("key is null").select("ord", "start", "stop").union(inner)
    if not shared:
        return local
    # first occurrences in their buckets, compared across boundaries
    crossing = spans.where("key is not null")
    first = crossing.groupBy("key").agg(F.min(F.struct("ord", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    far = crossing.join(first, "key").where(F.struct("ord", "start") != F.col("first")).select("ord", "start", "stop")
    return local.union(far)


CUT = "n_removed bigint, n_spans bigint, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their spans in; counts and the bytes kept out."""
    for b in sliced(batches, "text"):
        buf, offsets = text_buffer(b.column(1))
        raw, kept, spans = buf.tobytes(), [], []
        for r, (starts, stops) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
            _, s, e = join_spans(np.zeros(len(starts), np.int64), np.array(starts, np.int64), np.array(stops, np.int64))
            at, z, out = int(offsets[r]), int(offsets[r + 1]), []
            for x, y in zip((s + offsets[r]).tolist(), (e + offsets[r]).tolist(), strict=True):
                out.append(raw[at:x])
                at = y
            kept.append(b"".join([*out, raw[at:z]]))
            spans.append(len(s))
        size = np.diff(offsets)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size - np.array([len(k) for k in kept], np.int64)), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["key", *[x.split()[0] for x in CUT.split(", ")]])


def keyed(docs: DataFrame, text: str, id_col: str) -> tuple[DataFrame, DataFrame, int, int]:
    """Documents as (key, text), a table (key, id, digest, n_bytes, rows, copy) with a row for each
    distinct id and text, the bytes in all, and the most rows that one id and text of a hundred bytes
    or more has. Keys are the ids where those are whole numbers, unique
    and not null; else they number ids and digests in order, null ids first."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    meta = base.select("id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")).groupBy("id", "digest", "n_bytes").agg(F.count("*").alias("rows"))
    meta, seen = materialise_seen(meta, "suffix-texts", bare=F.count_if(F.col("id").isNull()), size=F.sum("n_bytes"), rows=F.count(F.lit(1)), most=F.max("rows"), long=F.max(F.when(F.col("n_bytes") >= LENGTH, F.col("rows"))))
    bare, size, rows, most, long = (seen[k] or 0 for k in ("bare", "size", "rows", "most", "long"))
    whole = docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    if whole and not bare and most <= 1 and meta.select("id").distinct().count() == rows:
        meta = meta.withColumn("key", F.col("id").cast("long"))
        texts = base.select(F.col("id").cast("long").alias("key"), "text")
    else:
        ordered = meta.repartitionByRange(tasks(docs.sparkSession), "id", "digest").sortWithinPartitions("id", "digest")
        meta = materialise(ordered.withColumn("key", F.monotonically_increasing_id()), "suffix-keys")
        names = meta.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), "key")
        texts = base.dropDuplicates(["id", "text"]).join(names, F.col("id").eqNullSafe(F.col("__id")) & (F.sha2("text", 256) == F.col("__digest"))).select("key", "text")
    first = meta.groupBy("digest").agg(F.min("key").alias("first"))
    return texts, spread_join(meta, first, "digest", "inner", total=rows).withColumn("copy", F.col("key") > F.col("first")).drop("first"), size, long


def remove_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows (id, digest, n_bytes, n_removed, n_spans, kept), one per input row. digest is the SHA-256
    of the text; kept is null where nothing or everything was removed."""
    texts, meta, size, _ = keyed(docs, text, id_col)
    meta = materialise(meta, "suffix-meta")
    spans = repeated_spans(texts, meta.where("not copy").select("key"), size)
    by_doc = spans.groupBy(F.col("ord").alias("key")).agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    cut = texts.join(by_doc, "key").select("key", "text", "starts", "stops").mapInArrow(_cut, f"key bigint, {CUT}")
    gone = (F.col("copy") | (F.col("nth") > 1)) & (F.col("n_bytes") >= LENGTH)
    out = meta.join(cut, "key", "left").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return out.select(
        "id", "digest", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(~gone, F.col("kept")).alias("kept"),
    )


def drop_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with repeated passages cut out of the texts. Bytes of a character that is cut
    through are dropped; documents of which no word is left go, and of repeated rows of a hundred
    bytes or more all but one. n_chars, where there is one, is counted anew."""
    texts, meta, size, most = keyed(docs, text, id_col)
    meta = materialise(meta, "suffix-meta")
    spans = repeated_spans(texts, meta.where("not copy").select("key"), size)
    by_doc = spans.groupBy(F.col("ord").alias("key")).agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    gone = F.col("copy") & (F.col("n_bytes") >= LENGTH)
    own, digest, away, begin, end, hit = fresh(docs, "id", "digest", "gone", "starts", "stops", "hit")
    hits = meta.withColumn("gone", gone).join(by_doc, "key", "left").where("gone or starts is not null")
    hits = hits.select(F.col("id").alias(own), F.col("digest").alias(digest), F.col("gone").alias(away), F.col("starts").alias(begin), F.col("stops").alias(end))
    marked = docs.withColumn(digest, F.sha2(F.coalesce(text, F.lit("")), 256))
    if most > 1:
        long = F.coalesce(F.octet_length(text), F.lit(0)) >= LENGTH
        marked = marked.where(long).dropDuplicates([id_col, digest]).union(marked.where(~long))
    # documents move once, to meet what is cut from them
    joined = marked.join(hits.withColumnRenamed(digest, f"{digest}_"), F.col(id_col).eqNullSafe(F.col(own)) & (F.col(digest) == F.col(f"{digest}_")), "left").drop(own, digest, f"{digest}_")
    columns = docs.columns
    at = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, text):
            new = b.column(at).to_pylist()
            changed = [False] * b.num_rows
            for r, (whole, starts, stops) in enumerate(zip(*(b.column(len(columns) + k).to_pylist() for k in range(3)), strict=True)):
                if whole or starts:
                    raw, changed[r], out, last = new[r].encode(), True, [], 0
                    _, s, e = (None, [0], [len(raw)]) if whole else join_spans(np.zeros(len(starts), np.int64), np.array(starts, np.int64), np.array(stops, np.int64))
                    for x, y in zip(s, e, strict=True):
                        out.append(raw[last:x])
                        last = y
                    new[r] = b"".join([*out, raw[last:]]).decode("utf-8", "ignore")
            parts = list(b.columns[: len(columns)])
            parts[at] = pa.array(new, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*parts, pa.array(changed)], names=[*columns, hit])

    out = joined.mapInArrow(run, docs.limit(0).withColumn(hit, F.lit(False)).schema)
    out = out.where(~F.col(hit) | F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col(hit), F.char_length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)


def op2_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """What is removed from every document."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kept = F.when(F.col("n_removed") == 0, F.col("digest")).otherwise(F.sha2(F.coalesce("kept", F.lit(b"")), 256))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", kept.alias("kept_sha256"))
