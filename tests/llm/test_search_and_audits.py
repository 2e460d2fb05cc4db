"""Top-k search, source divergence and filter audit against brute-force versions, on given, messy and
empty tables."""

import math
import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest

from lumigrid.llm import divergence, filter_audit, kd_search

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("module", "name"), [(kd_search, "op11_topk_search"), (divergence, "op12_source_divergence"), (filter_audit, "op13_filter_audit")])
def test_agrees_with_sql(spark, module, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(module.ORACLE_SQL)
    df = getattr(module, name)(spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*cols).collect())
    assert len(got) > 0 and got == sorted(repr(tuple(r[rel.columns.index(c)] for c in cols)) for r in rel.fetchall())


# --- 11 -----------------------------------------------------------------------------------------------


def brute_top(rows, k=10, every=100):
    usable = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, [max(-(2**63) + 1, min(2**63 - 1, math.floor(1024 * x))) for x in v]))
    out = []
    for a, (i, q) in enumerate(usable):
        if i is not None and i % every == 0:
            found = [(-max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(q, v, strict=False)))), j is None, j or 0) for b, (j, v) in enumerate(usable) if b != a]
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def clustered(n, width, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (7, width))
    return (centres[rng.integers(0, 7, n)] + rng.normal(0, 0.2, (n, width))).astype(np.float32)


def searched(spark, rows, kind="float", **options):
    df = spark.createDataFrame([(*r, 1.0, "x", 3) for r in rows], f"vec_id bigint, embedding array<{kind}>, vec double, ids string, shard int")
    return sorted((tuple(r) for r in kd_search.top_k(df, **options).collect()), key=repr)


SMALL = {"shard_rows": 40, "leaf": 4, "cells": 8, "sample": 60, "block_queries": 7}


@pytest.mark.parametrize("options", [{}, SMALL, SMALL | {"cells": 1}])
def test_search_equals_brute_force(spark, options):
    m = clustered(900, 12)
    rows = [(i * 5, v.tolist()) for i, v in enumerate(m)]
    # copies: of one vector many, of a query's some with smaller ids, of one row all
    rows += [(10_001 + i, m[3].tolist()) for i in range(60)] + [(-100 * i, m[20].tolist()) for i in range(15)] + [(300, m[60].tolist())] * 3 + [(300, m[61].tolist())]
    assert searched(spark, rows, **options) == brute_top(rows)


def test_search_of_messy_vectors(spark):
    rows = [(0, None), (100, [None, 1.0]), (200, [float("nan"), 1.0]), (300, [1.0, float("inf")]), (400, []), (500, [0.0, 0.0]), (600, [1.0]), (700, [1.0, 0.0]), (None, [1.0, 0.0]), (None, [1.0]), (None, None), (701, [1.0, 2.0, 3.0]), (800, [1.0, 2.0, 3.0, -4.0]), (900, [-1.0, 0.00001, 0.5]), (900, [-1.0, 0.00001, 0.5]), (-100, [0.25] * 40)]
    for options in ({}, {"shard_rows": 3, "leaf": 1, "cells": 4, "block_queries": 2}):
        assert searched(spark, rows, **options) == brute_top(rows)
    assert searched(spark, rows[:1]) == searched(spark, []) == []


def test_search_of_very_large_numbers(spark):
    rows = [(i * 50, [1e9 * (i - 5), 3.5e7 * i + 1e-3 * i, -1e6]) for i in range(12)] + [(600, [1e300, 1.0, 1.0]), (601, [-1e300, 0.0, 0.0])]
    for options in ({}, {"shard_rows": 3, "leaf": 1, "cells": 4}):
        assert searched(spark, rows, "double", **options) == brute_top(rows)


def test_search_leaves_most_of_a_clustered_shard_alone():
    """Bounds prune: near queries of far clusters open few leaves."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (16, 16))
    m = np.concatenate([c + rng.integers(-50, 50, (256, 16)) for c in centres]).astype(np.float64)
    tree = kd_search.grow_tree(m, 32)
    opened = Counter()

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                opened["leaves"] += 1
            return super().__getitem__(key)

    tree.rows = tree.rows.view(Watched)
    ids = np.arange(len(m))
    best = kd_search.search(tree, ids, np.zeros(len(m), bool), np.arange(len(m) + 1), m[:1], np.array([-np.inf]), 10)
    score = m @ m[0]
    assert best.id.tolist() == sorted(range(len(m)), key=lambda j: (-score[j], j))[:10]
    assert 0 < opened["leaves"] <= 16 < (tree.left < 0).sum()


# --- 12 -----------------------------------------------------------------------------------------------


def brute_divergence(rows, least, top=10):
    upper = {c: c + 32 for c in range(65, 91)}
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(upper))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        seen = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = sorted(t for t, n in seen.items() if n >= least)
        counts = {s: Counter(t for d in docs if d[:2] == (lang, s) for t in d[2] if seen[t] >= least) for s in {d[1] for d in docs if d[0] == lang}}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        shares, whole = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        gap = lambda p, q: (p - q) ** 2 // (p + q)
        for s, p in shares.items():
            pairs = [(o, sum(gap(p[t], q[t]) for t in kept)) for o, q in shares.items() if o != s]
            terms = [(t, gap(p[t], whole[t])) for t in kept if counts[s][t] and p[t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, item, v, r + 1) for r, (item, v) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most])]
    return sorted(out)


def test_divergence_equals_brute_force_in_any_sketch(spark):
    rng = np.random.default_rng(5)
    vocabulary = [*(f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(100)), "Über", "über", "日本", "𝒳y"]
    rows = [(" ".join(rng.choice(vocabulary, rng.integers(0, 30), p=(w := rng.dirichlet(np.ones(104) * 0.3))).tolist()), ("en", "de", None)[k % 3], ("a", "B", "b", None, "")[k % 5]) for k in range(90)]
    rows += [(None, None, None), ("", "fr", "only"), ("12 34 ;;", "fr", "digits"), ("ABC abc aBc-abc_x1y\x00z\x7fq{r", "it", "s"), ("abc x y z q r", "it", "s"), ("é" * 5000 + " " + "x" * 70000, "it", "t")] + [("same text twice", "en", "a")] * 2
    df = spark.createDataFrame([(*r, 1, "k", 2.0) for r in rows], "text string, lang string, source string, n int, term string, docs double")
    for least, width in ((2, 64), (3, 1 << 16), (1, 8)):
        got = sorted(tuple(r) for r in divergence.audit(df, least=least, width=width).collect())
        assert got == brute_divergence(rows, least), (least, width)


def test_divergence_of_messy_and_empty_tables(spark, messy, empty):
    rows = [(r.text, r.lang, r.source) for r in messy.collect()]
    assert sorted(tuple(r) for r in divergence.audit(messy, least=2).collect()) == brute_divergence(rows, 2)
    assert divergence.audit(empty).count() == 0


# --- 13 -----------------------------------------------------------------------------------------------


def brute_audit(rows, labels):
    """rows (doc_id, text, lang), labels (doc_id, quality, toxic)."""
    good, bad = {i for i, q, _ in labels if i is not None and q == 1}, {i for i, _, t in labels if i is not None and t == 1}
    cells = Counter()
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "".join(c for c, f in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)), strict=True) if f)
        cells[lang or "", fails, i in good, i in bad] += 1
    out = []
    for part in {c[0] for c in cells}:
        mine, total = [(f, g, b, n) for (p, f, g, b), n in cells.items() if p == part], Counter()
        found = []
        for order in map("".join, permutations("ABCDE")):
            for k, c in enumerate(order):
                r = Counter()
                for f, g, b, n in mine:
                    earlier = any(x in f for x in order[:k])
                    r["kept"] += n * (c not in f and not earlier)
                    r["removed"] += n * (c in f and not earlier)
                    r["redundant"] += n * (c in f and earlier)
                    r["unique"] += n * (f == c)
                    r["good"] += n * (c in f and not earlier and g)
                    r["toxic"] += n * (c in f and not earlier and b)
                total[c] += r["removed"]
                found.append((part, order, k + 1, c, *(r[x] for x in ("kept", "removed", "redundant", "unique", "good", "toxic"))))
        out += [(*f[:3], *f[4:], total[f[3]]) for f in found]
    return sorted(out)


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_filter_audit_of_messy_and_empty_tables(spark, messy, empty):
    labels = [(1, 1, 0), (2, 0, 1), (None, 1, 1), (777, 1, 1), (3, None, 1), (30, 1, None), (30, 0, 1), (31, 1, 1), (-(1 << 63), 1, 0)]
    marks = spark.createDataFrame([(*r, 1, 2) for r in labels], "doc_id bigint, quality int, toxic int, n int, mask int")
    rows = [(r.doc_id, r.text, r.lang) for r in messy.collect()]
    shout = [(40 + k, t, "en") for k, t in enumerate(("LOUD WORDS # of few", "a b c " * 60, " ".join(f"t{j}" for j in range(130)), " ".join(f"t{j}" for j in range(130)), " ".join(f"T{j}|" for j in range(100))))]
    wide = messy.select("doc_id", "text", "lang", "copies", "id", "key").unionByName(spark.createDataFrame([(*r, 1, 1, "x") for r in shout], "doc_id bigint, text string, lang string, copies int, id int, key string"))
    got = sorted(tuple(r) for r in filter_audit.audit(wide, marks).select(*COLUMNS).collect())
    assert got == brute_audit(rows + shout, labels)
    assert filter_audit.audit(empty, marks).count() == 0
    assert filter_audit.audit(wide, marks.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0


def test_filter_audit_takes_other_filters(spark):
    df = spark.createDataFrame([(1, "a", "en"), (2, "b", "en"), (3, "b", "en")], "doc_id int, text string, lang string")
    none = spark.createDataFrame([], "doc_id int, quality int, toxic int")
    got = {(r.filter_order, r.letter): (r.kept, r.removed, r.redundant, r.shapley) for r in filter_audit.audit(df, none, filters={"X": lambda text, words: text == "b"}).collect()}
    assert got == {("XE", "X"): (1, 2, 0, 3), ("XE", "E"): (1, 0, 1, 1), ("EX", "E"): (2, 1, 0, 1), ("EX", "X"): (1, 1, 1, 3)}
