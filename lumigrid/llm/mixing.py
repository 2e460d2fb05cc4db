"""Mixing sources to target weights over fixed-length token blocks.

The words of each source are laid end to end (documents in a fixed pseudorandom chunk order, by id
inside a chunk) and cut into blocks of ``block_words``. Each source gets a whole number of output
slots that fits its target. Every slot of a source draws an output shard by a keyed hash, so a
source's counts per shard are a multinomial draw whose total is the source's number of slots: each
shard is mixed, targets are met to about a block, and shards hold about ``shard_slots`` slots. Slots
are numbered shard by shard from those counts, and a source's j-th slot reads block
``perm(j mod blocks)`` of pass ``j div blocks``, with a permutation of its own per source and pass;
blocks are joined by (source, index). A block is thus read at most once a pass, and the draw decides
which shard reads which block: documents carry the first shard that reads them, and mixed documents
are written in that order.

Permutations are swap-or-not shuffles: they need no table, work for any size, and are whole-number
arithmetic that gives the same order on every run and engine. ROUNDS is as many as one compiled
stage holds: two neighbours stay neighbours through all rounds once in 2**ROUNDS. Everything is Spark
SQL. Running offsets are two-level (inside chunks of documents or groups of shards, then over their
totals), so no task holds a source; a source's slots are generated in ranges.

Null texts have size 0 and are never taken; a null source is a source of its own, ordered last.
Ids may be of any type that sorts; null ids are spread by their texts and come first in a chunk.
Repeated rows are separate documents. Empty tables give no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumigrid.llm.store import fresh, materialise, materialise_seen, tasks

BLOCK_WORDS, SHARD_SLOTS, CHUNK_DOCS, RANGE_SLOTS, SHARD_GROUP = 64, 1024, 512, 8192, 1024
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
ROUNDS, SEED, DRAW = 6, 20240229, 0
PRIME = 2147483647
WORD = r"[^\x20\x09-\x0D]+"


def _steps(spark: bool, block: int, weights, share: float, cap: int, shard: int, draw: int = DRAW) -> dict[str, str]:
    P = PRIME
    div = (lambda a, b: f"(({a}) div ({b}))") if spark else (lambda a, b: f"(({a}) // ({b}))")
    explode = (lambda a, b: f"explode(sequence({a}, {b}))") if spark else (lambda a, b: f"unnest(generate_series({a}, {b}))")
    size = f"regexp_count(text, '{WORD.replace(chr(92), chr(92) * 2)}')" if spark else f"len(regexp_extract_all(text, '{WORD}'))"
    cases = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))

    def permuted(inner: str) -> str:
        """The column v, 0..n-1, of a query with the columns (src, shard, pass, n, v) through ROUNDS
        swap-or-not rounds keyed by source and pass."""
        keep = "src, shard, pass, n"
        for k in range(ROUNDS):
            inner = f"SELECT {keep}, v, (((CAST({SEED * (k + 3) % P * 31 + 7 * k} AS BIGINT) + (src * 64 + pass + 1) * 40503) % {P} * 48271 % {P} + 12345) * 69621 % {P}) AS r FROM ({inner}) q"
            inner = f"SELECT {keep}, v, r, (r + n - v) % n AS o FROM ({inner}) q"
            inner = f"SELECT {keep}, v, o, (greatest(v, o) % {P} + r) % {P} AS t FROM ({inner}) q"
            inner = f"SELECT {keep}, CASE WHEN {div(f'(t * t % {P} * 16807 % {P} + {div("greatest(v, o)", P)}) * 48271 % {P}', 1024)} % 2 = 1 THEN o ELSE v END AS v FROM ({inner}) q"
        return inner

    def drawn(j: str) -> str:
        """A number below ``shards`` for each slot of a source."""
        x = f"((({j}) % {P} + 1) * 48271 % {P} + src * 40503 + {div(j, P)} * 69621 + {(SEED + draw * 7919) % P}) % {P}"
        return f"((({x}) * 16807 % {P}) * (({x}) * 16807 % {P}) % {P} + ({x})) * 69621 % {P} % shards"

    number = "pmod(ck, {P})" if spark else "((doc_id % {P} + {P}) % {P})"
    return {
        "sized": f"""SELECT doc_id, source, coalesce(CAST({size} AS BIGINT), 0) AS size,
  coalesce({number.replace("{P}", str(P))}, 0) * 48271 % {P} % (SELECT {div("count(*)", CHUNK_DOCS)} + 1 FROM documents) AS chunk FROM documents""",
        "totals": f"""SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source""",
        "weighted": f"""SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) AS src,
  CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {cases} END AS weight FROM totals""",
        "ordered": f"""SELECT *, {share}e0 * sum(source_size) OVER () AS total,
  coalesce(sum({cap} * source_size) OVER (ORDER BY source_size * 1.0e0 / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
  sum(weight) OVER (ORDER BY source_size * 1.0e0 / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left FROM weighted""",
        "levels": f"""SELECT max((total - full_before) / weight_left) AS level FROM ordered WHERE (total - full_before) / weight_left * weight <= {cap}.0e0 * source_size""",
        "targets": f"""SELECT source, source_size, CAST(src AS BIGINT) AS src, round(least({cap}.0e0 * source_size, weight * coalesce((SELECT level FROM levels), 1.0e300)), 6) AS target,
  {div(f"source_size + {block - 1}", block)} AS blocks FROM weighted""",
        "quotas": f"""SELECT *, CASE WHEN target >= {cap} * source_size THEN {cap} * blocks ELSE least(CAST(floor(target / {block} + 5.0e-1) AS BIGINT), {cap} * blocks) END AS slots FROM targets""",
        "plan": f"""SELECT *, {div(f"CAST(sum(slots) OVER () AS BIGINT) - 1", shard)} + 1 AS shards FROM quotas""",
        "ranges": f"""SELECT src, slots, shards, {explode("CAST(0 AS BIGINT)", div("slots - 1", RANGE_SLOTS))} AS part FROM plan WHERE slots > 0""",
        "units": f"""SELECT src, shards, {explode(f"part * {RANGE_SLOTS}", f"least((part + 1) * {RANGE_SLOTS}, slots) - 1")} AS j FROM ranges""",
        "draws": f"""SELECT src, shard, CAST(count(*) AS BIGINT) AS c FROM (SELECT src, {drawn("j")} AS shard FROM units) u GROUP BY src, shard""",
        "groups": f"""SELECT src, {div("shard", SHARD_GROUP)} AS grp, CAST(sum(c) AS BIGINT) AS c FROM draws GROUP BY src, {div("shard", SHARD_GROUP)}""",
        "bases_of": """SELECT src, grp, CAST(sum(c) OVER (PARTITION BY src ORDER BY grp) - c AS BIGINT) AS base FROM groups""",
        "dealt": f"""SELECT d.src, d.shard, d.c, p.blocks, b.base + CAST(sum(d.c) OVER (PARTITION BY d.src, b.grp ORDER BY d.shard) - d.c AS BIGINT) AS lo
  FROM draws d JOIN bases_of b ON d.src = b.src AND {div("d.shard", SHARD_GROUP)} = b.grp JOIN plan p ON d.src = p.src""",
        "numbers": f"""SELECT src, shard, blocks, {explode("lo", "lo + c - 1")} AS j FROM dealt""",
        "slots": f"""SELECT src, shard, pass, v AS block FROM ({permuted(f"SELECT src, shard, {div('j', 'blocks')} AS pass, blocks AS n, j % blocks AS v FROM numbers")}) s""",
        "chunks": """SELECT source, chunk, CAST(sum(size) AS BIGINT) AS words FROM sized GROUP BY source, chunk""",
        "bases": """SELECT c.source, c.chunk, p.src, p.source_size, p.target, CAST(sum(c.words) OVER (PARTITION BY p.src ORDER BY c.chunk) - c.words AS BIGINT) AS base FROM chunks c JOIN plan p ON c.source IS NOT DISTINCT FROM p.source""",
        "placed": """SELECT s.*, CAST(row_number() OVER (PARTITION BY source, chunk, doc_id, size ORDER BY doc_id) AS BIGINT) AS nth, CAST(sum(size) OVER (PARTITION BY source, chunk ORDER BY doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS inner_off,
  row_number() OVER (PARTITION BY source, chunk ORDER BY doc_id NULLS FIRST, size) AS rn FROM sized s""",
        "spread": """SELECT p.*, b.src, b.source_size, b.target, b.base + p.inner_off AS off FROM placed p JOIN bases b ON p.source IS NOT DISTINCT FROM b.source AND p.chunk = b.chunk""",
        "pieces": f"""SELECT *, {explode(div("off", block), div("off + greatest(size, 1) - 1", block))} AS block FROM spread""",
        "reads": """SELECT src, block, CAST(count(*) AS BIGINT) AS times, CAST(min(shard) AS BIGINT) AS first FROM slots GROUP BY src, block""",
        "mixed": f"""SELECT {"/*+ MERGE(p, r) */ " if spark else ""}p.doc_id, p.size, p.source_size, p.target,
  CAST(sum(CASE WHEN p.size = 0 THEN 0 ELSE (least(p.off + p.size, (p.block + 1) * {block}) - greatest(p.off, p.block * {block})) * coalesce(r.times, 0) END) AS BIGINT) AS taken,
  CAST(min(CASE WHEN p.size > 0 THEN r.first END) AS BIGINT) AS first_shard
  FROM pieces p LEFT JOIN reads r ON p.src = r.src AND p.block = r.block GROUP BY p.src, p.chunk, p.rn, p.doc_id, p.size, p.source_size, p.target""",
    }


def _sql(steps: dict[str, str], final: str, select: str = "*") -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in steps.items()) + f"\nSELECT {select} FROM {final}"


ORACLE_SQL = _sql(_steps(False, BLOCK_WORDS, WEIGHTS, SHARE, CAP, SHARD_SLOTS), "mixed")

_PLAN = ("totals", "weighted", "ordered", "levels", "targets", "quotas", "plan")


def _run(spark, steps: dict[str, str], parts, final: str, frames: dict[str, DataFrame], select: str = "*") -> DataFrame:
    sql = _sql({k: steps[k] for k in parts}, final, select) if parts else f"SELECT {select} FROM {final}"
    used = {k: v for k, v in frames.items() if k not in parts and re.search(rf"(FROM|JOIN) {k}\b", sql)}
    for k in used:
        sql = re.sub(rf"(FROM|JOIN) {k}\b", rf"\1 {{{k}}}", sql)
    return spark.sql(sql, **used)


def _chunk_key(docs: DataFrame) -> Column:
    """What puts a document into its chunk: a whole number as it is, else a hash; the text's for null
    ids."""
    if docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("text"))
    return F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))


def _frames(docs: DataFrame, block: int, weights, share: float, cap: int, shard: int, draw: int = DRAW) -> tuple[dict[str, str], dict[str, DataFrame], int]:
    """The steps and the frames they read, from documents (doc_id, text, source), and how many these are."""
    spark = docs.sparkSession
    steps, frames = _steps(True, block, weights, share, cap, shard, draw), {"documents": docs.withColumn("ck", _chunk_key(docs))}
    frames["sized"], seen = materialise_seen(_run(spark, steps, ("sized",), "sized", frames), "mix-sizes", rows=F.count(F.lit(1)))
    frames["plan"] = materialise(_run(spark, steps, _PLAN, "plan", frames), "mix-plan")
    # a few short rows that become many: a fixed number of partitions, which isn't coalesced
    frames["ranges"] = _run(spark, steps, ("ranges",), "ranges", frames).repartition(tasks(spark), "src", "part")
    frames["draws"] = materialise(_run(spark, steps, ("units", "draws"), "draws", frames), "mix-draws")
    frames["dealt"] = _run(spark, steps, ("groups", "bases_of", "dealt"), "dealt", frames).repartition(tasks(spark), "src", "shard")
    return steps, frames, seen["rows"]


def mix(docs: DataFrame, block: int = BLOCK_WORDS, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, shard: int = SHARD_SLOTS, draw: int = DRAW) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken, first_shard): how many words of each document
    the mix reads, repeats counted, and the first output shard that reads any (null: none). One per
    row of ``docs`` (doc_id, text, source). ``draw`` names the draw: another one deals the slots to
    other shards, within the same targets."""
    steps, frames, _ = _frames(docs.select("doc_id", "text", "source"), block, weights, share, cap, shard, draw)
    # written first: filters of the join below would be pushed through every round of the permutation
    frames["reads"] = materialise(_run(docs.sparkSession, steps, ("numbers", "slots", "reads"), "reads", frames), "mix-reads")
    return _run(docs.sparkSession, steps, ("chunks", "bases", "placed", "spread", "pieces", "mixed"), "mixed", frames)


def slot_table(docs: DataFrame, block: int = BLOCK_WORDS, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, shard: int = SHARD_SLOTS, draw: int = DRAW) -> DataFrame:
    """The mix itself: rows (shard, slot, src, pass, block) for every output slot, in a pseudorandom
    order inside each shard."""
    steps, frames, _ = _frames(docs.select("doc_id", "text", "source"), block, weights, share, cap, shard, draw)
    slots = materialise(_run(docs.sparkSession, steps, ("numbers", "slots"), "slots", frames), "mix-slots")
    return slots.selectExpr("shard", "row_number() OVER (PARTITION BY shard ORDER BY xxhash64(src, pass, block), src, pass, block) - 1 AS slot", "src", "pass", "block")


def mix_documents(docs: DataFrame, block: int = BLOCK_WORDS, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, shard: int = SHARD_SLOTS, draw: int = DRAW) -> DataFrame:
    """The mixed documents, in the columns of ``docs``: a row per document and pass with the words
    that the pass reads. A document read whole keeps its text as it is; of others the words read
    are joined by spaces in their order. n_chars, where there is one, is counted anew. Rows are
    partitioned and sorted by the first output shard that reads them, so that what is written is in
    the order of the draw. Rows that repeat an id and a size in a chunk are told apart by their
    texts' order."""
    spark, columns = docs.sparkSession, docs.columns
    steps, frames, rows = _frames(docs.select("doc_id", "text", "source"), block, weights, share, cap, shard, draw)
    # a document's own columns travel in one, so that none can clash with those of the mix
    keyed = docs.select("doc_id", "source", _chunk_key(docs).alias("ck"), F.struct(*columns).alias("held"))
    placed = _run(spark, steps, ("chunks", "bases", "placed", "spread", "pieces"), "pieces", frames, "src, chunk, nth, doc_id, size, off, block").where("size > 0")
    slots = materialise(_run(spark, steps, ("numbers", "slots"), "slots", frames, "src AS s2, block AS b2, pass, shard"), "mix-slots")
    taken = placed.join(slots.hint("merge"), (F.col("src") == F.col("s2")) & (F.col("block") == F.col("b2")))
    spans = taken.select("src", "doc_id", "chunk", "nth", "size", "pass", "shard", F.greatest(F.lit(0), F.col("block") * block - F.col("off")).alias("a"), F.least(F.col("size"), (F.col("block") + 1) * block - F.col("off")).alias("b"))
    grouped = spans.groupBy("src", "chunk", "nth", "doc_id", "size", "pass").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"), F.sum(F.col("b") - F.col("a")).alias("got"), F.min("shard").alias("first"))
    grouped = grouped.withColumnsRenamed({"doc_id": "id", "src": "of", "size": "long", "chunk": "part", "nth": "k"})
    pattern = WORD.replace(chr(92), chr(92) * 2)
    size = F.coalesce(F.expr(f"regexp_count(held.text, '{pattern}')").cast("long"), F.lit(0).cast("long"))
    sources = frames["plan"].select(F.col("source").alias("name"), "src")
    chunks = rows // CHUNK_DOCS + 1
    base = keyed.withColumn("size", size).withColumn("chunk", F.expr(f"coalesce(pmod(ck, {PRIME}), 0) * 48271 % {PRIME} % {chunks}L")).join(sources, F.col("source").eqNullSafe(F.col("name")), "inner")
    same = frames["sized"].groupBy("doc_id", "source", "size", "chunk").agg(F.count("*").alias("n")).where("n > 1").limit(1)
    if same.count():  # repeated rows: number them, so that each meets its own part
        base = base.withColumn("nth", F.expr("row_number() over (partition by doc_id, src, size, chunk order by xxhash64(held.text), held.text)").cast("long"))
    else:
        base = base.withColumn("nth", F.lit(1).cast("long"))
    alike = [F.col(a) == F.col(b) for a, b in (("src", "of"), ("size", "long"), ("chunk", "part"), ("nth", "k"))]
    one = base.join(grouped, [F.col("doc_id").eqNullSafe(F.col("id")), *alike])
    # texts move in the draw's order as they are, and are cut after that
    (first,) = fresh(docs, "first")
    met = one.select("held", "spans", (F.col("got") == F.col("size")).alias("all"), F.col("first").alias(first)).repartitionByRange(tasks(spark), first).sortWithinPartitions(first)
    words = f"regexp_extract_all(held.text, '{pattern}', 0)"
    text = F.when(F.col("all"), F.col("held.text")).otherwise(F.expr(f"array_join(flatten(transform(spans, s -> slice({words}, cast(s.a + 1 as int), cast(s.b - s.a as int)))), ' ')"))
    out = met.select(text.alias("text"), "held")
    new = {"text": F.col("text")} | ({"n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in columns else {})
    return out.select(*(new.get(c, F.col("held").getField(c)).alias(c) for c in columns))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """How much of every document the mix takes."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
