"""How filters of documents overlap, for every order in which they may be applied.

Every document gets a mask of the filters that it fails; documents are counted by (part, mask,
quality, toxicity), the mask cells. Each cell is unpivoted against the steps of all orders of the
filters into long rows (cell, order, step); a running bit-or over the window of (cell, order) by
step holds what has failed earlier, conditional sums over it count what a step keeps, removes or
finds removed already, and totals over windows of (part, filter) give each filter's share over all
orders. A cell is one row however many documents it stands for, so long rows grow with parts only.

A duplicate is a document whose text equals that of a smaller id anywhere in the table. Texts meet
by SHA-256, and a group of copies never comes together: rows are counted by (digest, mask, part,
labels, id), then by all but the id with the least id and its count, and those few rows of a digest
give how many of its documents are larger than its least id.

Null texts are empty and equal to empty ones; a null part is the empty string; labels of one id
count together (one mark of 1 is enough), null marks and ids without labels count as none. A null id
is no smaller than any and has no smaller one, so it is no duplicate. Repeated rows count each; rows
of the same id and text are no duplicates of each other. Empty tables give no rows. Columns other
than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumigrid.llm.store import materialise, spread_join

SPACE = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DUPLICATE = "E"


def few_words(text: Column, words: Column) -> Column:
    return F.size(words) < 100


def few_distinct_words(text: Column, words: Column) -> Column:
    return 100 * F.size(F.array_distinct(words)).cast("long") < 80 * F.size(words).cast("long")


def many_capitals(text: Column, words: Column) -> Column:
    capitals = F.char_length(text) - F.char_length(F.translate(text, CAPITALS, ""))
    return 100 * capitals.cast("long") > 10 * F.char_length(text).cast("long")


def odd_symbols(text: Column, words: Column) -> Column:
    return text.rlike(r"[#$%&*|]")


#: Conditions on a text and its words under which a filter removes it, by letter.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {"A": few_words, "B": few_distinct_words, "C": many_capitals, "D": odd_symbols}


def masks(docs: DataFrame, part: str = "lang", text: str = "text", id_col: str = "doc_id", filters=None) -> DataFrame:
    """Rows (id, part, digest, mask), one per row of ``docs``: bit k of mask is set where the k-th of
    ``filters`` removes the text."""
    rules = FILTERS if filters is None else filters
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(text, F.lit("")).alias("text"))
    split = plain.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    mask = F.lit(0)
    for k, rule in enumerate(rules.values()):
        mask = mask + F.when(rule(F.col("text"), F.col("words")), 1 << k).otherwise(0)
    return split.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def mask_cells(docs: DataFrame, labels: DataFrame, part: str = "lang", text: str = "text", id_col: str = "doc_id", filters=None) -> DataFrame:
    """Rows (part, mask, good, toxic, n): documents by part, failed filters and labels. The bit after
    those of ``filters`` marks duplicates."""
    rules = FILTERS if filters is None else filters
    rows = materialise(masks(docs, part, text, id_col, rules), "audit-masks")
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast(rows.schema["id"].dataType).alias("id")).agg(*(F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias(o) for c, o in (("quality", "good"), ("toxic", "toxic"))))
    # null ids would meet in one task of a join, and they have no labels
    known = spread_join(rows.where("id is not null"), marks, "id").select("id", "part", "digest", "mask", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    labelled = known.unionByName(rows.where("id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)}))
    keys = ["digest", "part", "mask", "good", "toxic"]
    by_id = labelled.groupBy(*keys, "id").agg(F.count("*").alias("n"))
    cells = by_id.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("id").alias("low"), F.min_by(F.when(F.col("id").isNotNull(), F.col("n")), "id").alias("at_low"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"))
    least = F.min("low").over(Window.partitionBy("digest"))
    first = F.when(F.col("low") == F.col("least"), F.col("at_low")).otherwise(0)
    split = cells.withColumn("least", least).withColumn("copies", F.when(F.col("low").isNull(), 0).otherwise(F.col("n") - F.col("unnamed") - first))
    both = F.array(F.struct(F.col("mask"), (F.col("n") - F.col("copies")).alias("n")), F.struct((F.col("mask") + F.lit(1 << len(rules))).alias("mask"), F.col("copies").alias("n")))
    return split.select("part", "good", "toxic", F.explode(both).alias("c")).where("c.n > 0").groupBy("part", F.col("c.mask").alias("mask"), "good", "toxic").agg(F.sum("c.n").alias("n"))


def long_form(cells: DataFrame, letters: str) -> DataFrame:
    """Mask cells against the steps of every order: rows (cell columns, filter_order, step, letter,
    fails, earlier), fails the step's bit where the cell fails it, earlier the bits that failed in
    steps before."""
    orders = ["".join(p) for p in permutations(letters)]
    rows = cells.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders))))
    rows = rows.select("*", F.posexplode(F.split("filter_order", "")).alias("step", "letter")).withColumn("step", F.col("step") + 1)
    bit = F.shiftrightunsigned("mask", 0).bitwiseAND(F.element_at(F.create_map(*(F.lit(x) for k, c in enumerate(letters) for x in (c, 1 << k))), F.col("letter")))
    before = Window.partitionBy("part", "mask", "good", "toxic", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("fails", bit).withColumn("earlier", F.coalesce(F.bit_or("fails").over(before), F.lit(0)))


def interaction_metrics(cells: DataFrame, letters: str) -> DataFrame:
    """Rows (part, filter_order, step, letter, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley) from mask cells: document counts of every step of every order."""
    fails, clear = F.col("fails") != 0, F.col("earlier") == 0
    count = lambda when, name: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long").alias(name)
    steps = long_form(cells, letters).groupBy("part", "filter_order", "step", "letter").agg(
        count(clear & ~fails, "kept"), count(clear & fails, "removed"), count(fails & ~clear, "redundant"), count(fails & (F.col("mask") == F.col("fails")), "unique_fails"),
        count(clear & fails & F.col("good"), "good_lost"), count(clear & fails & F.col("toxic"), "toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter")))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", text: str = "text", id_col: str = "doc_id", filters=None) -> DataFrame:
    """``interaction_metrics`` of ``filters`` (letter to a condition on a text and its words) and of
    the filter of duplicates, whose letter is ``DUPLICATE``."""
    letters = "".join(FILTERS if filters is None else filters) + DUPLICATE
    return interaction_metrics(materialise(mask_cells(docs, labels, part, text, id_col, filters), "audit-cells"), letters)


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Metrics of five filters at every step of all their orders, by language."""
    found = audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.drop("letter")


ORACLE_SQL = r"""WITH doc AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
lb AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
wd AS (SELECT doc_id, t, part, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS low FROM doc),
fl AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(w) < 100 AS "A", 100 * len(list_distinct(w)) < 80 * len(w) AS "B", 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * len(t) AS "C",
  regexp_matches(t, '[#$%&*|]') AS "D", coalesce(wd.doc_id > low, false) AS "E" FROM wd LEFT JOIN lb ON wd.doc_id = lb.doc_id),
ce AS (SELECT part, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN "A" WHEN 'B' THEN "B" WHEN 'C' THEN "C" WHEN 'D' THEN "D" ELSE "E" END) AS fails, count(*) AS n FROM fl GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
od AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
st AS (SELECT filter_order, CAST(k AS INT) AS step, filter_order[k] AS letter, filter_order[:k - 1] AS earlier FROM od, generate_series(1, 5) g(k)),
lo AS (SELECT part, filter_order, step, letter, good, toxic, n, len(fails) AS f, list_contains(fails, letter) AS hit, len(list_filter(fails, lambda x: contains(earlier, x))) = 0 AS clear FROM ce, st),
me AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (clear AND NOT hit), 0) AS kept, coalesce(sum(n) FILTER (clear AND hit), 0) AS removed, coalesce(sum(n) FILTER (hit AND NOT clear), 0) AS redundant,
  coalesce(sum(n) FILTER (hit AND f = 1), 0) AS unique_fails, coalesce(sum(n) FILTER (clear AND hit AND good = 1), 0) AS good_lost, coalesce(sum(n) FILTER (clear AND hit AND toxic = 1), 0) AS toxic_lost FROM lo GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM me"""
