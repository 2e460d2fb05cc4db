"""URL filter: host and path rules first, then a character language-model ratio.

Two smoothed variable-order Markov models, of accepted and of rejected URLs, are learned from the
URLs that the rules decide. A context of two characters is used where its class has seen it often
enough, else one of one character, else none (Witten-Bell interpolation down the chain). A URL's
score is the difference of its two log-likelihoods per character; the cut is the one with the
highest true-accept minus false-accept rate on the labelled URLs kept back from learning.

Everything is Spark SQL. URLs are folded to 48 characters, so the model table has at most 48**3
rows whatever the input, which bounds what is broadcast. Scores are sums of whole micro-nats, so
they don't depend on the order of summation.

Null URLs and URLs without ``://`` have an empty host and path, no rule, and are judged by the
models like any other. Repeated rows stay repeated. Without labelled URLs of a class every URL
scores by the other class's counts against a uniform model and the cut falls on the lowest score.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigrid.llm.store import materialise, spread_join

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
MIN_CONTEXT = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rule_case(rules, value) -> str:
    whens = []
    for rule in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        _, host, path = rule
        tail = "." + host
        whens.append(f"WHEN (host = '{host}' OR right(host, {len(tail)}) = '{tail}') AND left(path, {len(path)}) = '{path}' THEN '{value(rule)}'")
    return f"CASE {' '.join(whens)} END"


def _model_steps(side: str) -> dict[str, str]:
    """Probability chain of one class, whose counts are in column ``side`` of g3."""
    seen = f"sum({side}) AS n, sum(CASE WHEN {side} > 0 THEN 1 ELSE 0 END) AS t"
    mixed = f"CASE WHEN c.n >= {MIN_CONTEXT} THEN (g.{side} + c.t * q.p) / (c.n + c.t) ELSE q.p END"
    return {
        f"{side}c2": f"SELECT left(gram, 2) AS ctx, {seen} FROM g3 GROUP BY left(gram, 2)",
        f"{side}c1": f"SELECT left(gram, 1) AS ctx, {seen} FROM g2 GROUP BY left(gram, 1)",
        f"{side}p1": f"SELECT gram, ({side} + 1.0e0) / (SELECT sum({side}) + count(*) FROM g1) AS p FROM g1",
        f"{side}p2": f"SELECT g.gram, {mixed} AS p FROM g2 g JOIN {side}c1 c ON c.ctx = left(g.gram, 1) JOIN {side}p1 q ON q.gram = right(g.gram, 1)",
        f"{side}p3": f"SELECT g.gram, {mixed} AS p FROM g3 g JOIN {side}c2 c ON c.ctx = left(g.gram, 2) JOIN {side}p2 q ON q.gram = right(g.gram, 2)",
    }


def _steps(rules=RULES, spark: bool = True) -> dict[str, str]:
    """The query's steps in order, in Spark SQL or, for checking, in DuckDB's SQL."""
    flag = "" if spark else ", 'g'"
    series = "explode(sequence(3, length(s)))" if spark else "unnest(generate_series(3, length(s)))"
    hint = "/*+ BROADCAST(m) */ " if spark else ""
    return {
        "base": """
  SELECT page_id, coalesce(url, '') AS url,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{U}', '{L}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages""".replace("{U}", UPPER).replace("{L}", LOWER),
        "ruled": f"""
  SELECT page_id, host, path, {_rule_case(rules, lambda r: r[1] + r[2])} AS rule, {_rule_case(rules, lambda r: r[0])} AS decided,
    concat('^^', regexp_replace(translate(url, '{UPPER}', '{LOWER}'), '[^a-z0-9/.:?&=#_%-]', '*'{flag}), '$') AS s
  FROM base""",
        "strings": """
  SELECT s, sum(CASE WHEN decided = 'allow' THEN 1 ELSE 0 END) AS na, sum(CASE WHEN decided = 'block' THEN 1 ELSE 0 END) AS nr,
    CASE WHEN left(md5(s), 1) IN ('0', '1', '2', '3') THEN 1 ELSE 0 END AS held
  FROM ruled GROUP BY s""",
        "spots": f"SELECT s, na, nr, held, {series} AS i FROM strings",
        "g3": "SELECT substr(s, i - 2, 3) AS gram, sum(na * (1 - held)) AS a, sum(nr * (1 - held)) AS r FROM spots GROUP BY substr(s, i - 2, 3)",
        "g2": "SELECT right(gram, 2) AS gram, sum(a) AS a, sum(r) AS r FROM g3 GROUP BY right(gram, 2)",
        "g1": "SELECT right(gram, 1) AS gram, sum(a) AS a, sum(r) AS r FROM g3 GROUP BY right(gram, 1)",
        **_model_steps("a"),
        **_model_steps("r"),
        "model": "SELECT x.gram, CAST(round((ln(x.p) - ln(y.p)) * 1.0e6) AS BIGINT) AS micro FROM ap3 x JOIN rp3 y ON x.gram = y.gram",
        "scored": f"""
  SELECT {hint}s, CAST(floor(sum(m.micro) / (count(*) * 1.0e3)) AS BIGINT) AS score, max(na) AS na, max(nr) AS nr, max(held) AS held
  FROM spots JOIN model m ON m.gram = substr(s, i - 2, 3) GROUP BY s""",
        "hist": "SELECT score, CAST(sum(na) AS BIGINT) AS ca, CAST(sum(nr) AS BIGINT) AS cr FROM scored WHERE held = 1 GROUP BY score",
        "gain": """
  SELECT score, CAST(sum(ca) OVER (ORDER BY score DESC) AS DOUBLE) * (SELECT sum(cr) FROM hist) - CAST(sum(cr) OVER (ORDER BY score DESC) AS DOUBLE) * (SELECT sum(ca) FROM hist) AS j
  FROM hist""",
        "best": "SELECT coalesce(min(score), 0) AS cut FROM gain WHERE j = (SELECT max(j) FROM gain)",
        "verdicts": """
  SELECT b.page_id, b.host, b.path, b.rule, coalesce(b.decided, CASE WHEN c.score >= (SELECT cut FROM best) THEN 'allow' ELSE 'block' END) AS verdict
  FROM ruled b JOIN scored c ON b.s = c.s""",
    }


def _sql(steps: dict[str, str], final: str) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in steps.items()) + f"\nSELECT * FROM {final}"


ORACLE_SQL = _sql(_steps(spark=False), "verdicts")

#: What is written once because several steps read it, with the steps that make it.
_STAGES = {
    "ruled": ("base", "ruled"),
    "strings": ("strings",),
    "g3": ("spots", "g3"),
    "model": ("g2", "g1", *_model_steps("a"), *_model_steps("r"), "model"),
    "scored": ("spots", "scored"),
    "best": ("hist", "gain", "best"),
}


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict), one per row of ``pages`` (page_id, url)."""
    steps, frames = _steps(rules), {"pages": pages.select("page_id", "url")}
    for name, parts in _STAGES.items():
        sql = _sql({k: steps[k] for k in parts}, name)
        used = {k: v for k, v in frames.items() if k not in parts and re.search(rf"(FROM|JOIN) {k}\b", sql)}
        for k in used:
            sql = re.sub(rf"(FROM|JOIN) {k}\b", rf"\1 {{{k}}}", sql)
        frames[name] = materialise(pages.sparkSession.sql(sql, **used), f"urls-{name}")
    cut = frames["best"].first()["cut"]
    judged = frames["scored"].select("s", F.when(F.col("score") >= cut, "allow").otherwise("block").alias("judged"))
    # one URL, or none at all, may be that of a third of all pages
    met = spread_join(frames["ruled"], judged, "s", "inner")
    return met.select("page_id", "host", "path", "rule", F.coalesce("decided", "judged").alias("verdict"))


def op10_url_filters(spark, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
