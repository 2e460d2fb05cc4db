"""Forest scoring: forests as tables of nodes, compiled to a column expression, or Spark ML models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_SCHEMA = "tree int, node int, feature string, threshold double, left int, right int, p double"


def forest_column(nodes: Sequence[dict]) -> Column:
    """Mean leaf probability over the trees as nested CASE expressions, which run inside generated
    code. A node goes left where its feature is at most the threshold; a leaf has no feature. For
    shallow forests; a Spark ML model scales to deep ones."""
    by_tree: dict[int, dict[int, dict]] = {}
    for n in nodes:
        by_tree.setdefault(n["tree"], {})[n["node"]] = n

    def walk(tree: dict[int, dict], at: int) -> Column:
        n = tree[at]
        if n["feature"] is None:
            return F.lit(float(n["p"]))
        return F.when(F.col(f"`{n['feature']}`") <= F.lit(float(n["threshold"])), walk(tree, n["left"])).otherwise(walk(tree, n["right"]))

    total = None
    for tree in by_tree.values():
        one = walk(tree, 0)
        total = one if total is None else total + one
    if total is None:
        raise ValueError("a forest needs a tree")
    return total / float(len(by_tree))


def load_forest_table(spark: SparkSession, path: str) -> list[dict]:
    """Nodes of a saved forest: a model, not data, so it belongs on the driver."""
    return [r.asDict() for r in spark.read.schema(NODE_SCHEMA).json(path).collect()]


def save_forest_table(spark: SparkSession, nodes: Sequence[dict], path: str) -> None:
    spark.createDataFrame([tuple(n.get(k) for k in ("tree", "node", "feature", "threshold", "left", "right", "p")) for n in nodes], NODE_SCHEMA).coalesce(1).write.mode("overwrite").json(path)


def train_forest(train: DataFrame, features: Sequence[str], label: str = "y", trees: int = 200, depth: int = 10, seed: int = 1, weight: str | None = None):
    """A Spark ML random forest pipeline over finite features (others count as 0). Classes are
    balanced by weights unless a weight column is given."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    df = train.withColumn("__y", F.col(label).cast("double"))
    if weight is None:
        n, pos = df.agg(F.count("*"), F.sum("__y")).first()
        share = min(max((pos or 0) / max(n, 1), 1e-9), 1 - 1e-9)
        df = df.withColumn("__w", F.when(F.col("__y") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    else:
        df = df.withColumn("__w", F.col(weight).cast("double"))
    stages = [VectorAssembler(inputCols=list(features), outputCol="__features", handleInvalid="keep"), RandomForestClassifier(labelCol="__y", featuresCol="__features", weightCol="__w", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt")]
    return Pipeline(stages=stages).fit(clean(df, features))


def clean(df: DataFrame, features: Sequence[str]) -> DataFrame:
    from lumigrid.functions.pixel import finite_or_zero

    return df.withColumns({f: finite_or_zero(F.col(f"`{f}`").cast("double")) for f in features})


def score(df: DataFrame, model, features: Sequence[str], out: str = "p") -> DataFrame:
    """Adds the probability of the positive class. ``model`` is a list of forest nodes, a fitted
    Spark ML model, or a column."""
    if isinstance(model, Column):
        return df.withColumn(out, model)
    if isinstance(model, (list, tuple)):
        tidy = {f"__{f}": v for f, v in ((f, F.when(F.col(f"`{f}`").isNull() | F.isnan(F.col(f"`{f}`").cast("double")) | (F.abs(F.col(f"`{f}`")) == float("inf")), F.lit(0.0)).otherwise(F.col(f"`{f}`"))) for f in features)}
        nodes = [n | {"feature": None if n["feature"] is None else f"__{n['feature']}"} for n in model]
        return df.withColumns(tidy).withColumn(out, forest_column(nodes)).drop(*tidy)
    from pyspark.ml.functions import vector_to_array

    # raw features are kept aside: only the model sees non-finite values as 0
    keep = {f"__raw_{f}": F.col(f"`{f}`") for f in features}
    scored = model.transform(clean(df.withColumns(keep), features))
    scored = scored.withColumn(out, F.element_at(vector_to_array("probability"), 2))
    return scored.withColumns({f: F.col(f"__raw_{f}") for f in features}).select(*df.columns, out)
