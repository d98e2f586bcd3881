"""Model sinks: a Parquet model table, and the nested form of parallel arrays as a DataFrame, dict or JSON."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def preorder(table: DataFrame) -> DataFrame:
    """Adds at, the preorder position in each tree, and the positions of both children.

    Preorder is the order of root-to-node paths; with heap ids a path is the binary digits of id + 1 after the first.
    """
    path = F.substring(F.bin(F.col("node_id") + 1), 2, 64)
    key = ["model_id", "round", "output", "tree_id"]
    w = Window.partitionBy(*key).orderBy("path")  # one tree's nodes
    t = table.withColumn("path", path).withColumn("at", (F.row_number().over(w) - 1).cast("long"))
    ids = t.select(*key, F.col("node_id").alias("child"), F.col("at").alias("child_at"))
    for side in ("left", "right"):
        own = ids.withColumnsRenamed({"child": f"{side}_id", "child_at": f"{side}_at"})
        t = t.join(own, [*key, f"{side}_id"], "left")
    return t


def nested_trees(table: DataFrame) -> DataFrame:
    """(model_id, rounds): rounds -> outputs -> trees of five parallel arrays; leaves have feature -1, threshold NaN, children -1."""
    t = preorder(table)
    node = F.struct("at", F.coalesce("left_at", F.lit(-1)).alias("l"), F.coalesce("right_at", F.lit(-1)).alias("r"), F.col("feature").cast("long").alias("f"), F.coalesce("threshold", F.lit(math.nan)).alias("t"), F.col("value").alias("v"))
    trees = t.groupBy("model_id", "round", "output", "tree_id").agg(F.array_sort(F.collect_list(node)).alias("n"))
    tree = F.struct(*[F.transform("n", lambda x: x[k]).alias(name) for k, name in (("l", "children_left"), ("r", "children_right"), ("f", "feature"), ("t", "threshold"), ("v", "value"))])  # noqa: B023
    outputs = trees.groupBy("model_id", "round", "output").agg(F.sort_array(F.collect_list(F.struct("tree_id", tree.alias("tree")))).alias("x")).select("model_id", "round", "output", F.struct(F.transform("x", lambda x: x["tree"]).alias("trees")).alias("o"))
    rounds = outputs.groupBy("model_id", "round").agg(F.sort_array(F.collect_list(F.struct("output", "o"))).alias("x")).select("model_id", "round", F.struct(F.transform("x", lambda x: x["o"]).alias("outputs")).alias("r"))
    return rounds.groupBy("model_id").agg(F.sort_array(F.collect_list(F.struct("round", "r"))).alias("x")).select("model_id", F.transform("x", lambda x: x["r"]).alias("rounds"))


def to_dict(model, spark) -> dict:
    """A boosted model as a nested dict."""
    if not model.rounds:
        raise ValueError("the model has not been fitted")
    if not model.table(spark).filter("node_id < 0").isEmpty():
        raise ValueError("the nested form is for trees of at most 61 levels: set max_depth or min_samples_leaf")
    rounds = nested_trees(model.table(spark)).first()["rounds"]
    out = {"task": model.task, "n_outputs": model.n_outputs, "learning_rate": model.learning_rate, "init": list(model.init), "n_estimators": len(model.rounds), "rounds": [{"outputs": [{"trees": [t.asDict(True) for t in o["trees"]]} for o in r["outputs"]]} for r in rounds]}
    return out | ({"conformal_quantile": model.conformal_quantile} if model.task == "regression" else {"n_classes": model.n_classes})


def to_json(model, spark) -> str:
    return json.dumps(to_dict(model, spark))


def write_model(model, spark, path: str) -> None:
    model.table(spark).write.parquet(path)


def predict_from_dict(d: dict, rows: list[list[float]]) -> list[list[float]]:
    """Raw scores of an exported model, in plain Python: what another system would do with it."""
    out = []
    for x in rows:
        scores = list(d["init"])
        for r in d["rounds"]:
            for o, output in enumerate(r["outputs"]):
                total = 0.0
                for t in output["trees"]:
                    i = 0
                    while t["children_left"][i] >= 0:
                        i = t["children_left"][i] if x[t["feature"][i]] <= t["threshold"][i] else t["children_right"][i]
                    total += t["value"][i]
                scores[o] += d["learning_rate"] * total / len(output["trees"])
        out.append(scores)
    return out
