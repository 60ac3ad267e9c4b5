"""Early stopping inside one forest: validation log-loss of every prefix of its trees in one pass.

A forest is grown once, to its full size. Its votes add up tree by tree: the
probability after k trees is the mean of the first k trees' votes, so the true
class's votes of a row, added up in order, tell its loss under every prefix. The
model names the leaf of each tree in one transform; the leaves' votes come from
the saved model, at most trees x leaves x classes numbers, and are joined as one
row. Losses are summed for each prefix before anything is shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeframe.session import checkpoint_dir, settle

#: Probabilities below this count as this, so that a loss is finite.
LEAST = 1e-15


def leaf_votes(model: RandomForestClassificationModel) -> DataFrame:
    """One row: `votes[tree][leaf][class]`, leaves in the model's own numbering."""
    spark = SparkSession.active()
    path = f"{checkpoint_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"
    model.save(path)
    nodes = spark.read.parquet(f"{path}/data").filter("nodeData.leftChild < 0").selectExpr(
        "treeID", "nodeData.id AS id", "nodeData.impurityStats AS stats")
    share = F.expr("transform(stats, s -> s / aggregate(stats, 0D, (a, x) -> a + x))")
    trees = nodes.select("treeID", F.struct("id", share.alias("vote")).alias("leaf")).groupBy("treeID").agg(
        F.expr("transform(array_sort(collect_list(leaf)), l -> l.vote)").alias("leaves"))
    return settle(trees.agg(F.expr("transform(array_sort(collect_list(struct(treeID, leaves))), t -> t.leaves)").alias("votes")))


def loss_curve(model: RandomForestClassificationModel, valid: DataFrame, label: str = "label") -> list[float]:
    """Mean log-loss on the validation rows after 1, 2, ... all trees; empty without rows.

    A class the model doesn't know has probability 0.
    """
    named = model.copy()
    named.setLeafCol("_leaf")
    rows = named.transform(valid.select("features", label)).select(vector_to_array("_leaf").alias("_leaf"), F.col(label).cast("int").alias("_y"))
    # One row of votes, on a key so that it is an ordinary lookup.
    votes = leaf_votes(model).withColumn("_one", F.lit(1))
    rows = rows.withColumn("_one", F.lit(1)).join(F.broadcast(votes), "_one")
    own = "zip_with(votes, _leaf, (t, l) -> coalesce(get(t[int(l)], _y), 0D))"
    start = "struct(0D AS s, CAST(array() AS array<double>) AS p)"
    upto = f"aggregate({own}, {start}, (a, v) -> struct(a.s + v AS s, concat(a.p, array(a.s + v)) AS p)).p"
    losses = F.posexplode(F.expr(f"transform({upto}, (s, i) -> -ln(greatest(s / (i + 1), {LEAST!r}D)))")).alias("k", "loss")
    return [r["loss"] for r in rows.select(losses).groupBy("k").agg(F.avg("loss").alias("loss")).orderBy("k").collect()]


def best_prefix(curve: Sequence[float], patience: int, least_gain: float = 0.0) -> tuple[int, int]:
    """Trees of the best prefix, and trees looked at: `patience` trees without a gain end the search."""
    best, place = float("inf"), 0
    for k, loss in enumerate(curve, 1):
        if loss < best - least_gain:
            best, place = loss, k
        elif k - place >= patience:
            return max(place, 1), k
    return max(place, 1), len(curve)


def prefix_of(model: RandomForestClassificationModel, trees: int) -> RandomForestClassificationModel:
    """The model of the first trees only, which scores, saves and loads as any other."""
    java, sc = model._java_obj, SparkSession.active().sparkContext
    kept = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.classification.DecisionTreeClassificationModel, trees)
    for k, tree in zip(range(trees), java.trees()):
        kept[k] = tree
    short = sc._jvm.org.apache.spark.ml.classification.RandomForestClassificationModel(model.uid, kept, model.numFeatures, model.numClasses)
    for param in java.params():
        if java.isSet(param):
            short.set(short.getParam(param.name()), java.get(param).get())
    short.set(short.getParam("numTrees"), trees)
    out = RandomForestClassificationModel(short)
    out._resetUid(short.uid())
    out._transfer_params_from_java()
    return out


def refit_size(prefixes: Sequence[int]) -> int:
    """Trees for a model of all rows, which are more than a fold's: 1.1 times the folds' mean."""
    return int(sum(prefixes) / len(prefixes) * 1.1)
