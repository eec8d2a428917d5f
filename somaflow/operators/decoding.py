"""Decoding a head direction from traces: angle classes, a forest of trees, folds by hash."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from somaflow.folders import new_folder


def angle_class(angle: Column, classes: int = 60) -> Column:
    """Class 0 .. classes - 1 of an angle in [0, 2 pi)."""
    return F.least(F.floor(angle / F.lit(2 * math.pi / classes)), F.lit(classes - 1)).cast("double")


def decoded(rows: DataFrame, classes: int = 60, folds: int = 4, trees: int = 40, depth: int = 8, seed: int = 0) -> DataFrame:
    """(t, angle, decoded): each frame's angle as told by a model trained on the other folds.

    ``rows`` is (t, angle, features ARRAY<DOUBLE>).  What the folds share is
    written once to the shared folder.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    spark, folder = rows.sparkSession, new_folder(rows.sparkSession, "decoding")
    data = rows.select("t", "angle", array_to_vector("features").alias("features"), angle_class(F.col("angle"), classes).alias("label"), F.pmod(F.xxhash64("t", F.lit(seed)), F.lit(folds)).alias("fold"))
    data.write.parquet(folder)
    data = spark.read.schema(data.schema).parquet(folder)
    out = None
    for k in range(folds):
        model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(data.where(F.col("fold") != k))
        found = model.transform(data.where(F.col("fold") == k))
        found = found.select("t", "angle", ((F.col("prediction") + 0.5) * (2 * math.pi / classes)).alias("decoded"))
        out = found if out is None else out.unionByName(found)
    return out


def angular_error(a: Column, b: Column) -> Column:
    """Distance on the circle."""
    d = F.pmod(a - b, F.lit(2 * math.pi))
    return F.least(d, F.lit(2 * math.pi) - d)
