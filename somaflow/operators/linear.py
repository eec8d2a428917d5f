"""Matrix products, normalisation and residuals as joins and aggregates over sparse rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pixels of an image that is sent to every task.
IMAGE_PIXELS = 1 << 21
#: Products that one task adds up; where all results are fewer, they are added up before they are shuffled.
TASK_PRODUCTS = 1 << 20


def product(left: DataFrame, right: DataFrame, inner: str, row: str, column: str, a: str, b: str) -> DataFrame:
    """(row, column, v): sum over ``inner`` of a * b; zero entries may be left out of either side."""
    return left.join(right, inner).groupBy(row, column).agg(F.sum(F.col(a) * F.col(b)).alias("v"))


def gram(rows: DataFrame, inner: str, key: str, value: str) -> DataFrame:
    """(i, j, v) with i <= j: products of the sparse rows of ``key`` with each other, summed first by (inner, key).

    Tasks grow in number with the products, not in size; one aggregate asks for
    the rows and about how many keys and inner values there are.
    """
    n, keys, inners = rows.agg(F.count("*"), F.approx_count_distinct(key), F.approx_count_distinct(inner)).first()
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-n * (n // max(1, inners) + 2) // (2 * TASK_PRODUCTS)))
    once = rows.repartition(parts, inner).groupBy(inner, key).agg(F.sum(value).alias("v"))
    a = once.select(inner, F.col(key).alias("i"), F.col("v").alias("vi"))
    b = once.select(inner, F.col(key).alias("j"), F.col("v").alias("vj"))
    products = a.join(b, inner).where("i <= j").select("i", "j", (F.col("vi") * F.col("vj")).alias("v"))
    if keys * (keys + 1) // 2 > TASK_PRODUCTS:
        products = products.repartition(parts, "i", "j")
    return products.groupBy("i", "j").agg(F.sum("v").alias("v"))


def unit_footprints(footprints: DataFrame) -> DataFrame:
    """(k, p, a, norm): weights of unit length; traces are to be multiplied by norm.  Empty footprints go."""
    norm = footprints.groupBy("k").agg(F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("norm")).where("norm > 0")
    return footprints.join(norm, "k").select("k", "p", (F.col("a") / F.col("norm")).alias("a"), "norm")


def residual_traces(pixels: DataFrame, footprints: DataFrame, traces: DataFrame) -> DataFrame:
    """(k, t, v): what the data has beyond the model at each footprint, D (A Y - A A' C) with D = 1 / |A|^2."""
    size = footprints.groupBy("k").agg(F.sum(F.col("a") * F.col("a")).alias("nn"))
    data = product(pixels, footprints, "p", "t", "k", "v", "a").withColumnRenamed("v", "ya")
    other = footprints.select("p", F.col("k").alias("kk"), F.col("a").alias("aa"))
    shared = footprints.join(other, "p").groupBy("k", "kk").agg(F.sum(F.col("a") * F.col("aa")).alias("w"))
    model = shared.join(traces.select(F.col("k").alias("kk"), "t", F.col("v").alias("c")), "kk").groupBy("k", "t").agg(F.sum(F.col("w") * F.col("c")).alias("ca"))
    return data.join(model, ["k", "t"]).join(size, "k").select("k", "t", ((F.col("ya") - F.col("ca")) / F.col("nn")).alias("v"))


def outer(over_time: DataFrame, image: DataFrame) -> DataFrame:
    """(t, p, v): products of (t, f) with an image (p, b).

    The image is one row, an array of as many weights as it has pixels, which
    is sent to the tasks; frames stay where they are.  An image of more than
    IMAGE_PIXELS (16 bytes each) is an error that says so.
    """
    if image.limit(IMAGE_PIXELS + 1).count() > IMAGE_PIXELS:
        raise ValueError(f"an image of more than {IMAGE_PIXELS} pixels; split it by patch")
    weights = image.groupBy().agg(F.sort_array(F.collect_list(F.struct("p", "b"))).alias("weights"))
    both = over_time.join(F.broadcast(weights)).select("t", "f", F.explode("weights").alias("w"))
    return both.select("t", F.col("w.p").alias("p"), (F.col("f") * F.col("w.b")).alias("v"))


def strongest(footprints: DataFrame, share: float) -> DataFrame:
    """(k, p, a): the largest weights of each footprint that hold less than ``share`` of its energy, and those equal to the least of them."""
    each = Window.partitionBy("k")
    energy = F.sum(F.col("a") * F.col("a"))
    ordered = footprints.withColumn("_e", energy.over(each.orderBy(F.desc("a"), "p"))).withColumn("_all", energy.over(each))
    cut = F.min(F.when(F.col("_e") < share * F.col("_all"), F.col("a"))).over(each)
    return ordered.withColumn("_cut", cut).where("a >= _cut").select("k", "p", "a")


def non_empty(rows: DataFrame, key: str, value: str, least: float = 0.0) -> DataFrame:
    """(key, total) of the components whose sum is more than ``least``; join it to footprints and traces to drop the others."""
    return rows.groupBy(key).agg(F.sum(value).alias("total")).where(F.col("total") > least)
