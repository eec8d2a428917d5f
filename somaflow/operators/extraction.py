"""Source extraction over a movie of any size: patches in parallel, then assembly, merging and evaluation.

Tables between the steps:

components  (k BIGINT, patch INT, px ARRAY<INT>, a ARRAY<DOUBLE>, c, s, yra ARRAY<DOUBLE>)   sparse footprint and traces
background  (patch INT, px ARRAY<INT>, b ARRAY<ARRAY<DOUBLE>>, f ARRAY<ARRAY<DOUBLE>>)
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somaflow.functions import extraction as fx
from somaflow.operators import geometry, graph
from somaflow.operators.background import compressed
from somaflow.operators.refine import evaluate
from somaflow.params import ExtractionParams

#: Components whose traces meet in one task.
BLOCK = 256
COMPONENT = "patch int, px array<int>, a array<double>, c array<double>, s array<double>, yra array<double>"


@dataclass
class Result:
    components: DataFrame
    background: DataFrame
    h: int
    w: int

    def footprints(self) -> DataFrame:
        """(k, p, a)"""
        return self.components.select("k", F.explode(F.arrays_zip("px", "a")).alias("z")).select("k", F.col("z.px").alias("p"), F.col("z.a").alias("a"))

    def traces(self, column: str = "c") -> DataFrame:
        """(k, t, v)"""
        return self.components.select("k", F.posexplode(column).alias("t", "v")).withColumn("t", F.col("t").cast("bigint"))


def patch_movies(frames: DataFrame, w: int, patches) -> DataFrame:
    """(patch, t, px): each frame cut into the overlapping patches, without leaving its task; one shuffle follows."""

    def cut(batches):
        for batch in batches:
            block = np.asarray(batch.column(1).flatten()).astype(float).reshape(len(batch), -1, w)
            for n, y0, y1, x0, x1 in patches:
                part = np.ascontiguousarray(block[:, y0:y1, x0:x1]).reshape(len(batch), -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(batch), n, np.int32)), batch.column(0), pa.array([row.astype("<f4").tobytes() for row in part], pa.binary())], ["patch", "t", "px"]
                )

    return frames.select("t", "px").mapInArrow(cut, "patch int, t long, px binary")


def fit_patches(frames: DataFrame, h: int, w: int, params: ExtractionParams) -> DataFrame:
    """One row per component (kind 0) and per patch background (kind 1).

    A patch is one task: seeds are sequential inside it.  Its movie is frames x
    patch pixels x 4 bytes, which ``nb_patch`` bounds.
    """
    patches = geometry.analysis_patches(h, w, params.patch_params.nb_patch, params.patch_params.overlaps)
    bounds = {p[0]: p[1:] for p in patches}

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y0, y1, x0, x1 = bounds[int(key[0])]
        pdf = pdf.sort_values("t")
        movie = np.stack([np.frombuffer(b, "<f4") for b in pdf["px"]]).astype(float).reshape(len(pdf), y1 - y0, x1 - x0)
        got = fx.fit_patch(movie, params)
        where = (np.arange(y0, y1)[:, None] * w + np.arange(x0, x1)).ravel()
        rows = []
        for k in range(len(got["a"])):
            on = np.flatnonzero(got["a"][k] > 0)
            rows.append((0, int(key[0]), where[on], got["a"][k][on], got["c"][:, k], got["s"][:, k], got["yra"][:, k], got["sn"][on]))
        for k in range(len(got["b"])):
            rows.append((1, int(key[0]), where, got["b"][k], got["f"][:, k], np.zeros(0), np.zeros(0), got["sn"]))
        return pd.DataFrame(rows, columns=["kind", "patch", "px", "a", "c", "s", "yra", "sn"])

    return patch_movies(frames, w, patches).groupBy("patch").applyInPandas(fit, f"kind int, {COMPONENT}, sn array<double>")


def assemble(fitted: DataFrame, h: int, w: int, params: ExtractionParams) -> tuple[DataFrame, DataFrame]:
    """(components, background): a component stays with the patch whose centre is nearest to it; ids by (patch, place)."""
    patches = geometry.analysis_patches(h, w, params.patch_params.nb_patch, params.patch_params.overlaps)
    centers = fitted.sparkSession.createDataFrame([(p, (y0 + y1 - 1) / 2, (x0 + x1 - 1) / 2) for p, y0, y1, x0, x1 in patches], "near long, cy double, cx double")
    found = fitted.where("kind = 0").drop("kind", "sn")
    y = F.aggregate(F.zip_with("px", "a", lambda p, a: F.floor(p / w) * a), F.lit(0.0), lambda s, v: s + v)
    x = F.aggregate(F.zip_with("px", "a", lambda p, a: (p % w) * a), F.lit(0.0), lambda s, v: s + v)
    total = F.aggregate("a", F.lit(0.0), lambda s, v: s + v)
    # ids from what tells a component from others, so that they don't hang on task order
    named = found.withColumn("k", F.xxhash64("patch", "px", "a")).withColumn("cy", y / total).withColumn("cx", x / total)
    near = geometry.nearest_center(named, centers, ["k", "patch"], ["cy", "cx"], "near").where("near = patch").select("k")
    return named.join(near, "k", "left_semi").drop("cy", "cx"), fitted.where("kind = 1").select("patch", "px", F.col("a").alias("b"), F.col("c").alias("f"))


def correlated_overlaps(components: DataFrame) -> DataFrame:
    """(i, j, r), i < j: correlation of the traces of components that share pixels.

    Traces meet as blocks: an edge takes its two ids to the first one's block of
    BLOCK components, and a trace goes once to each block that asks for it.
    """
    edges = geometry.overlap_graph(Result(components, components, 0, 0).footprints()).select("i", "j")
    edges = edges.withColumn("block", F.pmod(F.xxhash64("i"), F.lit(max(1, -(-components.count() // BLOCK)))).cast("int"))
    asks = edges.select("block", F.col("i").alias("k")).unionByName(edges.select("block", F.col("j").alias("k"))).distinct()
    held = asks.join(components.select("k", "c"), "k").select(F.col("block").alias("at"), "k", "c")

    def run(pairs: pd.DataFrame, traces: pd.DataFrame) -> pd.DataFrame:
        if not len(pairs):
            return pd.DataFrame([], columns=["i", "j", "r"])
        c = np.stack(list(traces["c"])).astype(float)
        c = c - c.mean(axis=1, keepdims=True)
        size = np.sqrt((c**2).sum(axis=1))
        c /= np.where(size > 0, size, 1)[:, None]
        place = dict(zip(traces["k"], range(len(c))))
        i, j = (np.array([place[k] for k in pairs[x]]) for x in ("i", "j"))
        return pd.DataFrame({"i": pairs["i"], "j": pairs["j"], "r": np.einsum("ij,ij->i", c[i], c[j])})

    return edges.groupBy("block").cogroup(held.groupBy("at")).applyInPandas(run, "i long, j long, r double")


def merge_plan(components: DataFrame, params: ExtractionParams, save: Callable[[DataFrame, str], DataFrame], name: str = "merge") -> tuple[DataFrame, DataFrame]:
    """((k, root), (root, place, total)): the groups that one round merges, and their order by summed correlation."""
    bound = params.merge_params.thr / 2 if params.merge_params.compat else params.merge_params.thr
    pairs = save(correlated_overlaps(components), f"{name}-pairs")
    groups = save(graph.connected(pairs.where(F.col("r") > bound), save, f"{name}-groups"), f"{name}-members")
    return groups, graph.in_order(groups, pairs)


def merge_components(components: DataFrame, params: ExtractionParams, save: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Components that overlap and move together become one, until none do.

    A merged component has the id of its group's smallest member; groups are
    taken in the order of ``merge_plan``, which numbers them for whoever lists them.
    """
    turn = 0
    while True:
        groups, _ = merge_plan(components, params, save, f"merge-{turn}")
        if groups.isEmpty():
            return components

        def fuse(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("k")
            px = np.unique(np.concatenate(list(pdf["px"])))
            a = np.zeros((len(pdf), len(px)))
            for i, (p, v) in enumerate(zip(pdf["px"], pdf["a"])):
                a[i, np.searchsorted(px, p)] = v
            one, c, s = fx.merged_component(a, np.stack(list(pdf["c"]), axis=1), params.temporal_params)
            on = np.flatnonzero(one > 0)
            return pd.DataFrame([(int(pdf["root"].iloc[0]), int(pdf["patch"].iloc[0]), px[on].astype(np.int32), one[on], c, s, np.mean(np.stack(list(pdf["yra"])), axis=0))], columns=["k", "patch", "px", "a", "c", "s", "yra"])

        fused = components.join(groups, "k").groupBy("root").applyInPandas(fuse, f"k long, {COMPONENT}")
        rest = components.join(groups.select("k"), "k", "left_anti")
        components = save(rest.select(*fused.columns).unionByName(fused), f"merged-{turn}")
        turn += 1


def compress_background(background: DataFrame, h: int, w: int, params: ExtractionParams, save: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """(component, b, f): all patches' backgrounds as ``nb`` parts, each patch's rows in tasks of their own."""
    return compressed(background, h * w, params.temporal_params.nb, params.seed, save=save)[0]


def extract(frames: DataFrame, h: int, w: int, params: ExtractionParams, save: Callable[[DataFrame, str], DataFrame], final: bool = True) -> Result:
    """The whole extraction: patches, assembly, merging, background, and the final update unless ``final`` is off."""
    fitted = save(fit_patches(frames, h, w, params), "fitted")
    components, background = assemble(fitted, h, w, params)
    components = merge_components(save(components, "assembled"), params, save)
    background = save(compress_background(background, h, w, params, save), "background")
    if final:
        components = save(evaluate(frames, components, background, h, w, params, save), "evaluated")
    return Result(components, background, h, w)
