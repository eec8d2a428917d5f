"""Online deconvolution: pools per neuron, fed by a stream of frames.

Frames (k, t, v) may come out of order: they wait in the state until the
frame before them has come.  Each batch gives the frames that are settled or may
have changed, so the newest row of a (k, t) is the one that holds.  Frames that
come twice, or before the first one that was taken, are counted as late and
dropped.

The state is bounded.  Pools that ended more than ``horizon`` frames ago are
settled for good and leave it; results are those of the whole trace unless a
later frame would merge pools further back.  Where more than ``patience`` frames
wait for one that is missing at a batch's end, that one counts as lost: the trace decays over it.

A state store's row and a table of results cost more than a neuron's frames do:
``SHARE`` neurons of neighbouring ids have them together.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from somaflow.folders import new_folder
from somaflow.functions import activity, oasis
from somaflow.functions.oasis import Pools

#: Frames that a neuron's state reaches back, and those that wait for a missing one.
HORIZON = 3000
PATIENCE = 3000
#: Ids of neurons that share a row of the state store, and rows of their results that are handed over at once.
SHARE = 64
ROWS = 1 << 16
OUTPUT = StructType([StructField("k", LongType()), StructField("t", LongType()), StructField("c", DoubleType()), StructField("s", DoubleType()), StructField("late", LongType())])
_STATE = StructType(
    [
        StructField("t", LongType()),
        StructField("late", LongType()),
        StructField("before", DoubleType()),
        StructField("v", ArrayType(DoubleType())),
        StructField("w", ArrayType(DoubleType())),
        StructField("at", ArrayType(LongType())),
        StructField("l", ArrayType(LongType())),
        StructField("wait_t", ArrayType(LongType())),
        StructField("wait_v", ArrayType(DoubleType())),
    ]
)


def _arrivals(rows: Iterable[pd.DataFrame]) -> Iterator[tuple[int, float]]:
    for pdf in rows:
        yield from zip(pdf["t"].tolist(), pdf["v"].tolist())


def _table(parts: list[tuple]) -> pd.DataFrame:
    """One table of results (k, t, c, s, late), where k and late are those of a neuron."""
    sizes = [len(t) for _, t, *_ in parts]
    k, late = (np.repeat(np.array([p[i] for p in parts], np.int64), sizes) for i in (0, 4))
    t, c, s = (np.concatenate([np.asarray(p[i], kind) for p in parts]) if parts else np.zeros(0, kind) for i, kind in ((1, np.int64), (2, float), (3, float)))
    return pd.DataFrame({"k": k, "t": t, "c": c, "s": s, "late": late})


class OnlineDeconvolution(StatefulProcessor):
    """Holds a neuron's pools of the last frames, the value before them, and the frames that wait."""

    def __init__(self, g: float, lam: float = 0.0, s_min: float = 0.0, b: float = 0.0, horizon: int = HORIZON, patience: int = PATIENCE):
        self.options = (g, lam, s_min, b)
        self.horizon, self.patience = horizon, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("pools", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, *out = self.taken(self.state.get() if self.state.exists() else None, _arrivals(rows))
        self.state.update(held)
        yield _table([(int(key[0]), *out)])

    def taken(self, held: tuple | None, arrivals: Iterable[tuple[int, float]]) -> tuple:
        """What a neuron's state becomes by frames (t, v), and its results (t, c, s, late)."""
        pools, late, before, waiting = Pools(*self.options), 0, 0.0, {}
        if held is not None:
            t, late, before, v, w, at, n, wt, wv = held
            pools.t, pools.v, pools.w, pools.at, pools.l = t, list(v), list(w), list(at), list(n)
            waiting = dict(zip(wt, wv))
        settled = pools.at[-1] if pools.at else 0
        for t, v in arrivals:
            if t < pools.t or t in waiting:
                late += 1
            else:
                waiting[t] = v
        while pools.t in waiting or len(waiting) > self.patience:
            if pools.t in waiting:
                pools.fit_next(waiting.pop(pools.t))
            else:
                pools.append(pools.last_value() * pools.g)
            settled = min(settled, pools.at[-1])
        first = pools.at[0] if pools.at else 0
        start = before  # of the first pool that is held
        out: tuple[list, list, list] = [], [], []
        for v, at, n in zip(pools.v, pools.at, pools.l):
            value = max(0.0, v)
            if at + n > settled:
                for i in range(n):
                    c = value * pools.g**i
                    if at + i >= settled:
                        s = 0.0 if at + i == first and first == 0 else (c - pools.g * before if i == 0 else 0.0)
                        for column, x in zip(out, (at + i, c, s)):
                            column.append(x)
            before = value * pools.g ** (n - 1)
        old = 0
        while old < len(pools.at) - 1 and pools.at[old] + pools.l[old] <= pools.t - self.horizon:
            start = max(0.0, pools.v[old]) * pools.g ** (pools.l[old] - 1)
            old += 1
        return (pools.t, late, start, *(x[old:] for x in (pools.v, pools.w, pools.at, pools.l)), list(waiting), list(waiting.values())), *out, late

    def close(self) -> None:
        pass


_SECOND = StructType(
    [
        StructField("t", LongType()),
        StructField("late", LongType()),
        StructField("before", ArrayType(DoubleType())),
        StructField("y", ArrayType(DoubleType())),
        StructField("c", ArrayType(DoubleType())),
        StructField("wait_t", ArrayType(LongType())),
        StructField("wait_v", ArrayType(DoubleType())),
    ]
)


class OnlineSecondOrder(StatefulProcessor):
    """Holds a neuron's frames that aren't settled, their values of c, the two before them, and the frames that wait."""

    def __init__(self, g: tuple[float, float], lam: float = 0.0, b: float = 0.0, horizon: int = HORIZON, patience: int = PATIENCE):
        self.options, self.patience = (g, lam, b, horizon), patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("frames", _SECOND)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, *out = self.taken(self.state.get() if self.state.exists() else None, _arrivals(rows))
        self.state.update(held)
        yield _table([(int(key[0]), *out)])

    def taken(self, held: tuple | None, arrivals: Iterable[tuple[int, float]]) -> tuple:
        """What a neuron's state becomes by frames (t, v), and its results (t, c, s, late)."""
        online, late, waiting = activity.Online(*self.options), 0, {}
        if held is not None:
            online.t, late, before, y, c, wt, wv = held
            online.before, online.y, online.c = tuple(before), list(y), np.array(c)
            waiting = dict(zip(wt, wv))
        due = online.t + len(online.y)
        for t, v in arrivals:
            if t < due or t in waiting:
                late += 1
            else:
                waiting[t] = v
        frames: list[float] = []
        while due in waiting or len(waiting) > self.patience:
            # a lost frame counts as what the decay over the ones before it leaves
            if due not in waiting:
                online.fit(frames)
                frames, last = [], [online.before[1], online.before[0], *online.c[-2:].tolist()]
                waiting[due] = online.b + online.g[0] * last[-1] + online.g[1] * last[-2]
            frames.append(waiting.pop(due))
            due += 1
        first = online.fit(frames)
        c, s = online.c[first - online.t :], online.s[first - online.t :]
        online.settle()
        held = online.t, late, list(online.before), online.y, online.c.tolist(), list(waiting), list(waiting.values())
        return held, first + np.arange(len(c)), c, s, late

    def close(self) -> None:
        pass


class Together(StatefulProcessor):
    """Takes the frames of many neurons, each as ``one`` does, and holds their states in one value."""

    def __init__(self, one: OnlineDeconvolution | OnlineSecondOrder):
        self.one = one

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("neurons", StructType([StructField("held", BinaryType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple] = pickle.loads(self.state.get()[0]) if self.state.exists() else {}
        k, t, v = (np.concatenate(x) for x in zip(*((pdf["k"].to_numpy(), pdf["t"].to_numpy(), pdf["v"].to_numpy()) for pdf in rows)))
        order = np.argsort(k, kind="stable")  # a neuron's frames stay in the order of their coming
        starts = np.flatnonzero(np.diff(k[order], prepend=k[order][0] - 1))
        parts, size = [], 0
        for frames in np.split(order, starts[1:]):
            neuron = int(k[frames[0]])
            held[neuron], *out = self.one.taken(held.get(neuron), zip(t[frames].tolist(), v[frames].tolist()))
            parts.append((neuron, *out))
            size += len(out[0])
            if size >= ROWS:
                yield _table(parts)
                parts, size = [], 0
        self.state.update((pickle.dumps(held, pickle.HIGHEST_PROTOCOL),))
        yield _table(parts)

    def close(self) -> None:
        pass


def deconvolve_stream(frames: DataFrame, g: float | tuple[float, float], lam: float = 0.0, s_min: float = 0.0, b: float = 0.0, horizon: int = HORIZON, patience: int = PATIENCE) -> DataFrame:
    """(k, t, c, s, late) of a stream (k, t, v); needs the RocksDB state store.

    Two values of ``g`` are a decay of second order, which has no ``s_min``.
    The state runner doesn't see packages sent by ``addPyFile``, so that the
    code it needs travels with the processor.
    """
    for module in (sys.modules[__name__], oasis, activity):
        cloudpickle.register_pickle_by_value(module)
    if isinstance(g, tuple):
        if s_min:
            raise NotImplementedError("s_min with decay of second order")
        one: OnlineDeconvolution | OnlineSecondOrder = OnlineSecondOrder(g, lam, b, horizon, patience)
    else:
        one = OnlineDeconvolution(g, lam, s_min, b, horizon, patience)
    shared = frames.select("k", "t", "v", F.floor(F.col("k") / SHARE).alias("share")).groupBy("share")
    return shared.transformWithStateInPandas(statefulProcessor=Together(one), outputStructType=OUTPUT, outputMode="Update", timeMode="None")


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def run_to_end(traces: DataFrame, g: float | tuple[float, float], lam: float = 0.0, s_min: float = 0.0, b: float = 0.0, files: int = 4) -> DataFrame:
    """(k, t, c, s, late) of traces (k, t, v) that are written as ``files`` files and streamed until all are read.

    The files hold ranges of t and are written in their order, since a stream
    takes them by age: out of order, long traces would wait beyond PATIENCE.

    Every batch's rows are kept with the batch's number below the folder of
    ``spark.checkpoint.dir``; of each frame the last batch's row holds.
    """
    spark = traces.sparkSession
    folder = new_folder(spark, "stream")
    frames = traces.select("k", "t", "v")
    frames.repartitionByRange(files, "t").withColumn("part", F.spark_partition_id().cast("long")).write.partitionBy("part").parquet(f"{folder}/parts")
    parts = spark.read.schema(StructType([*frames.schema.fields, StructField("part", LongType())])).parquet(f"{folder}/parts")
    for n in range(files):
        parts.where(F.col("part") == n).select("k", "t", "v").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", max(1, files // 2)).parquet(f"{folder}/in")

        def keep(df: DataFrame, epoch: int) -> None:
            df.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{folder}/out/batch={epoch}")

        q = deconvolve_stream(stream, g, lam, s_min, b).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        if old is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, old)
    rows = spark.read.parquet(f"{folder}/out")
    return rows.groupBy("k", "t").agg(*(F.max_by(c, "epoch").alias(c) for c in ("c", "s", "late")))
