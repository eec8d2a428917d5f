"""Streamed neurons that share a row of the state store give what each gives alone."""

import numpy as np
import pandas as pd
import pytest

from somaflow.functions import activity
from somaflow.streaming import oasis_stream
from somaflow.streaming.oasis_stream import OnlineDeconvolution, OnlineSecondOrder, Together


class Held:
    """What a state store does for one key."""

    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def fed(processor, batches, key):
    processor.state, out = Held(), []
    for tables in batches:
        out += processor.handleInputRows(key, iter(tables), None)
    return pd.concat(out)


@pytest.mark.parametrize("make", [lambda: OnlineDeconvolution(0.9, 0.2, horizon=40, patience=9), lambda: OnlineSecondOrder((1.2, -0.3), 0.2, horizon=40, patience=9)])
def test_neurons_together_are_as_alone(make, monkeypatch):
    monkeypatch.setattr(oasis_stream, "ROWS", 50)  # several tables of results a batch
    rng = np.random.default_rng(8)
    frames = pd.DataFrame([(k, t, rng.gamma(1, 2)) for k in (-2, 0, 5, 63) for t in range(100 + k) if (k, t) != (5, 44)], columns=["k", "t", "v"])  # one never comes
    frames = frames.iloc[np.argsort(frames["t"] + rng.integers(0, 8, len(frames)), kind="stable")]
    frames = pd.concat([frames.iloc[:200], frames.iloc[:3], frames.iloc[200:]])  # three come twice
    batches = [[part.iloc[:60], part.iloc[60:]] for part in (frames.iloc[a : a + 110] for a in range(0, len(frames), 110))]
    got = fed(Together(make()), batches, (0,)).reset_index(drop=True)
    for k in (-2, 0, 5, 63):
        alone = fed(make(), [[pdf.loc[pdf["k"] == k, ["t", "v"]] for pdf in tables] for tables in batches if any((pdf["k"] == k).any() for pdf in tables)], (k,))
        pd.testing.assert_frame_equal(got[got["k"] == k].reset_index(drop=True), alone.reset_index(drop=True))
    assert got["late"].max() >= 1


def test_neighbouring_neurons_share_a_row_of_the_state_store(spark, tmp_path):
    y = np.random.default_rng(9).gamma(1, 2, (70, 40))
    for part in (range(25), range(25, 40)):
        spark.createDataFrame([(k, t, float(y[k, t])) for k in range(70) for t in part], "k long, t long, v double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = {}

    def take(df, _):
        seen.update({(r["k"], r["t"]): r["c"] for r in df.collect()})

    stream = spark.readStream.schema("k long, t long, v double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = oasis_stream.deconvolve_stream(stream, (1.2, -0.3), 0.2).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").foreachBatch(take).trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) == 2
    for k in range(70):
        whole = activity.Online((1.2, -0.3), 0.2)
        whole.fit(y[k].tolist())
        assert np.allclose([seen[k, t] for t in range(40)], whole.c, atol=1e-6)


def test_files_of_a_trace_are_streamed_in_their_order(spark, tmp_path, monkeypatch):
    """The one that ends last was taken last, so that early frames of long traces could count as lost."""
    y = np.random.default_rng(10).gamma(1, 2, 600)
    monkeypatch.setattr(oasis_stream, "new_folder", lambda *_: f"file://{tmp_path}/stream")
    traces = spark.createDataFrame([(1, t, float(v)) for t, v in enumerate(y)], "k long, t long, v double").repartition(5)
    got = oasis_stream.run_to_end(traces, (1.2, -0.3), 0.2, files=6).orderBy("t").toPandas()
    first = spark.read.parquet(f"file://{tmp_path}/stream/out").where("epoch = 0").toPandas()
    assert sorted(first["t"]) == list(range(len(first))) and 200 < len(first) < 400
    whole = activity.Online((1.2, -0.3), 0.2)
    whole.fit(y.tolist())
    assert np.allclose(got["c"], whole.c, atol=1e-6) and got["t"].tolist() == list(range(600))
