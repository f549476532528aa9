"""Streams that stop and go on; modes and clusters against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import modal
from tessella.streaming import monitor


def test_a_stream_that_fails_and_restarts_counts_once(spark, tmp_path, monkeypatch):
    rows = [(c, e, "p", float(c * 10 + e)) for c in range(6) for e in range(4)]
    kind = "cycle int, entity_id long, var string, value double"
    source, target, at = (str(tmp_path / n) for n in ("in", "out", "cp"))
    put = lambda part: spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: monitor.running_sums(monitor.arriving(spark, source, kind, 1))
    key = lambda df: sorted((r["entity_id"], r["n"], r["sum"], r["square_sum"]) for r in df.collect())
    put(rows[:8])
    put(rows[8:12])
    monitor.fold(stream(), target, at)
    assert key(monitor.folded(spark, target, ["entity_id", "var"])) == key(monitor.running_sums(spark.createDataFrame(rows[:12], kind)))
    put(rows[12:])

    def broken(changed, batch):  # written, but the stream stops before it has said so
        changed.write.mode("overwrite").parquet(f"{target}/batch={batch}")
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        stream().writeStream.outputMode("update").foreachBatch(broken).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    for _ in range(2):
        monitor.fold(stream(), target, at)
        assert key(monitor.folded(spark, target, ["entity_id", "var"])) == key(monitor.running_sums(spark.createDataFrame(rows, kind)))


@pytest.mark.parametrize(("cycles", "entities", "most"), [(7, 30, 2000), (900, 6, 2000), (12, 15, 5)])
def test_modes_are_singular_vectors(spark, monkeypatch, cycles, entities, most):
    monkeypatch.setattr(modal, "MOST", most)
    monkeypatch.setattr(modal, "SPARE", 4)
    rng = np.random.default_rng(5)
    a = rng.normal(size=(cycles, 3)) * [30, 5, 1] @ rng.normal(size=(3, entities)) + rng.normal(size=entities)
    s = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(cycles) for j in range(entities)], "cycle int, entity_id long, value double")
    t, f = modal.pod(s, 3)
    u, size, vt = np.linalg.svd(a - a.mean(0), full_matrices=False)
    got_f, got_t, energy = np.zeros((3, entities)), np.zeros((cycles, 3)), {}
    for r in f.collect():
        got_f[r["mode"], r["entity_id"]] = r["value"]
    for r in t.collect():
        got_t[r["cycle"], r["mode"]] = r["t"]
        energy[r["mode"]] = r["energy"]
    sign = np.sign((got_f * vt[:3]).sum(1))
    assert np.allclose(got_f * sign[:, None], vt[:3], atol=1e-5) and np.allclose(got_t * sign, u[:, :3] * size[:3], atol=1e-4)
    assert np.allclose([energy[k] for k in range(3)], size[:3] ** 2 / (size**2).sum(), atol=1e-8)


def test_lloyd_ends_by_its_rule_and_keeps_empty_clusters(spark):
    points = [0.0, 1.0, 10.0, 11.0, 0.0]
    s = spark.createDataFrame([(i, 0, x) for i, x in enumerate(points)], "cycle int, entity_id long, value double")
    labels, centroids = modal.kmeans(s, 3, [0, 2, 4])
    assert {r["cycle"]: r["cluster"] for r in labels.collect()} == {0: 2, 1: 0, 2: 1, 3: 1, 4: 2}  # the empty one takes them back
    assert {r["cluster"]: round(r["value"], 6) for r in centroids.collect()} == {0: 1.0, 1: 10.5, 2: 0.0}
    assert modal.kmeans(s, 9)[1].select("cluster").distinct().count() == 5
    assert labels.agg(F.count("*")).first()[0] == 5
