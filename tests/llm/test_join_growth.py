"""What the n-gram join moves as its input grows: passages stay out of the first product, sketches go only to pairs left by counts."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from tessella.llm import common, ngram_join


def test_passages_go_last_when_counters_are_shared():
    """Of a large input each counter holds a hundred other shingles; those of a passage in 60 texts are still no first ones."""
    rng = random.Random(31)
    passage = [f"p{k}" for k in range(44)]
    texts = [" ".join([f"w{rng.randrange(10**9)}" for _ in range(130)] + passage) for _ in range(60)]
    common_ones = common.shingle_sets([" ".join(passage).encode()])[0]
    counts = np.random.default_rng(31).poisson(118, ngram_join.SKETCH).astype(np.uint32)
    counts[(common_ones & np.uint64(ngram_join.SKETCH - 1)).astype(np.int64)] += 60
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    out = pa.Table.from_batches(ngram_join._entries(5, SimpleNamespace(value=counts), 75, ngram_join.HOT)([batch]))
    assert out.num_rows == 60 * (170 - 128 + 1)
    held = np.unique(out.column("shingle").to_numpy(), return_counts=True)[1]
    assert (held > ngram_join.BLOCK).sum() <= 2  # by their hashes ten of the 40 would be


def test_sketches_meet_only_pairs_that_counts_leave(spark, monkeypatch):
    """Texts that have a passage in common, too short for a link, reach the parity sketches in no pair; copies do."""
    rng = random.Random(32)
    passage = [f"p{k}" for k in range(30)]
    texts = [" ".join(passage + [f"w{rng.randrange(10**9)}" for _ in range(100)]) for _ in range(40)]
    texts.append(texts[0] + " end")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    met, near = [], ngram_join._near
    monkeypatch.setattr(ngram_join, "_near", lambda pairs, *a: met.append(pairs.count()) or near(pairs, *a))
    assert ngram_join.overlaps(df).count() == 1
    assert met == [1]


def test_packed_counts():
    for counts in (np.zeros(5, np.uint32), np.array([0, 1, 255, 256, 2**32 - 1], np.uint32), np.array([2**40, 3], np.uint64)):
        assert ngram_join._unpacked(ngram_join._packed(counts)).tolist() == counts.tolist()


def test_kept_rows_are_not_dealt_out(spark):
    """Rows that stay are not shuffled, those that go are found whatever their number; an empty table of them takes none."""
    rows = spark.range(0, 20_000).selectExpr("id * 8589934592 + id % 7 AS _row", "repeat('x', 10) AS text")
    gone = rows.where("_row % 5 = 0").select("_row")
    left = ngram_join.without(rows, "_row", gone)
    assert sorted(left.collect()) == sorted(rows.where("_row % 5 <> 0").collect())
    assert ngram_join.without(rows, "_row", gone.limit(0)).count() == 20_000
    few = rows.where("_row % 1000 = 0").select("_row")
    moved = ngram_join.without(rows, "_row", few)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in moved.split("\n")[0] and moved.count("LeftAnti") == 1
