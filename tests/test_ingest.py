"""Texts read by splits give what whole texts give."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.sources import ingest


@pytest.fixture
def splits(spark):
    """Splits of a few hundred bytes."""
    conf = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "50"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(tmp_path, **texts):
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    return str(tmp_path)


def test_numbers_of_lines_over_splits(spark, splits, tmp_path):
    rng = random.Random(1)
    texts = {f"t{k}.txt": "".join("x" * rng.choice([0, 3, 40, 700]) + f"é{n}" + rng.choice(["\n", "\r\n"]) for n in range(rng.choice([0, 1, 90]) if k else 90)) for k in range(4)}
    df = ingest.lines(spark, written(tmp_path, **texts))
    assert df.rdd.getNumPartitions() > 10
    got = {}
    for r in df.collect():
        got.setdefault(r["file"].rsplit("/", 1)[1], {})[r["line_no"]] = r["text"]
    want = {n: dict(enumerate(t.replace("\r\n", "\n").split("\n")[:-1])) for n, t in texts.items() if t}
    assert got == want
    joined = [r["text"] for r in ingest.lines(spark, str(tmp_path), joined=True).orderBy("line_no").collect()]
    assert joined == [x for n in sorted(want) for x in want[n].values()]


def test_what_is_carried_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(ingest, "CHUNK", 7)
    rng = random.Random(2)
    rows, want = [], {}
    for f in "ab":
        last, n = None, 0
        for k in range(100):
            mark = rng.choice([None] * 12 + ["m", "n"])
            last, n = mark or last, n + (mark == "m")
            rows.append((f, k, mark))
            want[f, k] = last, n
    df = spark.createDataFrame(rows, "file string, line_no long, mark string").repartition(5)
    got = ingest.counted(ingest.carried(df, "mark", "last"), F.when(F.col("mark") == "m", 1).otherwise(0), "n")
    assert {(r["file"], r["line_no"]): (r["last"], r["n"]) for r in got.collect()} == want
    assert sorted(r["n"] for r in ingest.numbered(df.where("file = 'a'"), "n").collect()) == list(range(100))


def test_a_deck_in_many_splits(spark, splits, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "CHUNK", 16)
    nodes = [f"{k} {k}.5 0.0 1.0+1" for k in range(300)]
    cells = [f"{k} 7 {k} {k + 1} {k + 2} {k + 3}" for k in range(200)]
    text = "\n".join(["title", "coordinates", *nodes[:150], "connectivity", *cells, "other", "9 9 9 9", "coordinates", *nodes[150:], "end"])
    n, c = ingest.sectioned_deck(ingest.lines(spark, written(tmp_path, d=text)))
    assert sorted((r["node_id"], r["x"], r["z"]) for r in n.collect()) == [(k, k + 0.5, 10.0) for k in range(300)]
    assert sorted((r["cell_id"], r["nodes"]) for r in c.collect()) == [(k, [k, k + 1, k + 2, k + 3]) for k in range(200)]


def test_objects_and_blocks_in_many_splits(spark, splits, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "CHUNK", 5)
    (tmp_path / "o").mkdir()
    (tmp_path / "b").mkdir()
    n, f = ingest.obj(ingest.lines(spark, written(tmp_path / "o", a="".join(f"v {k} 0 0\n" for k in range(99)) + "f 1/2 2 99\n", b="v 7 7 7\n")))
    assert sorted(r["node_id"] for r in n.collect()) == sorted([*range(99), 0]) and f.first()["nodes"] == [0, 1, 98]
    blocks = "".join("/\n" * (k % 3) + f"P {k} {-k}\nQ 1 2\n/\n" for k in range(60))
    got = ingest.minmax_blocks(ingest.lines(spark, written(tmp_path / "b", c=blocks))).where("name = 'P'").collect()
    assert sorted((r["block"], r["lo"], r["hi"], r["current"]) for r in got) == [(k + 1, -k, k, k == 59) for k in range(60)]


def test_inline_data_wherever_lines_break(spark, splits, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "CHUNK", 3)
    mesh = "<Topology TopologyType='Triangle'><DataItem>0 1 2</DataItem></Topology><Geometry><DataItem>0 0 0 1 0 0\n0 1\n 0</DataItem></Geometry>"
    attribute = lambda *v: "<Attribute Name='P' Center='Node'>\n<DataItem>" + "\n".join(map(str, v)) + "</DataItem></Attribute><Attribute Center=\"Cell\" Name=\"Q\"><DataItem>5</DataItem></Attribute>"
    frames = [f"<Grid Name='0'><Time Value='0.5'/>{mesh}{attribute(*range(100))}</Grid>", f"<Grid Name='1'>\n{attribute(7, 8, 9)}</Grid>", f"<Grid Name='2'><Time Value='3'/>{mesh}</Grid>"]
    text = "<?xml version='1.0'?>\n<!-- x --><Xdmf><Domain><Grid GridType='Collection' CollectionType='Temporal'>\n" + "\n\n".join(frames) + "</Grid></Domain></Xdmf>"
    v = ingest.xdmf_values(ingest.lines(spark, written(tmp_path, x=text)))
    got = {}
    for r in v.orderBy("frame", "item", "name", "place").collect():
        got.setdefault((r["frame"], r["time"], r["item"], r["name"], r["center"]), []).append(r["value"])
        assert r["place"] == len(got[r["frame"], r["time"], r["item"], r["name"], r["center"]]) - 1
    grid = {"Topology": [0, 1, 2], "Geometry": [0, 0, 0, 1, 0, 0, 0, 1, 0]}
    want = {(f, t, k, None, None): x for f, t in ((0, 0.5), (2, 3.0)) for k, x in grid.items()}
    want |= {(0, 0.5, "Attribute", "P", "Node"): list(range(100)), (1, 1.0, "Attribute", "P", "Node"): [7, 8, 9], **{(f, t, "Attribute", "Q", "Cell"): [5] for f, t in ((0, 0.5), (1, 1.0))}}
    assert got == want
    assert sorted(tuple(r)[1:] for r in ingest.xdmf_mesh_frames(v).collect()) == [(0, 0), (1, 0), (2, 2)]
