"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step handles; a longer single text makes a step of its own.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all runs on
    this machine (tests); on a cluster without it the executors would each write to their own disk, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessella-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes the files of tables that keep() wrote and that nothing will read any more."""
    for table in tables:
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if path.rsplit("/", 1)[-1].startswith("tessella-"):
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def keyed(df: DataFrame) -> tuple[DataFrame, str]:
    """df with a number of each row in a column of a name that df doesn't have, written once so that it never changes (ids can be
    null or repeated); and that name."""
    taken, name = {c.lower() for c in df.columns}, "_row"
    while name in taken:
        name += "_"
    return keep(df.withColumn(name, F.monotonically_increasing_id()), "keyed"), name


def steps(ids: pa.Array, texts: pa.Array) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Rows of a batch in runs of about STEP_BYTES of UTF-8; null texts are empty."""
    begin, size, part = 0, 0, []
    for k, t in enumerate(texts.cast(pa.binary())):
        b = t.as_py() or b""
        part.append(b)
        size += len(b)
        if size >= STEP_BYTES:
            yield ids.slice(begin, len(part)), part
            begin, size, part = k + 1, 0, []
    if part:
        yield ids.slice(begin, len(part)), part


def per_step(make: Callable[[pa.Array, list[bytes]], dict], schema: pa.Schema) -> Callable:
    """A mapInArrow function over columns (id, text): make(ids, texts) gives the columns of schema for each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in steps(batch.column(0), batch.column(1)):
                yield pa.RecordBatch.from_pydict(make(ids, texts), schema=schema)

    return run


# ---------------------------------------------------------------- hashed words

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
MIX = _RNG.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        size = ((n >> 18) + 1) << 18  # in steps, since every worker keeps them
        a = np.full(size, base, np.uint64)
        a[0] = 1
        _POWERS[base] = np.multiply.accumulate(a)
    return _POWERS[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in order, the words' bounds in each text (len(texts) + 1), and word starts as byte offsets in the joined texts.

    Words are runs of bytes other than space, tab, LF, VT, FF and CR, with A-Z lowered."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_R, len(data)), out=total[1:])
    words = (total[ends] - total[starts]) * _powers(_R_INV, len(data))[starts]
    return mixed(words + (ends - starts).astype(np.uint64)), np.searchsorted(starts, bounds), starts


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of size words; words is one text's."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n] * MIX[0]
    for j in range(1, size):
        out += words[j : j + n] * MIX[j]
    return mixed(out)


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """For each text its sorted distinct shingles; with fewer words the whole sequence as one; none without words."""
    words, at, _ = hashed_words(texts)
    n = len(words) - size + 1
    joined = shingles(words, size) if n > 0 else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(joined[a : b - size + 1]))
        elif b > a:
            out.append(mixed((words[a:b] * MIX[: b - a]).sum(keepdims=True) + MIX[8 + b - a]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


# ---------------------------------------------------------------- components


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, label) for every node of edges (a, b): the smallest node it is connected with.

    Alternating large and small stars; each round is two grouped minima and joins on narrow rows, written to the shared
    folder, so no neighbourhood is ever gathered. An empty edge table gives no rows."""
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    said = None
    while True:
        e = both(now)
        least = e.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = e.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        now = keep(small.unionByName(low.toDF("a", "b")).distinct(), name)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == said:
            break
        said = new
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("label", F.col("node"))
    return now.toDF("node", "label").unionByName(roots)
