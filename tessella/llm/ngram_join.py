"""N-gram Jaccard join: which documents share at least three quarters of their word shingles, and the groups they form.

The product of the sparse document-by-shingle matrix with its transpose, in blocks, with overlap counts summed by pair:

1. One pass hashes the shingle set of each text. Equal sets become one node; a count-min sketch of fixed size estimates
   how many texts hold each shingle. Both come from tasks as partial results.
2. Shingles are put in one global order, rare first by the sketch, then by hash (any order is right, rare first keeps
   blocks small; counts are compared as they are, since of a large input a counter has a high share of other shingles, from
   which those of a passage in tens of texts stand out by a small part only). A pair that links shares one of the first n - ceil(0.75 n) + 1 shingles of either text, so the first
   product is of these columns. Blocks are shingles; each gives partial counts of the pairs whose sizes allow a link.
3. The partial counts are summed by pair. What two texts share is at most the sum, the columns of large blocks that both
   have and what follows the first shingles of one of them; pairs whose sizes ask for more go, before anything but numbers
   is joined to them.
4. A block of up to BLOCK nodes gives its pairs. A larger one first gives a star (each node with the one that is in most
   large blocks, as the origin of edited copies is); only nodes that verified stars have not yet connected are compared
   afterwards, in cells of CELL x CELL nodes: first each node with its closest one of another component, then, where
   these links leave components apart, all pairs between them. A pair is given by the first of its common blocks only.
   So a large group of near copies costs rows in proportion to its size and a hot shingle is spread over many tasks.
5. Each set also has a parity sketch of BITS bits a shingle or more. The bits in which two sketches differ are a lower bound
   of the shingles in which the sets differ, so pairs too far apart go before any set moves.
6. The second product is of all columns, masked by the pairs left: sets are cut by shingle hash into blocks of about CUT
   shingles, each block gives a pair's partial count, and the sums decide, 100 * both >= 75 * either. So no row holds the
   whole set of a long text.

Nothing of the corpus reaches the driver but the count-min sketch (SKETCH counters) and a Bloom filter of fixed size that
spares sets no pair needs. Set equality and shingle equality are 64-bit hash equality.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import common

#: Counters of the sketch: 4 bytes each, whatever the input.
SKETCH = 1 << 20
#: Rows of the sketch table that one task gives.
PIECES = 64
#: Nodes of a block whose pairs are formed at once.
BLOCK = 48
#: Estimated holders beyond which a shingle's entries don't meet in one task.
HOT = 20_000
#: Side of a cell of a large block.
CELL = 1024
#: Bits of a parity sketch for each shingle, a power of two: at one bit, pairs at two thirds often look like three quarters.
BITS = 4
#: Shingles of a set that one row holds, about: a longer set is cut into a power of two of pieces by the leading bits.
CUT = 8192
#: Earlier large blocks of a node that a row carries to tell which pairs were met before; with others a pair is met again.
EARLIER = 8
#: Bits of the Bloom filter.
BLOOM = 1 << 24

_PASS = pa.schema([("kind", pa.int8()), ("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("parity", pa.list_(pa.int64())), ("piece", pa.int32()), ("counts", pa.binary())])
_ENTRY = pa.schema([("shingle", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("hot", pa.bool_())])
#: n and pos: of an entry (b is null) its set's size and its position; of a pair how many shingles it shares here and in how many
#: of these the positions allow a link.
_PAIR = pa.schema([("shingle", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])
_CELL = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64())])


def _node(s: np.ndarray) -> int:
    """The identity of a set: a signed 64-bit sum that its order doesn't change."""
    each = np.append(common.mixed(s ^ np.uint64(0x5851F42D4C957F2D)), common.mixed(np.array([len(s)], np.uint64)))
    return int(each.sum().view(np.int64))


def _parity(s: np.ndarray) -> np.ndarray:
    """A power of two of 64-bit words, BITS bits or more for each shingle: how often each bit is drawn, modulo 2."""
    words = 1 << max(0, (BITS * len(s) - 1).bit_length() - 6)
    odd = np.bincount((s >> np.uint64(40)).astype(np.int64) % (64 * words), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _sizes(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.uint32)
        for batch in batches:
            for ids, texts in common.steps(batch.column(0), batch.column(1)):
                sets = common.shingle_sets(texts, size)
                held = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                np.add.at(counts, (held & np.uint64(SKETCH - 1)).astype(np.int64), np.uint32(1))
                k = len(sets)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int8)), ids, pa.array([_node(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([_parity(s) for s in sets], pa.list_(pa.int64())), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], schema=_PASS)
        pieces = counts.reshape(PIECES, -1)
        none = pa.nulls(PIECES, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(PIECES, np.int8)), none, none, none, pa.nulls(PIECES, pa.list_(pa.int64())), pa.array(range(PIECES), pa.int32()), pa.array([_packed(p) for p in pieces], pa.binary())], schema=_PASS)

    return run


def _packed(counts: np.ndarray) -> bytes:
    """Counts by their bytes' planes, of which the high ones are mostly zeros, compressed."""
    return zlib.compress(np.ascontiguousarray(counts.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpacked(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(b), np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _add_counts(table: pa.Table) -> pa.Table:
    total = np.zeros(SKETCH // PIECES, np.uint64)
    for b in table.column("counts"):
        total += _unpacked(b.as_py())
    return pa.table({"piece": table.column("piece").slice(0, 1), "counts": pa.array([_packed(total)], pa.binary())})


def _sketch(pieces: DataFrame) -> np.ndarray:
    """The summed sketch; tasks' pieces are added in two levels, so that no task gathers those of all partitions."""
    half = pieces.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(32)))
    for by in (["piece", "part"], ["piece"]):
        half = half.groupBy(*by).applyInArrow(lambda k, t: _keyed(k, t), "piece int, part int, counts binary") if len(by) == 2 else half.groupBy(*by).applyInArrow(_add_counts, "piece int, counts binary")
    out = np.zeros((PIECES, SKETCH // PIECES), np.uint64)
    for row in half.collect():  # PIECES rows, SKETCH counters
        out[row.piece] = _unpacked(row.counts)
    return np.minimum(out.ravel(), np.uint64(2**32 - 1)).astype(np.uint32)


def _keyed(key: tuple, table: pa.Table) -> pa.Table:
    t = _add_counts(table)
    return pa.table({"piece": t.column("piece"), "part": pa.array([key[1].as_py()], pa.int32()), "counts": t.column("counts")})


def _entries(size: int, sketch, percent: int, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_by, seen = sketch.value, set()
        usual = max(1, int(held_by.mean()))  # of a large input, what the other shingles of a counter add
        for batch in batches:
            for _, texts in common.steps(batch.column(0), batch.column(1)):
                out: list[tuple[np.ndarray, ...]] = []
                for s in common.shingle_sets(texts, size):
                    n = len(s)
                    if not n or (node := _node(s)) in seen:
                        continue
                    seen.add(node)
                    known = held_by[(s & np.uint64(SKETCH - 1)).astype(np.int64)]
                    order = np.lexsort((s, known))
                    first = order[: n - -(-percent * n // 100) + 1]
                    k = len(first)
                    out.append((s[first].view(np.int64), np.full(k, node, np.int64), np.full(k, n, np.int32), np.arange(k, dtype=np.int32), known[first] >= hot + usual - 1))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=_ENTRY)

    return run


def _allowed(n1, p1, n2, p2, percent: int):
    """Whether a pair whose first common shingle is at these positions can still reach the threshold."""
    low, high = np.minimum(n1, n2), np.maximum(n1, n2)
    return (100 * low >= percent * high) & ((100 + percent) * np.minimum(n1 - p1, n2 - p2) >= percent * (n1 + n2))


def _blocks(percent: int, block: int):
    """Streams entries sorted by shingle and node, repeated ones once: partial counts of pairs of small blocks, the entries themselves of large ones."""

    def give(shingle, a, b, n, pos):
        return pa.RecordBatch.from_arrays([pa.array(shingle), pa.array(a), b if isinstance(b, pa.Array) else pa.array(b), pa.array(n), pa.array(pos)], schema=_PAIR)

    def raw(t: np.ndarray):
        return give(t["s"], t["v"], pa.nulls(len(t), pa.int64()), t["n"], t["p"])

    def pairs(t: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.diff(t["s"])) + 1
        begin = np.concatenate([[0], edge])
        length = np.diff(np.concatenate([begin, [len(t)]]))
        for m in np.unique(length):
            if m < 2:
                continue
            at = begin[length == m]
            if m > block:
                yield raw(t[(at[:, None] + np.arange(m)).ravel()])
                continue
            i, j = np.triu_indices(m, 1)
            for part in np.array_split(at, max(1, len(at) * len(i) // 500_000)):
                x, y = t[(part[:, None] + i).ravel()], t[(part[:, None] + j).ravel()]
                n_x, n_y = x["n"].astype(np.int64), y["n"].astype(np.int64)
                ok = (x["v"] != y["v"]) & _allowed(n_x, 0, n_y, 0, percent)
                first = _allowed(n_x, x["p"], n_y, y["p"], percent)[ok]
                a, b = np.minimum(x["v"], y["v"])[ok], np.maximum(x["v"], y["v"])[ok]
                if not len(a):
                    continue
                order = np.lexsort((b, a))
                a, b, first = a[order], b[order], first[order]
                start = np.concatenate([[0], np.flatnonzero((np.diff(a) != 0) | (np.diff(b) != 0)) + 1])
                shared = np.diff(np.concatenate([start, [len(a)]])).astype(np.int32)
                yield give(np.zeros(len(start), np.int64), a[start], b[start], shared, np.add.reduceat(first.astype(np.int32), start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = [("s", np.int64), ("v", np.int64), ("n", np.int32), ("p", np.int32)]
        left, large, last = np.zeros(0, kind), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = np.zeros(batch.num_rows, kind)
            for c, name in zip(("s", "v", "n", "p"), ("shingle", "node", "n", "pos"), strict=True):
                t[c] = batch.column(name).to_numpy(zero_copy_only=False)
            hot = batch.column("hot").to_numpy(zero_copy_only=False)
            new = np.ones(len(t), bool)
            new[1:] = (t["s"][1:] != t["s"][:-1]) | (t["v"][1:] != t["v"][:-1])
            new[0] = (t["s"][0], t["v"][0]) != last
            last = (t["s"][-1], t["v"][-1])
            t, hot = t[new], hot[new]
            if hot.any():
                yield raw(t[hot])
                t = t[~hot]
            t = np.concatenate([left, t])
            if large is not None:
                more = t["s"] == large
                if more.any():
                    yield raw(t[more])
                    t = t[~more]
                if not len(t):
                    left = t
                    continue
                large = None
            k = int(np.searchsorted(t["s"], t["s"][-1])) if len(t) else 0
            if k:
                yield from pairs(t[:k])
            left = t[k:]
            if len(left) > block:
                large = left["s"][0]
                yield raw(left)
                left = left[:0]
        if len(left) > 1:
            yield from pairs(left)

    return run


def _level(n: int) -> int:
    """A set of n shingles is cut into 2 ** _level(n) pieces."""
    return ((n - 1) // CUT).bit_length()


def _level_of(n: str) -> Column:
    """_level as a Column."""
    return F.when(F.col(n) > CUT, F.length(F.bin(F.floor((F.col(n) - 1) / CUT)))).otherwise(0)


def _sets(size: int, percent: int, bloom):
    """Sets in pieces, at each level that a link with another set can ask for."""
    schema = pa.schema([("node", pa.int64()), ("level", pa.int32()), ("piece", pa.int32()), ("set", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = bloom.value, set()
        for batch in batches:
            for _, texts in common.steps(batch.column(0), batch.column(1)):
                rows: list[tuple[int, int, int, np.ndarray]] = []
                for s in common.shingle_sets(texts, size):
                    if len(s) and (node := _node(s)) not in seen and bits[(bit := node % BLOOM) >> 3] >> (bit & 7) & 1:
                        seen.add(node)
                        for level in range(_level(len(s)), _level(100 * len(s) // percent) + 1):
                            of = s >> np.uint64(64 - level) if level else np.zeros(len(s), np.uint64)
                            at = np.searchsorted(of, np.arange(2**level + 1, dtype=np.uint64))
                            rows.extend((node, level, k, s[at[k] : at[k + 1]].view(np.int64)) for k in range(2**level) if at[k] < at[k + 1])
                if rows:
                    nodes, levels, pieces, kept = zip(*rows, strict=True)
                    ends = np.concatenate([[0], np.cumsum([len(s) for s in kept])]).astype(np.int32)
                    sets = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept)))
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(levels, pa.int32()), pa.array(pieces, pa.int32()), sets], schema=schema)

    return run


def _bloom(nodes: DataFrame) -> np.ndarray:
    """One bit for each node's low bits; the driver gets BLOOM / 64 words at most."""
    rows = nodes.selectExpr(f"cast(pmod(node, {BLOOM}) div 64 as int) AS word", f"shiftleft(1L, cast(pmod(node, {BLOOM}) % 64 as int)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(BLOOM // 64, np.int64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return words.view(np.uint8)


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows of rows whose key, a long, isn't in gone (key). Rows that a Bloom filter of gone clears stay where they are."""
    bits = rows.sparkSession.sparkContext.broadcast(_bloom(gone.select(F.xxhash64(key).alias("node"))))

    @F.pandas_udf("boolean")
    def may_go(h: pd.Series) -> pd.Series:
        bit = h.to_numpy() % BLOOM
        return pd.Series((bits.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool))

    found = may_go(F.xxhash64(key))
    return rows.where(~found).unionByName(rows.where(found).join(gone, key, "left_anti").select(*rows.columns))


def _held(classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, parity) of classes for nodes, a table of different ones; the rows that no node can need go before they are shuffled."""
    bits = classes.sparkSession.sparkContext.broadcast(_bloom(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column(0).to_numpy() % BLOOM
            yield batch.filter(pa.array((bits.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)))

    return classes.select("node", "parity").mapInArrow(run, "node long, parity array<long>").join(nodes, "node", "left_semi")


def _far(a: list, b: list) -> np.ndarray:
    """In how many bits the parity sketches of pairs differ at least; those of other sizes are folded to the smaller."""
    out = np.full(len(a), np.iinfo(np.int64).max)
    sizes = np.array([[len(x), len(y)] for x, y in zip(a, b, strict=True)]).reshape(-1, 2)
    for m, n in np.unique(sizes, axis=0).tolist():
        at = np.flatnonzero((sizes == (m, n)).all(1))
        x, y = np.stack([a[k] for k in at]), np.stack([b[k] for k in at])
        w = min(m, n)
        if max(m, n) <= 2 * w:
            fold = lambda z: z if z.shape[1] == w else z[:, :w] ^ z[:, w:]  # noqa: E731, B023
            out[at] = np.bitwise_count((fold(x) ^ fold(y)).view(np.uint64)).sum(1, dtype=np.int64)  # of signed numbers it counts the bits of the absolute value
    return out


def _cells(percent: int, closest: bool):
    """Pairs of a cell that can link: all, or for each node the closest only. A pair with an earlier common block is left to it."""

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        node, label, n, pos = (table.column(c).to_numpy().astype(np.int64) for c in ("node", "label", "n", "pos"))
        parity = [np.array(x, np.int64) for x in table.column("parity").to_pylist()]
        before = [[s for p, s in zip(at, blocks, strict=True) if p < own] for at, blocks, own in zip(table.column("at").to_pylist(), table.column("blocks").to_pylist(), pos.tolist(), strict=True)]
        held = np.array([len(x) for x in before])
        earlier = np.zeros((len(node), EARLIER), np.int64)
        for k, x in enumerate(before):
            earlier[k, : len(x)] = x
        filled = np.arange(EARLIER) < held[:, None]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        one, two = np.flatnonzero(side == i), np.flatnonzero(side == j)
        out = []
        for part in np.array_split(one, -(-len(one) // 64)):
            ok = (label[part][:, None] != label[two][None, :]) & _allowed(n[part][:, None], pos[part][:, None], n[two][None, :], pos[two][None, :], percent)
            if i == j:
                ok &= part[:, None] < two[None, :]
            x, y = np.nonzero(ok)
            x, y = part[x], two[y]
            far = _far([parity[k] for k in x], [parity[k] for k in y]).clip(max=1 << 40)
            near = (100 + percent) * far <= (100 - percent) * (n[x] + n[y])
            x, y, far = x[near], y[near], far[near]
            met = np.zeros(len(x), bool)
            for p in range(EARLIER):
                for q in range(EARLIER):
                    met |= (earlier[x, p] == earlier[y, q]) & filled[x, p] & filled[y, q]
            out.append(np.stack([x, y, far])[:, ~met])
        x, y, far = np.concatenate(out, axis=1)
        if closest and len(x):
            both, at = np.concatenate([x, y]), np.tile(np.arange(len(x)), 2)
            order = np.lexsort((at, far[at], both))
            first = np.unique(both[order], return_index=True)[1]
            take = np.unique(at[order[first]])
            x, y = x[take], y[take]
        low = node[x] < node[y]
        a, b = np.where(low, x, y), np.where(low, y, x)
        return pa.table({"a": node[a], "b": node[b], "n_a": n[a], "n_b": n[b]}, schema=_CELL)

    return run


def _apart(large: DataFrame, found: DataFrame, classes: DataFrame, percent: int, cell: int, closest: bool) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, n_a, n_b) of large blocks (shingle, node, n, pos) that can link and that found (node, label) doesn't connect;
    and the blocks that it leaves open, which are all that a later call needs, as components only grow."""
    labelled = large.join(found, "node", "left").select("shingle", "node", "n", "pos", F.coalesce("label", "node").alias("label"))
    open_ = labelled.groupBy("shingle").agg(F.count("*").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("shingle", F.ceil(F.col("m") / cell).cast("int").alias("sides"))
    members = common.keep(labelled.join(open_, "shingle"), "open")
    first = members.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("pos", "shingle"))), 1, EARLIER).alias("first"))
    first = first.select("node", F.col("first.pos").alias("at"), F.col("first.shingle").alias("blocks"))
    cells = members.join(_held(classes, members.select("node").distinct()).join(first, "node"), "node").withColumn("side", F.pmod(F.xxhash64("node"), F.col("sides")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1))).withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other"))
    pairs = cells.groupBy("shingle", "i", "j").applyInArrow(_cells(percent, closest), "a long, b long, n_a long, n_b long").distinct()
    return pairs, members.select("shingle", "node", "n", "pos")


def _counted(pairs: DataFrame, classes: DataFrame, hidden: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, n_a, n_b) of (a, b, shared) that the summed counts don't rule out.

    hidden (node, hidden): the entries of nodes in large blocks, which the counts leave out."""
    sizes = classes.select("node", "n").join(hidden, "node", "left").fillna(0, ["hidden"])
    for x in ("b", "a"):
        pairs = pairs.join(sizes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("hidden").alias(f"hidden_{x}")), x)
    rest = F.ceil(F.lit(percent) * F.greatest("n_a", "n_b") / 100) - 1
    most = F.col("shared") + F.least("hidden_a", "hidden_b") + rest
    return pairs.where(F.lit(100 + percent) * most >= F.lit(percent) * (F.col("n_a") + F.col("n_b"))).select("a", "b", "n_a", "n_b")


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, n_a, n_b) that the parity sketches don't rule out."""

    def side(x: str) -> DataFrame:
        return held.select(F.col("node").alias(x), F.col("parity").alias(f"p_{x}"))

    def folded(one: str, other: str) -> Column:
        halves = F.zip_with(F.slice(one, 1, F.size(other)), F.slice(one, F.size(other) + 1, F.size(other)), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(one) > F.size(other), halves).otherwise(F.col(one))

    held = _held(classes, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    one = pairs.join(side("b"), "b").join(side("a"), "a")
    total = F.col("n_a") + F.col("n_b")
    one = one.where(F.greatest(F.size("p_a"), F.size("p_b")) <= 2 * F.least(F.size("p_a"), F.size("p_b")))
    differ = F.aggregate(F.zip_with(folded("p_a", "p_b"), folded("p_b", "p_a"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return one.where(F.lit(100 + percent) * differ <= F.lit(100 - percent) * total).select("a", "b", "n_a", "n_b")


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The links (a, b, n_a, n_b, both) among pairs (a, b, n_a, n_b): partial counts of blocks of all shingles, summed by pair."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    bloom = pairs.sparkSession.sparkContext.broadcast(_bloom(wanted))
    sets = docs.mapInArrow(_sets(size, percent, bloom), "node long, level int, piece int, set array<long>").join(wanted, "node", "left_semi")
    sets = common.keep(sets.dropDuplicates(["node", "level", "piece"]), "sets")
    one = pairs.withColumn("level", F.greatest(_level_of("n_a"), _level_of("n_b")))
    one = one.withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr("shiftleft(1, level) - 1"))))
    for x in ("b", "a"):
        one = one.join(sets.select(F.col("node").alias(x), "level", "piece", F.col("set").alias(f"set_{x}")), [x, "level", "piece"])
    counts = one.withColumn("both", F.size(F.array_intersect("set_a", "set_b")).cast("long")).groupBy("a", "b", "n_a", "n_b").agg(F.sum("both").alias("both"))
    links = counts.where(F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("n_a") + F.col("n_b") - F.col("both")))
    links = common.keep(links, "links")
    common.drop(pairs.sparkSession, sets)
    bloom.unpersist()
    return links


class _Product(NamedTuple):
    """The first product of a table: its rows (doc_id, node, n), its distinct sets, entries of large blocks and pairs that may link."""

    docs: DataFrame
    rows: DataFrame
    classes: DataFrame
    large: DataFrame
    pairs: DataFrame
    scratch: list[DataFrame]


def _product(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, block: int, hot: int) -> _Product:
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    first = common.keep(docs.mapInArrow(_sizes(size), "kind byte, doc_id long, node long, n long, parity array<long>, piece int, counts binary"), "sizes")
    rows = first.where("kind = 0").select("doc_id", "node", "n")
    sketch = spark.sparkContext.broadcast(_sketch(first.where("kind = 1").select("piece", "counts")))
    classes = first.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("parity").alias("parity"))
    classes = common.keep(classes, "classes")

    entries = docs.mapInArrow(_entries(size, sketch, percent, hot), "shingle long, node long, n int, pos int, hot boolean")
    entries = entries.repartition(F.when(F.col("hot"), F.col("node")).otherwise(F.col("shingle"))).sortWithinPartitions("shingle", "node")
    met = common.keep(entries.mapInArrow(_blocks(percent, block), "shingle long, a long, b long, n int, pos int"), "blocks")
    large = met.where("b is null").select("shingle", F.col("a").alias("node"), "n", "pos")
    shared = large.withColumn("hidden", F.count("*").over(Window.partitionBy("node")))
    hidden = shared.groupBy("node").agg(F.first("hidden").alias("hidden"))
    centres = shared.groupBy("shingle").agg(F.max(F.struct("hidden", "node"))["node"].alias("centre"))
    stars = large.join(centres, "shingle").where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"), F.lit(0).alias("n"), F.lit(1).alias("pos"))
    sums = met.where("b is not null").select("a", "b", "n", "pos").unionByName(stars.distinct()).groupBy("a", "b").agg(F.sum("n").alias("shared"), F.sum("pos").alias("allowed"))
    counted = common.keep(_counted(sums.where("allowed > 0").drop("allowed"), classes, hidden, percent), "counted")
    pairs = common.keep(_near(counted, classes, percent), "pairs")
    return _Product(docs, rows, classes, large, pairs, [met, counted, pairs])


def overlaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, block: int = BLOCK, hot: int = HOT, cell: int = CELL) -> DataFrame:
    """(a, b, both, n_a, n_b): every link between two different sets of shingles with the number of shingles they share.

    a < b are the least ids of the rows that have these sets (null where none has an id; then the order is open). Large blocks
    are compared whole, in cells, so unlike join() this gives links within components too, and its cells test the square of a
    large block's nodes. Rows without words have no links; an empty table gives an empty table."""
    made = _product(docs, id_col, text_col, size, percent, block, hot)
    links = _verified(made.pairs, made.docs, size, percent)
    alone = made.classes.select("node", F.col("node").alias("label"))
    more, _ = _apart(made.large, alone, made.classes, percent, cell, False)
    more = common.keep(more.join(made.pairs, ["a", "b"], "left_anti"), "pairs")
    links = links.unionByName(_verified(more, made.docs, size, percent))
    common.drop(docs.sparkSession, *made.scratch, more)
    for x in ("a", "b"):
        links = links.join(made.classes.select(F.col("node").alias(x), F.col("least").alias(f"id_{x}")), x)
    swap = F.col("id_a") > F.col("id_b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return links.select(pick("id_a", "id_b").alias("a"), pick("id_b", "id_a").alias("b"), "both", pick("n_a", "n_b").alias("n_a"), pick("n_b", "n_a").alias("n_b"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, block: int = BLOCK, hot: int = HOT, cell: int = CELL) -> DataFrame:
    """(id, n_shingles, component_id, copies) for every row of docs.

    n_shingles: distinct shingles of size words; a text with fewer words is one shingle, a null, empty or blank one has
    none and stands alone. component_id: least id reachable over links of percent or more; copies: rows with an equal set.
    Columns of docs other than the two named are not read; a row with a null id has the least id that others of its component
    have, null if none has one; a repeated id counts once
    per distinct set, and its component is the least of them; an empty table gives an empty table."""
    made = _product(docs, id_col, text_col, size, percent, block, hot)
    rows, classes, tried = made.rows, made.classes, made.pairs.select("a", "b")
    links, scratch = _verified(made.pairs, made.docs, size, percent), made.scratch
    found, open_ = common.components(links), made.large
    for closest in (True, False):
        more, open_ = _apart(open_, found, classes, percent, cell, closest)
        more = common.keep(more.join(tried, ["a", "b"], "left_anti"), "pairs")
        scratch += [more, open_]
        if not more.isEmpty():
            links, tried = links.unionByName(_verified(more, made.docs, size, percent)), tried.unionByName(more.select("a", "b"))
            found = common.components(links)
    common.drop(docs.sparkSession, *scratch)

    least = classes.join(found, "node", "left").withColumn("group", F.coalesce("label", "node"))
    ids = least.groupBy("group").agg(F.min("least").alias("component_id"))
    least = least.join(ids, "group").select("node", "copies", "component_id")
    out = rows.join(least, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))
    return out.withColumnRenamed("doc_id", id_col)
