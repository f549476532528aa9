"""Suffix-array dedup: removes every byte covered by a string of SIZE bytes that also starts anywhere else.

All suffixes of a corpus needn't be sorted to find strings of SIZE bytes. Each window of SIZE bytes has an anchor: where its
block of BLOCK bytes of least hash begins. Equal windows have equal anchors, so it is enough to sort the suffixes that begin
at anchors (one in about 50 places), each with the windows it anchors: those that begin first .. last bytes before it.

1. A pass counts the anchor blocks (by hash, partial counts); only anchors whose block occurs twice go on.
2. A pass sorts these suffixes, cut at the end of their last window, into runs. Equal suffixes with equal windows within a run
   are one entry, whose windows are repeated at once. Runs are front-coded (length of the prefix shared with the entry
   before, and the rest), the bytes are compressed, and exchanged by block, so that equal blocks meet.
3. A task merges the runs of its blocks with a loser tree that knows, of every loser, the prefix it shares with the last
   output, and compares two entries only behind the longer known prefix. The prefixes shared by neighbours in the result are
   the suffix array's common-prefix array: for a window that begins t bytes before its anchor, entries between which no
   neighbour shares less than SIZE - t bytes agree to the right of the anchor. Those that also agree in the t bytes to the
   left (a rolling hash of 64 bits) hold the same window.
4. Blocks with more than HOT anchors would not fit a task. Their windows are compared one by one by a hash of 128 bits: a
   task settles regions and windows that occur twice in what it holds, and sends each different window once, packed in
   shards of the hash; a shard's windows meet in one task, SHARD of them on average.

Hashes of 64 bits decide only among the anchors of one run or one bucket, never among those of the corpus. The driver sees a
Bloom filter of blocks, of at most MOST_BITS bits: fuller filters let more suffixes through, no fewer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import common

SIZE, BLOCK = 200, 100
#: Anchors of a block beyond which its windows are counted one by one.
HOT = 50_000
#: Bits of the Bloom filter: 8 for each repeated block, between these.
LEAST_BITS, MOST_BITS = 1 << 24, 1 << 28
HOT_BITS = 1 << 22
#: Suffixes that a task sorts into one run, and about as many as meet in one bucket.
RUN, BUCKET = 50_000, 10_000
#: Buckets at least; those that one task merges, on average; anchors of hot blocks whose windows a task holds at once; windows of a shard.
BUCKETS, BUCKETS_A_TASK, HELD, SHARD = 48, 2, 5000, 500_000
#: Window starts of a very long text that are handled at once.
PIECE = 4 << 20

_RNG = np.random.Generator(np.random.PCG64(77))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_OTHER = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_S = 0xD1342543DE82EF95
_S_INV = pow(_S, -1, 1 << 64)
_LEFT = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_WINDOW = np.dtype([("one", np.uint64), ("two", np.uint64), ("doc", np.int64), ("hash", np.int64), ("start", np.int64), ("done", np.uint8)])
_META = np.dtype([("doc", np.int64), ("hash", np.int64), ("at", np.int64), ("first", np.uint8), ("last", np.uint8), ("done", np.uint8)])


class _Step:
    """The anchors of some texts: arrays over groups of neighbouring windows that share an anchor."""

    def __init__(self, texts: list[bytes], size: int, block: int):
        units = [(k, a, t[a : a + PIECE + size - 1]) for k, t in enumerate(texts) for a in range(0, max(0, len(t) - size + 1), PIECE)]
        self.data = b"".join(u[2] for u in units)
        data = np.frombuffer(self.data, np.uint8)
        n = len(data)
        self.n = n
        if not n:
            self.anchor = self.low = self.high = self.unit = np.zeros(0, np.int64)
            self.block = self.region = np.zeros(0, np.uint64)
            return
        lengths = np.array([len(u[2]) for u in units], np.int64)
        begin = np.cumsum(lengths) - lengths
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * common._powers(common._R, n), out=self.total[1:])
        back = common._powers(common._R_INV, n)
        m = n - block + 1
        hashes = common.mixed((self.total[block:] - self.total[:m]) * back[:m])
        least = (hashes & ~np.uint64(0xFFFFFFFF)) | np.arange(m, dtype=np.uint64)
        wide, width = size - block + 1, 1
        while 2 * width <= wide:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if wide > width:
            least = np.minimum(least[: len(least) - (wide - width)], least[wide - width :])
        unit = np.repeat(np.arange(len(units)), np.maximum(lengths - size + 1, 0))
        start = np.arange(len(unit)) - np.repeat(np.cumsum(np.maximum(lengths - size + 1, 0)) - np.maximum(lengths - size + 1, 0), np.maximum(lengths - size + 1, 0)) + begin[unit]
        at = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        self.anchor, self.low, self.high, unit = at[first], start[first], start[last], unit[first]
        self.block = hashes[self.anchor]
        region = (self.total[self.high + size] - self.total[self.low]) * back[self.low]
        self.region = common.mixed(region ^ common.mixed((self.anchor - self.low).astype(np.uint64) * np.uint64(1024) + (self.high - self.low).astype(np.uint64)))
        self.text = np.array([u[0] for u in units], np.int64)[unit]
        self.shift = np.array([u[1] for u in units], np.int64)[unit] - begin[unit]  # place in the text less place in data

    def second(self) -> np.ndarray:
        """Prefix sums of another polynomial."""
        out = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_OTHER[np.frombuffer(self.data, np.uint8)] * common._powers(_S, self.n), out=out[1:])
        return out


def _blocks(size: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in common.steps(batch.column(0), batch.column(2)):
                one, n = np.unique(_Step(texts, size, block).block, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(n)], names=["block", "n"])

    return run


def _filter(blocks: DataFrame, bits: int) -> np.ndarray:
    """A bit for each block; the driver gets bits / 64 words at most."""
    rows = blocks.selectExpr(f"cast(pmod(block, {bits}) div 64 as int) AS word", f"shiftleft(1L, cast(pmod(block, {bits}) % 64 as int)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return words.view(np.uint8)


def _has(filter_: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    bit = (blocks & np.uint64(8 * len(filter_) - 1)).astype(np.int64)
    return (filter_[bit >> 3] >> (bit & 7)) & 1 == 1


_FOUND = pa.schema([("kind", pa.int8()), ("bucket", pa.int64()), ("shared", pa.binary()), ("length", pa.binary()), ("rest", pa.binary()), ("left", pa.binary()), ("meta", pa.binary()), ("doc_id", pa.int64()), ("hash", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
_FOUND_DDL = "kind byte, bucket long, shared binary, length binary, rest binary, left binary, meta binary, doc_id long, hash long, start long, stop long"


def _found(**columns) -> pa.RecordBatch:
    n = max(len(c) for c in columns.values())
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _FOUND], schema=_FOUND)


def _spans(doc: np.ndarray, key: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of kind 1; touching spans of a text that follow each other are one."""
    if not len(doc):
        return
    order = np.lexsort((start, key, doc))
    doc, key, start, stop = doc[order], key[order], start[order], stop[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (start[1:] > stop[:-1])
    first = np.flatnonzero(new)
    yield _found(kind=np.ones(len(first), np.int8), doc_id=doc[first], hash=key[first], start=start[first], stop=np.maximum.reduceat(stop, first))


def _common(a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Shared prefixes of rows of two byte matrices, up to length."""
    differ = a != b
    first = differ.argmax(1)
    first[~differ.any(1)] = a.shape[1]
    return np.minimum(first, length)


def _twice(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows have an equal one among rows, and where the first of each kind stands (a done one, if any)."""
    by = np.lexsort((1 - rows["done"], rows["two"], rows["one"]))
    same = (rows["one"][by][1:] == rows["one"][by][:-1]) & (rows["two"][by][1:] == rows["two"][by][:-1])
    twice = np.zeros(len(rows), bool)
    twice[by[1:][same]] = True
    twice[by[:-1][same]] = True
    return twice, by[np.append(True, ~same)[: len(by)]]


def _shards(size: int):
    """The spans of windows that occur twice in a shard; the rows of a shard follow each other."""

    def given(parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows = np.frombuffer(b"".join(parts), _WINDOW)
        twice, _ = _twice(rows)
        new = twice & (rows["done"] == 0)
        yield from _spans(rows["doc"][new], rows["hash"][new], rows["start"][new], rows["start"][new] + size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts = None, []
        for batch in batches:
            for b, meta in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != shard and parts:
                    yield from given(parts)
                    parts = []
                shard = b
                parts.append(meta)
        if parts:
            yield from given(parts)

    return run


def _suffixes(filter_, hot, buckets: int, shards: int, size: int, block: int):
    def flush(parts: list[tuple], wide: int) -> Iterator[pa.RecordBatch]:
        region = np.concatenate([p[0].region[p[1]] for p in parts])
        _, one, which, many = np.unique(region, return_index=True, return_inverse=True, return_counts=True)
        doc, key, at, low, high, hashes = (np.concatenate([np.asarray(c) for c in cs]) for cs in zip(*((p[2], p[3], p[0].anchor[p[1]] + p[0].shift[p[1]], p[0].low[p[1]] + p[0].shift[p[1]], p[0].high[p[1]] + p[0].shift[p[1]], p[0].block[p[1]]) for p in parts), strict=True))
        again = many[which] > 1
        yield from _spans(doc[again], key[again], low[again], high[again] + size)
        offsets = np.cumsum([0, *(len(p[1]) for p in parts)])
        part = np.searchsorted(offsets, one, side="right") - 1
        strings, lefts = [], []
        for k, p in zip(one.tolist(), part.tolist(), strict=True):
            step, picked = parts[p][0], parts[p][1]
            i = picked[k - offsets[p]]
            a = int(step.anchor[i])
            strings.append(int(step.block[i]).to_bytes(8, "big") + step.data[a : int(step.high[i]) + size])
            lefts.append(step.data[int(step.low[i]) : a])
        bucket = (hashes[one] >> np.uint64(16)).astype(np.int64) % buckets
        order = np.array(sorted(range(len(strings)), key=strings.__getitem__), np.int64)
        order = order[np.argsort(bucket[order], kind="stable")]
        length = np.array([len(s) for s in strings], np.int64)
        matrix = np.array(strings, f"S{wide}").view(np.uint8).reshape(len(strings), wide)[order]
        near = np.zeros(len(order), np.int64)
        near[1:] = _common(matrix[1:], matrix[:-1], np.minimum(length[order][1:], length[order][:-1]))
        ordered = bucket[order]
        begin = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        near[begin] = 0
        meta = np.zeros(len(order), _META)
        pick = one[order]
        for c, v in (("doc", doc), ("hash", key), ("at", at), ("first", at - high), ("last", at - low), ("done", again)):
            meta[c] = v[pick]
        rows: list[list] = [[] for _ in range(6)]
        packed = zstandard.ZstdCompressor(level=3).compress
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(order)], strict=True):
            here = order[a:b].tolist()
            for c, v in zip(rows, (int(ordered[a]), near[a:b].astype(np.uint8).tobytes(), length[order[a:b]].astype(np.uint8).tobytes(), packed(b"".join(strings[k][s:] for k, s in zip(here, near[a:b].tolist(), strict=True))), packed(b"".join(lefts[k] for k in here)), meta[a:b].tobytes()), strict=True):
                c.append(v)
            if len(rows[0]) >= 512:
                yield _found(kind=np.zeros(len(rows[0]), np.int8), **dict(zip(("bucket", "shared", "length", "rest", "left", "meta"), rows, strict=True)))
                rows = [[] for _ in range(6)]
        if rows[0]:
            yield _found(kind=np.zeros(len(rows[0]), np.int8), **dict(zip(("bucket", "shared", "length", "rest", "left", "meta"), rows, strict=True)))

    def settled(step: _Step, picked: np.ndarray, doc: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Windows of anchors with hot blocks: spans of those met twice here (kind 1), and each different one (kind 2)."""
        _, one, which, many = np.unique(step.region[picked], return_index=True, return_inverse=True, return_counts=True)
        again = many[which] > 1
        shift = step.shift[picked]
        yield from _spans(doc[again], key[again], step.low[picked][again] + shift[again], step.high[picked][again] + shift[again] + size)
        repeated, picked, doc, key, shift = again[one], picked[one], doc[one], key[one], shift[one]
        many = step.high[picked] - step.low[picked] + 1
        start = np.repeat(step.low[picked], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        rows = np.zeros(len(start), _WINDOW)
        rows["one"] = common.mixed((step.total[start + size] - step.total[start]) * common._powers(common._R_INV, step.n)[start])
        total = step.second()
        rows["two"] = common.mixed((total[start + size] - total[start]) * common._powers(_S_INV, step.n)[start])
        rows["doc"], rows["hash"], rows["start"], rows["done"] = np.repeat(doc, many), np.repeat(key, many), start + np.repeat(shift, many), np.repeat(repeated, many)
        del start, total
        twice, first = _twice(rows)
        new = twice & (rows["done"] == 0)
        yield from _spans(rows["doc"][new], rows["hash"][new], rows["start"][new], rows["start"][new] + size)
        rows["done"][twice] = 1
        rows = rows[first]
        shard = (rows["one"] % np.uint64(shards)).astype(np.int64)
        by = np.argsort(shard, kind="stable")
        rows, shard = rows[by], shard[by]
        begin = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        packed = [rows[a:b].tobytes() for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(rows)], strict=True)]
        yield _found(kind=np.full(len(begin), 2, np.int8), bucket=shard[begin], meta=packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, very = filter_.value, hot.value
        wide, parts, held = 8 + size, [], 0
        for batch in batches:
            done = 0
            for ids, texts in common.steps(batch.column(0), batch.column(2)):
                key = batch.column(1).slice(done, len(ids)).to_numpy()
                doc = ids.fill_null(0).to_numpy()
                done += len(ids)
                step = _Step(texts, size, block)
                if not step.n:
                    continue
                again = _has(some, step.block)
                much = again & _has(very, step.block) if len(very) else np.zeros(len(again), bool)
                picked = np.flatnonzero(much)
                for few in np.array_split(picked, max(1, len(picked) // HELD)):
                    if len(few):
                        yield from settled(step, few, doc[step.text[few]], key[step.text[few]])
                step.total = None  # eight times the text; only windows need it
                picked = np.flatnonzero(again & ~much)
                if len(picked):
                    parts.append((step, picked, doc[step.text[picked]], key[step.text[picked]]))
                    held += len(picked)
                if held >= RUN:
                    yield from flush(parts, wide)
                    parts, held = [], 0
        if parts:
            yield from flush(parts, wide)

    return run


# ---------------------------------------------------------------- merging


def _compare(a: bytes, b: bytes, known: int) -> tuple[bool, int]:
    """Whether a comes first (also if equal), and their shared prefix; the first known bytes are not looked at."""
    m = min(len(a), len(b))
    if known < m and a[known] != b[known]:
        return a[known] < b[known], known
    x = int.from_bytes(a[known:m], "big") ^ int.from_bytes(b[known:m], "big")
    if not x:
        return len(a) <= len(b), m
    at = m - (x.bit_length() + 7) // 8
    return a[at] < b[at], at


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Merges sorted runs of (strings, prefix shared with the string before) with a loser tree.

    Gives run and place of each string in order, and the prefix it shares with the one before."""
    k = 1 << max(0, (len(runs) - 1).bit_length())
    place = [0] * k
    here: list = [r[0][0] if r[0] else None for r in runs] + [None] * (k - len(runs))
    known = [0] * k  # of each contender or loser, the prefix shared with the last output
    loser = [0] * k

    def play(x: int, y: int) -> tuple[int, int]:
        """Winner and loser of two contenders with equal known prefixes; the loser's becomes its prefix shared with the winner."""
        if here[y] is None:
            return x, y
        if here[x] is None:
            return y, x
        first, both = _compare(here[x], here[y], known[x])
        if first:
            known[y] = both
            return x, y
        known[x] = both
        return y, x

    level = list(range(k))
    node = k
    while len(level) > 1:  # from the leaves up: losers stay at nodes k - 1 .. 1
        node //= 2
        nxt = []
        for i in range(0, len(level), 2):
            w, lo = play(level[i], level[i + 1])
            loser[node + i // 2] = lo
            nxt.append(w)
        level = nxt
    winner = level[0]
    out_run, out_place, out_shared = [], [], []
    while here[winner] is not None:
        out_run.append(winner)
        out_place.append(place[winner])
        out_shared.append(known[winner])
        place[winner] += 1
        strings, shared = runs[winner]
        if place[winner] < len(strings):
            here[winner], known[winner] = strings[place[winner]], shared[place[winner]]
        else:
            here[winner], known[winner] = None, -1
        node = (winner + k) >> 1
        while node:
            other = loser[node]
            if here[other] is not None:
                if here[winner] is None or known[other] > known[winner]:
                    loser[node], winner = winner, other
                elif known[other] == known[winner]:
                    first, both = _compare(here[winner], here[other], known[winner])
                    if first:
                        known[other] = both
                    else:
                        known[winner] = both
                        loser[node], winner = winner, other
            node >>= 1
    return out_run, out_place, out_shared


def _unpacked(shared: bytes, length: bytes, rest: bytes) -> tuple[list[bytes], list[int]]:
    strings, at, last = [], 0, b""
    for s, n in zip(shared, length, strict=True):
        last = last[:s] + rest[at : at + n - s]
        at += n - s
        strings.append(last)
    return strings, list(shared)


def _repeated(rows: list[tuple], size: int, block: int) -> Iterator[pa.RecordBatch]:
    """The spans of repeated windows of one bucket, whose runs rows are."""
    runs = [_unpacked(*r[:3]) for r in rows]
    run, place, shared = merge(runs)
    meta = np.concatenate([np.frombuffer(r[4], _META) for r in rows])
    offset = np.cumsum([0, *(len(r[1]) for r in rows)])
    order = offset[np.array(run, np.int64)] + np.array(place, np.int64)
    shared = np.array(shared, np.int64) - 8
    near = shared >= block
    grouped = near.copy()
    grouped[:-1] |= near[1:]
    picked = np.flatnonzero(grouped)
    if not len(picked):
        return
    entry = order[picked]
    group = np.cumsum(~near)[picked]
    shared = np.where(near, shared, -1)[picked]
    item = meta[entry]
    left = b"".join(r[3] for r in rows)
    last = meta["last"].astype(np.int64)
    end = np.cumsum(last)[entry]
    source = np.frombuffer(left + b"\0", np.uint8)
    hashes = np.zeros(len(entry), np.uint64)
    power = np.uint64(1)
    low, high = np.full(len(entry), 255, np.int64), np.full(len(entry), -1, np.int64)
    first, last = item["first"].astype(np.int64), item["last"].astype(np.int64)
    del group
    for t in range(size - block + 1):
        if t:
            power = np.uint64((int(power) * common._R) & (2**64 - 1))
            byte = source[np.maximum(end - t, 0)]
            hashes = hashes + np.where(last >= t, _LEFT[byte] * power, np.uint64(0))
        valid = np.flatnonzero((first <= t) & (t <= last))
        if len(valid) < 2:
            continue
        right = np.cumsum(shared < size - t)[valid].astype(np.uint64)
        key = common.mixed(common.mixed(right) ^ hashes[valid])
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        twice = np.zeros(len(by), bool)
        twice[:-1] |= same
        twice[1:] |= same
        hit = valid[by[twice]]
        low[hit] = np.minimum(low[hit], t)
        high[hit] = np.maximum(high[hit], t)
    ok = (high >= 0) & (item["done"] == 0)
    yield from _spans(item["doc"][ok], item["hash"][ok], item["at"][ok] - high[ok], item["at"][ok] - low[ok] + size)


def _merged(size: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows, unpacked = None, [], zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for b, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "shared", "length", "rest", "left", "meta")), strict=True):
                if b != bucket and rows:
                    yield from _repeated(rows, size, block)
                    rows = []
                bucket = b
                shared, length, rest, left, meta = row
                rows.append((shared, length, unpacked(rest), unpacked(left), meta))
        if rows:
            yield from _repeated(rows, size, block)

    return run


def repeated_spans(docs: DataFrame, size: int = SIZE, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """(doc_id, hash, start, stop): byte spans of repeated windows, for rows of docs (doc_id, hash, text)."""
    spark = docs.sparkSession
    counts = docs.mapInArrow(_blocks(size, block), "block long, n long").groupBy("block").agg(F.sum("n").alias("n")).where("n > 1")
    counts = common.keep(counts, "blocks")
    anchors, blocks = counts.agg(F.sum("n"), F.count("*")).first()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * (blocks or 1)).bit_length()))
    some = spark.sparkContext.broadcast(_filter(counts, bits))
    many = counts.where(F.col("n") > hot)
    crowd = many.agg(F.sum("n")).first()[0] or 0
    very = spark.sparkContext.broadcast(_filter(many, HOT_BITS) if crowd else np.zeros(0, np.uint8))
    buckets = max(BUCKETS, (anchors or 0) // BUCKET)
    shards = max(1, crowd * (size - block) // SHARD)
    found = common.keep(docs.mapInArrow(_suffixes(some, very, buckets, shards, size, block), _FOUND_DDL), "suffixes")
    # so many tasks that what one reads doesn't grow with the input
    runs = found.where("kind = 0").select("bucket", "shared", "length", "rest", "left", "meta").repartition(buckets // BUCKETS_A_TASK, "bucket").sortWithinPartitions("bucket")
    spans = runs.mapInArrow(_merged(size, block), _FOUND_DDL).unionByName(found.where("kind = 1"))
    if crowd:
        windows = found.where("kind = 2").select("bucket", "meta").repartition(shards, "bucket").sortWithinPartitions("bucket")
        spans = spans.unionByName(windows.mapInArrow(_shards(size), _FOUND_DDL))
    spans = common.keep(spans.select("doc_id", "hash", "start", "stop"), "spans")
    common.drop(spark, found, counts)
    return spans


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            b = text.as_py()
            parts, at, removed, n = [], 0, 0, 0
            for s in sorted((x["start"], x["stop"]) for x in spans or ()):
                if s[0] > at or not n:
                    parts.append(b[at : s[0]])
                    n += 1
                    removed += s[1] - s[0]
                    at = s[1]
                elif s[1] > at:
                    removed += s[1] - at
                    at = s[1]
            parts.append(b[at:])
            for c, v in zip(out, (len(b), removed, n, hashlib.sha256(b"".join(parts)).hexdigest()), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def digests(docs: DataFrame, size: int = SIZE, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs (doc_id, text).

    Null texts are empty; texts of fewer than size bytes lose nothing; a repeated row loses all that is size bytes long, as
    its copy does; null ids stay null; other columns aren't read; an empty table gives an empty table."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    spans = repeated_spans(rows, size, block, hot).groupBy("doc_id", "hash").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = rows.withColumn("_id", F.coalesce("doc_id", F.lit(0))).join(spans.withColumnRenamed("doc_id", "_id"), ["_id", "hash"], "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
