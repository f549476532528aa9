"""Best-fit packing of token documents into sequences by non-negative least squares.

1. Documents become token ids, an end id last; only those longer than a sequence are cut. The table of pieces is written
   once, with the partition each piece came from.
2. The histogram of piece lengths (as many bins as a sequence has tokens, whatever the corpus) reaches the driver. There,
   patterns that fill a sequence exactly are enumerated (all of up to three documents, and all of one length repeated with
   one other), repeat counts are fitted to the histogram by non-negative least squares and rounded, and what they leave is
   packed best fit, longest first, with counts instead of pieces.
3. The plan is a list of runs "the pieces of length l from rank r on go to the sequences from s on, at offset o". Ranks
   within a length come from counts by partition; each task looks its pieces up.
"""

from __future__ import annotations

import array
import bisect
import functools
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import common

#: Bytes that the chunks a worker remembers, and their ids, may take (with ENTRY for each); beyond, only those that occur again at once are kept.
REMEMBERED, ENTRY = 24 << 20, 200
#: Words of letters that are encoded as one text.
TOGETHER = 2000
#: Rounds of the least-squares fit.
ROUNDS = 120


@functools.lru_cache(2)
def _tokenizers(path: str):
    """The tokenizer; one of the same vocabulary that takes words as they are; and of each id whether it ends a word."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer, pre_tokenizers

    model = Tokenizer.from_file(path)
    plain = Tokenizer(model.model)
    plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    ends = np.zeros(model.get_vocab_size() + 1, bool)
    ends[[i for token, i in model.get_vocab().items() if token.endswith("</w>")]] = True
    return model, plain, ends


_SPACE, _LETTER, _DIGIT, _SYMBOL, _OTHER = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[33:127] = _SYMBOL
_KIND[39] = _OTHER  # an apostrophe binds letters
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER


def _chunks(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct chunks, the chunk at each place of all texts, and where each text begins among the places (one more at the
    end). The ids of a text are those of its chunks: this vocabulary lowers letters, drops white space and merges nothing
    across it, nor between ASCII letters, digits and symbols. White space alone cuts texts that may hold a special token;
    their chunks with "<|" are not lowered."""
    special = [b"<|" in t for t in texts]
    ready = [b" ".join([w if b"<|" in w else w.lower() for w in t.split()]) if s else t.lower() for t, s in zip(texts, special, strict=True)]
    data = np.frombuffer(b" ".join([*ready, b""]), np.uint8)  # a space ends each text
    bounds = np.cumsum([0, *map(len, ready)]) + np.arange(len(ready) + 1)
    kind = _KIND[data]
    for k, s in enumerate(special):
        if s:
            part = kind[bounds[k] : bounds[k + 1]]
            part[part != _SPACE] = _OTHER
    inside = kind != _SPACE
    first = np.empty(len(data), bool)  # where a chunk begins; the first place has none before it
    first[:1] = inside[:1]
    left, right = kind[:-1], kind[1:]
    first[1:] = inside[1:] & ((left == _SPACE) | ((left != right) & (left < _OTHER) & (right < _OTHER)) | ((left == _DIGIT) & (right == _DIGIT)))
    starts = np.flatnonzero(first)
    before = np.cumsum(inside, dtype=np.int32) - inside  # bytes other than white space before each place
    offsets = np.append(before[starts], inside.sum()).astype(np.int32)
    if not len(starts):
        return [], np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    all_chunks = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    coded = all_chunks.dictionary_encode()
    _, ends, raw = coded.dictionary.buffers()
    ends, raw = np.frombuffer(ends, np.int32)[: len(coded.dictionary) + 1].tolist(), raw.to_pybytes()
    return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], coded.indices.to_numpy(), np.searchsorted(starts, bounds)


def _encoded(path: str, chunks: list[bytes]) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """The chunks and their ids as bytes. Short Latin words, which are one pre-token each and need no normalizing, are
    encoded as one text and told apart by the ids that end words; all other chunks are encoded one by one."""
    model, plain, ends = _tokenizers(path)
    words = [c for c in chunks if len(c) <= 64 and c.isalpha()]
    other = [(c, c.decode()) for c in chunks if len(c) > 64 or not c.isalpha()]
    latin = [len(c) <= 64 and t.isalpha() and max(t) < "\u0250" and t == t.lower() for c, t in other]
    words += [c for (c, _), plainly in zip(other, latin, strict=True) if plainly]
    alone = [x for x, plainly in zip(other, latin, strict=True) if not plainly]
    for k in range(0, len(words), TOGETHER):
        part = words[k : k + TOGETHER]
        ids = np.array(plain.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, np.uint32)
        stop = 4 * (np.flatnonzero(ends[ids]) + 1)
        if len(stop) != len(part):
            raise ValueError("the vocabulary at " + path + " does not end words as a vocabulary with word ends does")
        raw, stop = ids.tobytes(), stop.tolist()
        yield part, [raw[a:b] for a, b in zip([0, *stop], stop, strict=False)]
    for k in range(0, len(alone), TOGETHER):
        part = alone[k : k + TOGETHER]
        coded = model.encode_batch_fast([t for _, t in part], add_special_tokens=False)
        yield [c for c, _ in part], [array.array("I", x.ids).tobytes() for x in coded]


def _pieces(path: str, end_id: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        end, held = np.uint32(end_id).tobytes(), 0
        for batch in batches:
            for ids, raw in common.steps(batch.column(0), batch.column(1)):
                distinct, place, bounds = _chunks(raw)
                if held > REMEMBERED:
                    known = {w: known[w] for w in distinct if w in known}
                    held = sum(map(len, known)) + sum(map(len, known.values())) + ENTRY * len(known)
                for chunks, coded in _encoded(path, [w for w in distinct if w not in known]):
                    known.update(zip(chunks, coded, strict=True))
                    held += sum(map(len, chunks)) + sum(map(len, coded)) + ENTRY * len(chunks)
                coded = [*map(known.__getitem__, distinct)]
                size_of = np.array([*map(len, coded)], np.int64) // 4
                vocabulary = np.frombuffer(b"".join(coded), np.uint32)
                many = size_of[place]
                until = np.concatenate([[0], np.cumsum(many)])
                tokens = vocabulary[np.repeat((np.cumsum(size_of) - size_of)[place] - until[:-1], many) + np.arange(until[-1])].tobytes()
                at = (4 * until[bounds]).tolist()
                out: list[list] = [[], [], [], [], []]
                for doc_id, a, b in zip(ids.to_pylist(), at[:-1], at[1:], strict=True):
                    for k, c in enumerate(range(a, b + 4, 4 * size)):  # the end id follows the text's
                        part = tokens[c : min(b, c + 4 * size)]
                        if c + 4 * size > b:
                            part += end
                        for column, x in zip(out, (doc_id, k, (c - a) // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """Rows (a, times a, b, c): multisets of the lengths that sum to size, c and b zero where absent.

    All of up to three lengths, and all of one length repeated with one other: about size squared / 12 and size log size."""
    there = np.zeros(size + 1, bool)
    there[lengths[lengths <= size]] = True
    found = [np.array([(size, 1, 0, 0)], np.int64)] if there[size] else []
    for c in np.flatnonzero(there[: size // 3 + 1]).tolist():
        b = np.arange(c, (size - c) // 2 + 1)
        b = b[there[b] & there[size - c - b]]
        found.append(np.stack([size - c - b, np.ones_like(b), b, np.full_like(b, c)], 1))
    for a in np.flatnonzero(there[: size // 2 + 1]).tolist():
        times = np.arange(1, size // a + 1)
        rest = size - a * times
        # three and fewer documents are listed above, but for the pairs
        ok = there[rest] | (rest == 0)
        ok &= np.where(times == 1, True, times + (rest > 0) > 3) & ~((times == 1) & (rest < a))
        found.append(np.stack([np.full_like(times, a), times, rest, np.zeros_like(times)], 1)[ok])
    return np.concatenate(found) if found else np.zeros((0, 4), np.int64)


def fit(lengths: np.ndarray, counts: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 with the least squares of (documents used - histogram), by accelerated projected gradients."""
    many = len(found)
    row = np.concatenate([found[:, 0], found[:, 2], found[:, 3]])
    column, each = np.tile(np.arange(many), 3), np.concatenate([found[:, 1], np.ones(2 * many, np.int64)])
    column, each = column[row > 0], each[row > 0]
    row = np.searchsorted(lengths, row[row > 0])
    weight = 1 / np.sqrt(np.maximum(counts, 1.0))
    target = counts * weight
    entry = weight[row] * each
    per_row = np.bincount(row, weights=entry, minlength=len(lengths))
    scale = 1 / np.maximum(np.bincount(column, weights=entry * per_row[row], minlength=many), 1e-12)  # by Gershgorin's bound
    x = np.zeros(many)
    y, t = x, 1.0
    for _ in range(ROUNDS):
        short = np.bincount(row, weights=entry * y[column], minlength=len(lengths)) - target
        new = np.maximum(0, y - scale * np.bincount(column, weights=entry * short[row], minlength=many))
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        x, y = new, new + (last - 1) / t * (new - x)
    return x


def rounded(repeats: np.ndarray) -> np.ndarray:
    """Whole repeats whose sums along the patterns follow those of repeats: each takes what its forerunners' rounding left."""
    return np.diff(np.floor(np.cumsum(repeats) + 1e-9), prepend=0.0).astype(np.int64)


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, end rank, first sequence, offset) that place every piece of the histogram once."""
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[n] for n in lengths.tolist()], np.int64)
    left = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    used: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int]] = []
    sequence = 0

    def place(pattern: tuple[int, ...], times: int) -> None:
        nonlocal sequence
        offset = 0
        for n in pattern:
            runs.append((n, used[n], used[n] + times, sequence, offset))
            used[n] += times
            left[n] -= times
            offset += n
        sequence += times

    found = patterns(lengths, size)
    if len(found):
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        repeats = rounded(fit(lengths, counts.astype(float), found))
        for k in np.flatnonzero(repeats).tolist():
            a, many, b, c = found[k].tolist()
            pattern = (a,) * many + tuple(n for n in (b, c) if n)
            times = int(repeats[k])
            for n in set(pattern):
                times = min(times, left[n] // pattern.count(n))
            if times > 0:
                place(pattern, times)
    # best fit of what is left, longest first; open sequences with equal contents are one entry (room, contents): count
    open_: dict[int, list[list]] = defaultdict(list)
    rooms: list[int] = []
    for n in sorted((n for n in left if left[n]), reverse=True):
        while left[n]:
            k = bisect.bisect_left(rooms, n)
            if k == len(rooms):
                fits = size // n
                many = left[n] // fits
                for contents, times in (((n,) * fits, many), ((n,) * (left[n] - many * fits), 1)):
                    if contents and times:
                        left[n] -= times * len(contents)
                        _put(open_, rooms, size - n * len(contents), [contents, times])
                continue
            room = rooms[k]
            entry = open_[room][-1]
            fits = min(room // n, left[n])
            times = min(entry[1], left[n] // fits)
            entry[1] -= times
            if not entry[1]:
                open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(k)
            left[n] -= times * fits
            _put(open_, rooms, room - n * fits, [(*entry[0], *(n,) * fits), times])
    for room in sorted(open_):
        for contents, times in open_[room]:
            for n in contents:
                left[n] += times
            place(contents, times)
    return runs


def _put(open_: dict[int, list[list]], rooms: list[int], room: int, entry: list) -> None:
    if room not in open_:
        bisect.insort(rooms, room)
    open_[room].append(entry)


def _assigned(runs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = runs.value  # sorted by (length, first rank)
        key = table[:, 0] * (1 << 40) + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, length * (1 << 40) + rank, side="right") - 1
            out = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.RecordBatch.from_pydict(out | {"sequence_id": pa.array(table[at, 3] + rank - table[at, 1]), "offset": pa.array(table[at, 4])})

    return run


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece of each document.

    A null, empty or blank text is the end id alone; repeated rows are packed each; equal lengths take sequences in the
    order of their partitions; other columns aren't read; an empty table gives an empty table."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.mapInArrow(_pieces(path, end_id, size), "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = common.keep(rows.withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id()), "pieces")
    by_part = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most size rows
    table = np.array(sorted(plan(histogram, size)) or [(0, 0, 0, 0, 0)], np.int64)
    # a run for each pattern and place in it: bounded by the patterns and by size, not by the corpus
    runs = spark.sparkContext.broadcast(table)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "part", "base")
    ranked = rows.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.row_number().over(Window.partitionBy("length", "part").orderBy("nth")) - 1)
    out = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_assigned(runs), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("doc_id", id_col)
