"""Lines that many documents repeat, dropped in all of them but one.

A line's key is the line without the white space at its ends, A-Z lowered; keys of LEAST_CHARS code points or more that
LEAST_DOCS documents or more hold lose their lines in all documents but the one with the largest id.

1. Each task counts the documents of its keys (a key counts once a document) by 128-bit hash; sums meet by hash.
2. The keys that are frequent enough are dealt to shards of about SHARD keys. Each shard becomes a minimal perfect hash
   (levels of bits; keys that meet on a bit go on to the next level; a key's number is the rank of its bit) that numbers
   arrays of 64-bit fingerprints, counts and largest ids. Position and fingerprint together see all 128 bits.
3. Documents probe the arrays. While these are within `bound` bytes every task has all of them; beyond it, packed hashes of
   blocks of documents go to the shards and only the hits come back to the documents. Shards and blocks are read as
   streams, one shard or block in memory, and a line counts once a block however often it stands there.

Null ids count as less than all ids (several rows with the least id keep their lines); each row is a document, so repeated
rows count each, and rows that share the largest id all keep the line. A null or empty text is one empty line. Columns
n_lines and n_dropped of the input are replaced; all others stay. An empty table gives no rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tessella.llm import common

LEAST_CHARS, LEAST_DOCS = 40, 5
#: Keys of a shard, on average.
SHARD = 1 << 16
#: Bytes of arrays that go to every task; more are exchanged by shard.
BOUND = 64 << 20
#: Rows whose probes travel together beyond the bound.
BLOCK = 1024
SPACE = b" \t\n\v\f\r"
NO_ID = -(1 << 63)
_COUNTED = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("docs", pa.int64()), ("last", pa.int64())])


def _hashes(lines: list[bytes], least: int) -> list[bytes | None]:
    """The 128-bit hash of each line's key, None where the key is too short."""
    out = []
    for line in lines:
        key = line.strip(SPACE).lower()  # of bytes, only A-Z
        n = len(key)
        if n < least or (n < 4 * least and not key.isascii() and len(key.decode()) < least):
            out.append(None)
        else:
            out.append(xxhash.xxh3_128_digest(key))
    return out


def _pairs(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _counter(least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in common.steps(batch.column(0), batch.column(1)):
                found, holders = [], []
                for i, text in zip(_ids(ids).tolist(), texts, strict=True):
                    if len(text) >= least:
                        own = set(_hashes(text.split(b"\n"), least)) - {None}
                        found.extend(own)
                        holders.extend([i] * len(own))
                if not found:
                    continue
                keys, last = _pairs(found), np.array(holders, np.int64)
                order = np.lexsort((keys[:, 1], keys[:, 0]))
                keys, last = keys[order], last[order]
                first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
                n = np.diff(np.append(first, len(keys)))
                yield pa.RecordBatch.from_pydict({"h1": keys[first, 0].view(np.int64), "h2": keys[first, 1].view(np.int64), "docs": n, "last": np.maximum.reduceat(last, first)}, schema=_COUNTED)

    return run


# ---------------------------------------------------------------- a shard


def _place(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    return (common.mixed(h1 ^ common.mixed(h2 + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))) % np.uint64(size)).astype(np.int64)


def build(h1: np.ndarray, h2: np.ndarray, docs: np.ndarray, last: np.ndarray) -> dict[str, bytes]:
    """A minimal perfect hash over distinct keys (h1, h2) and the arrays that it numbers, as bytes."""
    sizes, words, places, rest, base = [], [], np.zeros(len(h1), np.int64), np.arange(len(h1)), 0
    while len(rest):
        size = (2 * len(rest) + 64) // 64 * 64
        at = _place(h1[rest], h2[rest], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        words.append(np.packbits(alone, bitorder="little").view(np.uint64))
        placed = alone[at]
        places[rest[placed]] = base + at[placed]
        rest, base = rest[~placed], base + size
        sizes.append(size)
    order = np.argsort(places)  # a bit's rank is the key's number
    return {"sizes": np.array(sizes, np.int64).tobytes(), "words": b"".join(w.tobytes() for w in words), "prints": h2[order].tobytes(), "counts": docs[order].astype(np.uint32).tobytes() if not len(docs) or docs.max() < 1 << 32 else docs[order].astype(np.uint64).tobytes(), "lasts": last[order].tobytes()}


PARTS = ("sizes", "words", "prints", "counts", "lasts")


class Shard:
    """What build() made, for probes."""

    def __init__(self, sizes: bytes, words: bytes, prints: bytes, counts: bytes, lasts: bytes) -> None:
        self.sizes = np.frombuffer(sizes, np.int64).tolist()
        self.words = np.frombuffer(words, np.uint64)
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.prints, self.lasts = np.frombuffer(prints, np.uint64), np.frombuffer(lasts, np.int64)
        self.counts = np.frombuffer(counts, np.uint32 if len(counts) == 4 * len(self.lasts) else np.uint64)

    def number(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Each key's number, -1 for keys that the shard doesn't hold."""
        out, rest, base = np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes):
            at = base + _place(h1[rest], h2[rest], level, size)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            out[rest[hit]] = self.ranks[at[hit] >> 6] + np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            rest, base = rest[~hit], base + size
        held = np.flatnonzero(out >= 0)
        out[held[self.prints[out[held]] != h2[held]]] = -1
        return out


def _shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    return (h1 % np.uint64(shards)).astype(np.int64)


def probe(keys: np.ndarray, shards: int, load: Callable[[int], Shard | None]) -> dict[bytes, int]:
    """The largest id by digest, of those keys (rows of two 64-bit words) that a shard holds."""
    of, out = _shard_of(keys[:, 0], shards), {}
    order = np.argsort(of, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else []:
        shard = load(int(of[part[0]]))
        if shard is not None:
            k = np.ascontiguousarray(keys[part])
            n = shard.number(k[:, 0], k[:, 1])
            out.update(zip((r.tobytes() for r in k[n >= 0]), shard.lasts[n[n >= 0]].tolist(), strict=True))
    return out


# ---------------------------------------------------------------- the operator


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(h1, h2, docs, last): hashes of the keys that least_docs documents or more hold, how many, and the largest id."""
    counted = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_counter(least_chars), "h1 long, h2 long, docs long, last long")
    return counted.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("last").alias("last")).where(F.col("docs") >= least_docs)


def index(repeated: DataFrame, shard_keys: int = SHARD) -> tuple[DataFrame, int]:
    """(shard and the arrays of build()) for a table of repeated_lines, written once, and the number of shards."""
    repeated = common.keep(repeated, "lines")
    shards = max(1, -(-repeated.count() // shard_keys))

    def made(table: pa.Table) -> pa.Table:
        a = [table.column(c).to_numpy() for c in ("h1", "h2", "docs", "last")]
        return pa.table({"shard": [table.column("shard")[0].as_py()], **{k: [v] for k, v in build(a[0].view(np.uint64), a[1].view(np.uint64), a[2], a[3]).items()}})

    # an unsigned remainder: the same shard as numpy's
    shard = F.pmod(F.pmod(F.shiftrightunsigned("h1", 1), F.lit(shards)) * 2 + F.col("h1").bitwiseAND(1), F.lit(shards))
    made_of = repeated.withColumn("shard", shard).groupBy("shard").applyInArrow(made, "shard long, " + ", ".join(f"{p} binary" for p in PARTS))
    return common.keep(made_of, "line-shards"), shards


def _rewrite(texts: list[bytes], ids: list[int], least: int, found: Callable[[list[list[bytes | None]]], dict[bytes, int]]) -> tuple[list[str], list[int], list[int]]:
    lines = [t.split(b"\n") for t in texts]
    hashes = [_hashes(own, least) for own in lines]
    last = found(hashes)
    kept = [[x for x, h in zip(own, hs, strict=True) if h is None or last.get(h, i) == i] for own, hs, i in zip(lines, hashes, ids, strict=True)] if last else lines
    return [b"\n".join(k).decode() for k in kept], [len(own) for own in lines], [len(own) - len(k) for own, k in zip(lines, kept, strict=True)]


def _columns(batch: pa.RecordBatch, names: list[str], at: int, texts: list[str], n: list[int], dropped: list[int], schema: pa.Schema) -> pa.RecordBatch:
    columns = [batch.column(c) for c in names] + [pa.array(n, pa.int64()), pa.array(dropped, pa.int64())]
    columns[at] = pa.array(texts, schema.field(at).type)
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, bound: int = BOUND, shard_keys: int = SHARD) -> DataFrame:
    """docs with the repeated lines taken out of the text, n_lines (before) and n_dropped."""
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    table, shards = index(repeated_lines(docs, id_col, text_col, least_chars, least_docs), shard_keys)
    fields = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    out = docs.withColumn("n_lines", F.lit(0).cast("long")).withColumn("n_dropped", F.lit(0).cast("long")).schema
    arrow, names, at = to_arrow_schema(out), docs.columns, docs.columns.index(text_col)
    size = table.agg(F.sum(sum((F.octet_length(p) for p in PARTS), F.lit(0)))).first()[0] or 0
    ids_texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), fields)

    if size <= bound:
        arrays = spark.sparkContext.broadcast({r["shard"]: tuple(bytes(r[p]) for p in PARTS) for r in table.toLocalIterator()})

        def by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loaded = {k: Shard(*v) for k, v in arrays.value.items()}
            look = lambda hashes: probe(_pairs(list({h for own in hashes for h in own if h})), shards, loaded.get)
            for batch in batches:
                done = 0
                doc = pa.RecordBatch.from_struct_array(batch.column(2))
                for ids, texts in common.steps(batch.column(0), batch.column(1)):
                    part = _rewrite(texts, _ids(ids).tolist(), least_chars, look)
                    yield _columns(doc.slice(done, len(texts)), names, at, *part, arrow)
                    done += len(texts)

        return ids_texts.mapInArrow(by_task, out)

    rows = common.keep(ids_texts.withColumn("_block", F.floor(F.monotonically_increasing_id() / BLOCK)), "line-docs")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            for block in np.unique(blocks).tolist():
                at_ = np.flatnonzero(blocks == block)
                texts = [(batch.column(1)[int(k)].as_py() or "").encode() for k in at_]
                keys = _pairs(list({h for t in texts for h in _hashes(t.split(b"\n"), least_chars) if h}))
                of = _shard_of(keys[:, 0], shards)
                there = np.unique(of)
                yield pa.RecordBatch.from_pydict({"shard": there, "block": np.full(len(there), block), "probes": [keys[of == s].tobytes() for s in there]}, schema=pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("probes", pa.binary())]))

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = -1, None
        for batch in batches:
            blocks, hits = [], []
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in ("shard", "block", "probes")}
                if row["block"] is None:
                    now, shard = row["shard"], Shard(*(batch.column(p)[r].as_py() for p in PARTS))
                elif row["shard"] == now:
                    k = np.frombuffer(row["probes"], np.uint64).reshape(-1, 2)
                    n = shard.number(k[:, 0].copy(), k[:, 1].copy())
                    held = np.column_stack([k[n >= 0], shard.lasts[n[n >= 0]].view(np.uint64)])
                    if len(held):
                        blocks.append(row["block"])
                        hits.append(held.tobytes())
            yield pa.RecordBatch.from_pydict({"_block": blocks, "_hits": hits}, schema=pa.schema([("_block", pa.int64()), ("_hits", pa.binary())]))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            blocks, is_hit = batch.column("_block").to_pylist(), batch.column("_hits").is_valid().to_pylist()
            r = 0
            while r < len(blocks):
                if blocks[r] != now:
                    now, held = blocks[r], {}
                if is_hit[r]:
                    k = np.frombuffer(batch.column("_hits")[r].as_py(), np.uint64).reshape(-1, 3)
                    held.update(zip((x.tobytes() for x in np.ascontiguousarray(k[:, :2])), k[:, 2].view(np.int64).tolist() if k[:, 2].flags.c_contiguous else k[:, 2].copy().view(np.int64).tolist(), strict=True))
                    r += 1
                    continue
                end = r
                while end < len(blocks) and blocks[end] == now and not is_hit[end]:
                    end += 1
                part = batch.slice(r, end - r)
                doc = pa.RecordBatch.from_struct_array(part.column("doc"))
                done = 0
                for ids, texts in common.steps(part.column("_id"), part.column("_text")):
                    yield _columns(doc.slice(done, len(texts)), names, at, *_rewrite(texts, _ids(ids).tolist(), least_chars, lambda _, held=held: held), arrow)
                    done += len(texts)
                r = end

    asked = rows.select("_block", "_text").mapInArrow(packed, "shard long, block long, probes binary")
    met = table.unionByName(asked, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", F.col("block").asc_nulls_first())
    hits = met.mapInArrow(answered, "_block long, _hits binary")
    both = hits.unionByName(rows, allowMissingColumns=True).repartition("_block").sortWithinPartitions("_block", F.col("_hits").isNull())
    return both.mapInArrow(merged, out)


def digests(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256): what without_repeated_lines leaves of each row."""
    out = without_repeated_lines(docs.select("doc_id", "text"), **settings)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
