"""Spelling variants: words that differ by one code point, found in bidirectional FM-indexes of the vocabulary.

Words are runs of LETTERS, A-Z lowered; for tests, one code point of each run with crc32("<id>:<run>") divisible by THINNED
is deleted first. Words of LEAST_LENGTH code points or more that occur LEAST_TIMES or more in all texts are the vocabulary.

Of two words that differ by one code point, halves of one occur in the other: either the right half ends it too, or the left
half begins it too. So words are dealt to shards by half: a word asks in the shard of its left half and of its right half,
and stands in the shards of the prefixes and suffixes of the lengths that such halves have. A shard of more than SPLIT words
is cut into blocks, each asked by all of the shard's askers.

In a block the words, between delimiters, make a text with a Burrows-Wheeler transform in a wavelet matrix. A search matches
a half exactly, from its end of the word, and goes on across the other half with one error: at each place the symbols that
the suffix-rank interval really holds are replaced, inserted, or the word's own is skipped; then it goes on exactly up to
the delimiter. Extending to the left uses the transform of the text, extending to the right that of the reversed text; both
keep the interval of the other direction in step, so the rank of "delimiter, word, delimiter" numbers the word. All words of a
block move together in numpy. A pair that both halves find counts where the right half does.

Each asker gives one row a block (number of near words, best of them), so no pairs leave a task. Forms grow tenfold in number
each, so roots need at most as many steps as the greatest count has digits; they are doubled.

Null and empty texts have no words; a null id counts as empty in the hash; repeated rows count each; ties go to the smallest
word in code-point order; other columns are not read; an empty table gives no rows."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import common

LETTERS = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_TIMES, RATIO, THINNED = 7, 2, 10, 31
#: Words of a shard on average, and of a block at most (about).
SHARD, SPLIT = 8000, 60000
#: Searches that move together.
TOGETHER = 4000
#: Distinct words that a task holds before it gives their counts.
HELD = 200_000


# ---------------------------------------------------------------- vocabulary


def _counter(least: int, thinned: int | None):
    runs = re.compile(LETTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        give = lambda: pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})
        for batch in batches:
            for ids, texts in common.steps(batch.column(0), batch.column(1)):
                for i, text in zip(ids.to_pylist(), texts, strict=True):
                    own, front = Counter(runs.findall(text.lower().decode())), b"%s:" % (i or "").encode()
                    for word, n in own.items():
                        if len(word) < least:
                            continue
                        if thinned and (h := zlib.crc32(word.encode(), zlib.crc32(front))) % thinned == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least:
                                continue
                        total[word] += n
                if len(total) > HELD:
                    yield give()
                    total.clear()
        if total:
            yield give()

    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_times: int = LEAST_TIMES, thinned: int | None = THINNED) -> DataFrame:
    """(word, n). thinned=None deletes nothing."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_counter(least_length, thinned), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_times)


# ---------------------------------------------------------------- index


class Wavelet:
    """Ranks in a sequence of symbols: one bit a level, zeros before ones."""

    def __init__(self, seq: np.ndarray, symbols: int) -> None:
        self.levels = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        now = seq
        for level in reversed(range(self.levels)):
            bits = (now >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bits)]).astype(np.int32))
            self.zeros.append(len(now) - int(self.ones[-1][-1]))
            now = np.concatenate([now[bits == 0], now[bits == 1]])
        self.begins = self._down(np.arange(symbols), np.zeros(symbols, np.int64), np.zeros(symbols, np.int64))[0]

    def _down(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        less = np.zeros(len(lo), np.int64)
        for k in range(self.levels):
            bit = (c >> (self.levels - 1 - k)) & 1
            lo1, hi1 = self.ones[k][lo].astype(np.int64), self.ones[k][hi].astype(np.int64)
            less += np.where(bit == 1, (hi - lo) - (hi1 - lo1), 0)
            lo, hi = np.where(bit == 1, self.zeros[k] + lo1, lo - lo1), np.where(bit == 1, self.zeros[k] + hi1, hi - hi1)
        return lo, hi, less

    def rank(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many c stand before lo and before hi, and how many smaller symbols from lo to hi."""
        a, b, less = self._down(c, lo, hi)
        return a - self.begins[c], b - self.begins[c], less

    def distinct(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in lo, symbol) for each symbol that stands from lo to hi."""
        of, c = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        for k in range(self.levels):
            lo1, hi1 = self.ones[k][lo].astype(np.int64), self.ones[k][hi].astype(np.int64)
            z, o = (hi - hi1) > (lo - lo1), hi1 > lo1
            lo, hi = np.concatenate([(lo - lo1)[z], (self.zeros[k] + lo1)[o]]), np.concatenate([(hi - hi1)[z], (self.zeros[k] + hi1)[o]])
            of, c = np.concatenate([of[z], of[o]]), np.concatenate([c[z] * 2, c[o] * 2 + 1])
        return of, c


def _transform(text: np.ndarray) -> np.ndarray:
    """The symbols before the sorted rotations of a text, by doubled prefixes."""
    n, rank, step = len(text), text.astype(np.int64), 1
    while True:
        key = rank * (int(rank.max()) + 1) + np.roll(rank, -step)
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        if rank[order[-1]] == n - 1:
            return text[(order - 1) % n]
        step *= 2


class BiIndex:
    """A bidirectional FM-index over distinct words: text "$w1$w2...", its symbols code points by rank, $ = 0. A transform is
    built when its direction is first used."""

    def __init__(self, words: list[str]) -> None:
        self.words = sorted(words)
        points = np.frombuffer("\0".join(["", *self.words]).encode("utf-32-le"), np.uint32)
        self.alphabet, text = np.unique(points, return_inverse=True)
        self._text, self._wave = text.astype(np.int64), {}
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.alphabet)))])

    def wave(self, left: bool) -> Wavelet:
        if left not in self._wave:
            self._wave[left] = Wavelet(_transform(self._text if left else self._text[::-1].copy()), len(self.alphabet))
        return self._wave[left]

    def everything(self, n: int) -> np.ndarray:
        """n intervals of all suffixes: rows (start, start in the reversed text, size)."""
        return np.stack([np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, len(self._text))])

    def extend(self, iv: np.ndarray, c: np.ndarray, left: bool) -> np.ndarray:
        """The intervals of c + pattern (left) or pattern + c; size 0 where there is none. c < 0 stands for no symbol."""
        known = np.maximum(c, 0)
        here, other = (iv[0], iv[1]) if left else (iv[1], iv[0])
        a, b, less = self.wave(left).rank(known, here, here + iv[2])
        new, size = self.first[known] + a, np.where(c >= 0, b - a, 0)
        return np.stack([new, other + less, size] if left else [other + less, new, size])

    def symbols(self, iv: np.ndarray, left: bool) -> tuple[np.ndarray, np.ndarray]:
        """(place, symbol) of all symbols but $ that extend each interval."""
        here = iv[0] if left else iv[1]
        of, c = self.wave(left).distinct(here, here + iv[2])
        return of[c > 0], c[c > 0]


def near(index: BiIndex, askers: list[str], left: bool) -> tuple[np.ndarray, np.ndarray]:
    """(asker, word of the index) for every two that differ by one code point, the asker's right half (left: its left half if
    not) standing unchanged at that end of both."""
    lengths = np.array([len(w) for w in askers])
    exact = lengths - lengths // 2 if left else lengths // 2
    points = np.frombuffer("".join(w[::-1] if left else w for w in askers).encode("utf-32-le"), np.uint32)
    at = np.searchsorted(index.alphabet, points)
    at = np.where(index.alphabet[np.minimum(at, len(index.alphabet) - 1)] == points, at, -1)
    codes = np.full((len(askers), lengths.max() + 1), 0, np.int64)  # ends with $
    codes[np.arange(codes.shape[1]) < lengths[:, None]] = at

    who = np.arange(len(askers))
    iv = index.extend(index.everything(len(askers)), np.zeros(len(askers), np.int64), left)
    pool = []
    for t in range(int(lengths.max()) + 1):
        on = t >= exact[who]  # past the exact half: an error here
        w, i = who[on], iv[:, on]
        of, c = index.symbols(i, left)
        wrong = index.extend(i[:, of], c, left)
        pool.append((w[of], np.full(len(of), t), wrong))  # one more
        inner = lengths[w[of]] > t
        other = inner & (c != codes[w[of], np.minimum(t, lengths[w[of]])])
        pool.append((w[of][other], np.full(int(other.sum()), t + 1), wrong[:, other]))  # another
        less = lengths[w] > t
        pool.append((w[less], np.full(int(less.sum()), t + 1), i[:, less]))  # one less
        more = lengths[who] > t
        who = who[more]
        iv = index.extend(iv[:, more], codes[who, t], left)
        who, iv = who[iv[2] > 0], iv[:, iv[2] > 0]
    who, done, iv = (np.concatenate([p[k] for p in pool], axis=-1) for k in range(3))
    out = []
    while len(who):
        iv = index.extend(iv, codes[who, done], left)
        alive = iv[2] > 0
        ended = alive & (done == lengths[who])
        out.append(np.stack([who[ended], iv[0][ended]]))
        alive &= ~ended
        who, done, iv = who[alive], done[alive] + 1, iv[:, alive]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.unique(np.concatenate(out, axis=1), axis=1)
    return pairs[0], pairs[1]


# ---------------------------------------------------------------- the operator


_FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _searched(part: pa.Table) -> pa.Table:
    left = part.column("side")[0].as_py() == "right"  # with the right half known, the search goes to the left
    rows = list(zip(*(part.column(c).to_pylist() for c in ("word", "n", "asks", "held")), strict=True))
    n = {word: k for word, k, _, held in rows if held}
    askers = [word for word, _, asks, _ in rows if asks]
    if not n or not askers:
        return _FOUND.empty_table()
    index = BiIndex(list(n))
    counts = np.array([n[w] for w in index.words], np.int64)
    out = []
    for k in range(0, len(askers), TOGETHER):
        some = askers[k : k + TOGETHER]
        a, b = near(index, some, left)
        if not left:  # the right half stands unchanged too: the other side's pair
            own = np.fromiter((not index.words[y].endswith(some[x][len(some[x]) // 2 :]) for x, y in zip(a.tolist(), b.tolist(), strict=True)), bool, len(a))
            a, b = a[own], b[own]
        order = np.lexsort((b, -counts[b], a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
        out.append(pa.table([[some[x] for x in a[first]], np.diff(np.append(first, len(a))), counts[b[first]], [index.words[y] for y in b[first]]], schema=_FOUND))
    return pa.concat_tables(out).combine_chunks()


def near_words(words: DataFrame, shard_words: int = SHARD, split: int = SPLIT) -> DataFrame:
    """(word, n_near, best, best_n) for each of words (word, n) that has near ones among them; words is read several times."""
    total = words.count()
    shards = max(1, -(-4 * total // shard_words))
    n = F.length("word")
    whole = lambda c: c.cast("int")
    spots = lambda side, halves, own: F.transform(F.array_distinct(F.array(*halves)), lambda h: F.struct(F.lit(side).alias("side"), h.alias("half"), (h == own).alias("asks")))
    lower, upper = (lambda k: whole(F.floor(k / 2))), (lambda k: whole(F.ceil(k / 2)))
    dealt = words.select("word", "n", F.explode(F.concat(spots("left", [lower(n - 1), lower(n), lower(n + 1)], lower(n)), spots("right", [upper(n - 1), upper(n), upper(n + 1)], upper(n)))).alias("s"))
    half = F.when(F.col("s.side") == "left", F.expr("left(word, s.half)")).otherwise(F.expr("right(word, s.half)"))
    dealt = dealt.select("word", "n", "s.side", "s.asks", F.pmod(F.xxhash64(F.col("s.side"), half), F.lit(shards)).alias("shard"))
    dealt = dealt.groupBy("word", "n", "side", "shard").agg(F.max("asks").alias("asks"))
    dealt = common.keep(dealt, "words-dealt")
    blocks = dealt.groupBy("side", "shard").agg(F.ceil(F.count("*") / split).cast("int").alias("blocks"))
    cut = dealt.join(blocks, ["side", "shard"]).withColumn("home", F.pmod(F.xxhash64("word"), F.col("blocks")))
    every = F.when(F.col("asks"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - F.lit(1).cast("long"))).otherwise(F.array("home"))
    placed = cut.select("word", "n", "side", "shard", "asks", "home", F.explode(every).alias("block")).withColumn("held", F.col("home") == F.col("block")).drop("home")
    found = placed.groupBy("side", "shard", "block").applyInArrow(_searched, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.m")).alias("best_n"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO, least_length: int = LEAST_LENGTH, least_times: int = LEAST_TIMES, thinned: int | None = THINNED, shard_words: int = SHARD, split: int = SPLIT) -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word of the vocabulary, its near word with the largest count if that is at
    least ratio times its own, and the word at the end of the forms."""
    words = common.keep(vocabulary(docs, id_col, text_col, least_length, least_times, thinned), "words")
    known = words.join(near_words(words, shard_words, split), "word", "left")
    ok = F.col("best_n") >= ratio * F.col("n")
    formed = common.keep(known.select("word", F.when(ok, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(ok, F.col("best_n")).alias("form_n")), "forms")
    greatest = formed.agg(F.max("n")).first()[0] or 1
    links = formed.where("form is not null").select("word", F.col("form").alias("root"))
    steps = max(1, math.ceil(math.log(max(greatest, 2), ratio)))  # forms follow each other so often at most
    for _ in range(max(0, math.ceil(math.log2(steps)))):
        links = common.keep(links.join(links.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return formed.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
