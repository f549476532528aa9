"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

Features of a whole text come from a table of its distinct tokens: densities of a fixed and of a learned lexicon, lexicon
words near second-person words, capitals, punctuation and obfuscation (symbols or digits for letters, undone before the
lexicons are asked). Labels are used in three disjoint parts of the training rows: one gives the learned lexicon (word
counts by Spark), one the trees, one the calibration; so neither sees words picked to fit it. Trees and calibration are
fitted on the driver; all three use at most SAMPLE labelled rows. Scores run in the tasks over all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import common

#: Labelled rows at most from which lexicon, trees and calibration are fitted, those of least hash. It bounds what is
#: broadcast, written and sent to the driver, whatever the input.
SAMPLE = 60_000
#: Entries of the learned lexicon at most; how often one must occur in toxic rows, by their number; its least log odds.
LEXICON, SUPPORT, ODDS = 500, 0.03, 1.5
#: Letters of the word beginnings ("^ab...") that can be entries beside whole words.
STEMS = (3, 4, 5, 6)
#: Tokens between a lexicon word and a second-person word that count as near.
NEAR = 5
#: Trees, their depth, learning rate, bins a feature, least rows in a leaf.
TREES, DEPTH, RATE, BINS, LEAF = 60, 3, 0.2, 32, 5
#: Tokens that a worker remembers; beyond, only those that occur again at once are kept.
REMEMBERED = 250_000

#: Insults and slurs against ability or worth, in the four languages.
INSULTS = frozenset("idiot idiots moron morons stupid dumb loser losers trash garbage scum worthless pathetic disgusting clown clowns imbecile fool vermin filth jerk creep idioten dumm dummkopf abschaum trottel versager wertlos widerlich idiote imbécile stupide crétin minable ordure déchet abruti estúpido idiota imbécil basura inútil patético escoria asqueroso payaso".split())
#: Second-person words of the four languages.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine euch euer ihr tu te toi ton ta tes vous votre vos tú usted ustedes vosotros os vuestro tus".split())
#: Symbols and digits that stand for letters.
LEET = str.maketrans("013457@$!+|", "oleastasiti")
_LEET = frozenset("013457@$!+|")
_CORE = re.compile(r"^[\W_]*(.*?)[\W_]*$", re.S)
_INNER = re.compile(r"[^\W\d_][^\w\s'’\-]+[^\W\d_]|[^\W\d_]\d+[^\W\d_]")
FEATURES = ("fixed", "learned", "strongest", "hits", "near", "hidden", "upper", "shout", "exclaim", "question", "punctuation", "obfuscated", "second", "digits", "log_tokens")


def _weight(word: str, lexicon: dict[str, float]) -> float:
    return max([lexicon.get(word, 0.0), *(lexicon.get("^" + word[:k], 0.0) for k in STEMS if len(word) > k)])


def _token(raw: str, lexicon: dict[str, float]) -> tuple:
    """fixed, learned weight, hit, hidden hit, second person, obfuscated, all capitals, upper, exclaim, question, punctuation, digits, characters."""
    low = raw.lower()
    core = _CORE.match(low).group(1)
    plain = core.isalpha()
    parts = [core] if plain or not core else [core, *re.split(r"[\W_]+", core)]
    fixed = any(p in INSULTS for p in parts)
    weight = max(_weight(p, lexicon) for p in parts)
    odd = not plain and bool(core) and bool(_INNER.search(core))
    hidden = False
    if not fixed and not low.isalpha() and (not plain or low[0] in _LEET) and any(map(str.isalpha, low)):
        for p in {re.sub(r"[^\w]+", "", low.translate(LEET)), re.sub(r"[\W_]+", "", core), _CORE.match(low).group(1).translate(LEET)}:
            if p not in parts and (p in INSULTS or p in lexicon):
                hidden, weight = True, max(weight, lexicon.get(p, 0.0))
    upper = 0 if raw == low else sum(map(str.isupper, raw))
    if raw.isalpha():
        letters, digits, marks = len(raw), 0, 0
    else:
        letters, digits = sum(map(str.isalpha, raw)), sum(map(str.isdigit, raw))
        marks = len(raw) - sum(map(str.isalnum, raw))
    return (fixed, weight, fixed or weight > 0 or hidden, hidden, core in SECOND, odd, letters > 2 and upper == letters, upper, raw.count("!"), raw.count("?"), marks, digits, len(raw))


def _quick(raw: str, lexicon: dict[str, float]) -> tuple:
    """What _token gives, sooner for letters with full stops, commas, colons and semicolons after them."""
    core = raw.rstrip(".,;:")
    low = core.lower()
    if not low.isalpha():
        return _token(raw, lexicon)
    weight = lexicon.get(low, 0.0)
    for k in STEMS:
        if len(low) > k and (stem := lexicon.get("^" + low[:k], 0.0)) > weight:
            weight = stem
    fixed = low in INSULTS
    upper = 0 if core == low else sum(map(str.isupper, core))
    return (fixed, weight, fixed or weight > 0, False, low in SECOND, False, upper > 2 and upper == len(core), upper, 0, 0, len(raw) - len(core), 0, len(raw))


class Extractor:
    """Features of texts; remembers tokens between calls, a bounded number of them."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.known: dict[str, int] = {}
        self.table = np.zeros((1 << 14, 13), np.float32)

    def _learn(self, new: list[str]) -> None:
        at, total = len(self.known), len(self.known) + len(new)
        if total > len(self.table):
            bigger = np.zeros((1 << total.bit_length(), 13), np.float32)
            bigger[:at] = self.table[:at]
            self.table = bigger
        self.known.update(zip(new, range(at, total), strict=True))
        if new:
            self.table[at:total] = [_quick(w, self.lexicon) for w in new]

    def __call__(self, texts: list[str]) -> np.ndarray:
        split = [t.split() for t in texts]
        distinct = set().union(*split)
        if len(self.known) > REMEMBERED:
            again = [w for w in distinct if w in self.known]
            self.table[: len(again)] = self.table[[self.known[w] for w in again]]
            self.known = dict(zip(again, range(len(again)), strict=True))
        self._learn([w for w in distinct if w not in self.known])
        n = np.array([len(s) for s in split], np.int64)
        ids = np.fromiter((k for s in split for k in map(self.known.__getitem__, s)), np.int32, int(n.sum()))
        end = np.cumsum(n)
        begin = end - n
        owner = np.repeat(np.arange(len(n), dtype=np.int32), n)
        # column by column, so that a step holds a few numbers for each token at once
        sums = np.stack([np.bincount(owner, weights=self.table[ids, c], minlength=len(n)) for c in range(13)], 1)
        hit = np.flatnonzero(self.table[ids, 2] > 0)
        second = np.concatenate([[0], np.cumsum(self.table[ids, 4] > 0)])
        close = second[np.minimum(hit + NEAR + 1, end[owner[hit]])] - second[np.maximum(hit - NEAR, begin[owner[hit]])] > 0
        near = np.bincount(owner[hit], weights=close, minlength=len(n))
        strongest = np.zeros(len(n))
        np.maximum.at(strongest, owner[hit], self.table[ids[hit], 1].astype(np.float64))
        tokens, chars = np.maximum(n, 1), np.maximum(sums[:, 12], 1)
        return np.stack([sums[:, 0] / tokens, sums[:, 1] / tokens, strongest, np.log1p(sums[:, 2]), near / tokens, sums[:, 3] / tokens, sums[:, 7] / chars, sums[:, 6] / tokens, sums[:, 8] / chars, sums[:, 9] / chars, sums[:, 10] / chars, sums[:, 5] / tokens, sums[:, 4] / tokens, sums[:, 11] / chars, np.log1p(n)], axis=1)


# ---------------------------------------------------------------- trees and calibration


@dataclass
class Model:
    """Trees as arrays of DEPTH levels; scores are calibrated and lie in 0..1."""

    lexicon: dict[str, float] = field(default_factory=dict)
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    knots: tuple[np.ndarray, np.ndarray] = (np.array([0.0]), np.array([0.5]))

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, cut, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """The isotonic value, and a thousandth of the plain one so that plateaus keep their order."""
        raw = self.raw(x)
        return np.clip(0.999 * np.interp(raw, *self.knots) + 0.001 / (1 + np.exp(-raw)), 0.0, 1.0)


def boost(x: np.ndarray, y: np.ndarray) -> tuple[float, list]:
    """Newton boosting of the log loss with complete trees over binned features."""
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    edges = [np.unique(np.quantile(c[c != 0], np.linspace(0, 1, BINS)[1:-1])) if (c != 0).any() else np.array([0.0]) for c in x.T]
    edges = [np.unique(np.append(e, 0.0)) for e in edges]
    binned = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)], 1)
    width = BINS + 2
    f, trees = np.full(len(y), base), []
    nodes = 2**DEPTH - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, cut, at = np.zeros(nodes, np.int64), np.full(nodes, np.inf), np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, many = 2**level - 1, 2**level
            best = np.zeros(many)
            split = np.full(many, width)
            for j in range(x.shape[1]):
                key = (at - first) * width + binned[:, j]
                sums = [np.bincount(key, weights=w, minlength=many * width).reshape(many, width).cumsum(1) for w in (g, h, np.ones(len(y)))]
                (gl, hl, nl), (ga, ha, na) = sums, [s[:, -1:] for s in sums]
                gain = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
                gain[(nl < LEAF) | (na - nl < LEAF)] = 0
                top = gain.argmax(1)
                better = gain[np.arange(many), top] > best + 1e-12
                best = np.where(better, gain[np.arange(many), top], best)
                feature[first : first + many][better] = j
                split[better] = top[better]
            for k in range(many):
                e = edges[feature[first + k]]
                cut[first + k] = e[split[k]] if split[k] < len(e) else np.inf
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > cut[at])
        at -= nodes
        leaf = RATE * np.bincount(at, weights=g, minlength=nodes + 1) / (np.bincount(at, weights=h, minlength=nodes + 1) + 1)
        f = f + leaf[at]
        trees.append((feature, cut, leaf))
    return base, trees


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the isotonic regression of y on raw, by pooling neighbours that are out of order."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []
    for r, v in zip(raw[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1.0, r, r])
        while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            s, n, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], hi]
    x = np.array([v for b in blocks for v in (b[2], b[3])])
    return x, np.array([b[0] / b[1] for b in blocks for _ in (0, 1)])


# ---------------------------------------------------------------- Spark


def _features(lexicon: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = Extractor(lexicon)
        for batch in batches:
            for ids, raw in common.steps(batch.column(0), batch.column(1)):
                x = extract([b.decode() for b in raw])
                yield pa.RecordBatch.from_arrays([ids, pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["row", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model of label_col from the rows of labels (doc_id, label) that docs (doc_id, text) holds.

    Null labels and ids are left out. Several labels of one id count once, by their majority (1 on ties), so at most sample
    rows are broadcast however often an id is repeated; of several texts of one id the trees take that of least hash. With
    one class or none the score is its rate."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    known = common.keep(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "labels")
    bucket = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("part")), F.lit(10))
    part = F.when(bucket < 3, "lexicon").when(bucket < 8, "trees").otherwise("calibration")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(known), "doc_id").withColumn("part", part)  # at most sample labels
    rows = common.keep(rows, "labelled")
    seen = rows.where("part = 'lexicon'")
    sizes = {r["label"]: r["n"] for r in seen.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    lexicon: dict[str, float] = {}
    if bad and good:
        words = seen.dropDuplicates(["text", "label"]).select("label", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{2,}"), F.lit(0))).alias("word"))
        words = words.groupBy("word").agg(F.sum("label").alias("b"), F.sum(1 - F.col("label")).alias("g"))
        all_bad, all_good = words.agg(F.sum("b"), F.sum("g")).first()
        stems = [F.when(F.char_length("word") > k, F.concat(F.lit("^"), F.substring("word", 1, k))) for k in STEMS]
        units = words.select(F.explode(F.array_compact(F.array("word", *stems))).alias("word"), "b", "g").groupBy("word").agg(F.sum("b").alias("b"), F.sum("g").alias("g"))
        odds = F.log((F.col("b") + 0.5) / ((all_bad or 0) + 1)) - F.log((F.col("g") + 0.5) / ((all_good or 0) + 1))
        found = units.where(F.col("b") >= max(5, SUPPORT * bad)).select("word", "b", odds.alias("odds")).where(F.col("odds") > ODDS).orderBy(F.desc(F.col("odds") * F.sqrt("b")), "word").limit(LEXICON)
        lexicon = {r["word"]: round(r["odds"] * 1024) / 1024 for r in found.collect()}  # so that sums are exact in any order
    model = Model(lexicon)
    used = rows.where("part <> 'lexicon'")
    x = used.select(F.struct("doc_id", "label", "part", F.xxhash64("text").alias("hash")).alias("row"), "text").mapInArrow(_features(lexicon), "row struct<doc_id:long,label:int,part:string,hash:long>, x array<double>")
    least = x.groupBy("row.doc_id", "row.label", "row.part").agg(F.min(F.struct("row.hash", "x")).alias("least"))
    got = least.select("part", "label", "least.x").toArrow()  # at most sample rows
    if not got.num_rows:
        return model
    y, kind = got.column("label").to_numpy().astype(float), np.array(got.column("part").to_pylist())
    z = np.array(got.column("x").to_pylist(), float)
    order = np.lexsort(z.T[::-1])  # rows come in any order; sums in the trees shall not depend on it
    y, kind, z = y[order], kind[order], z[order]
    trees, rest = kind == "trees", kind == "calibration"
    if len(np.unique(y[trees])) < 2:
        model.knots = (np.array([0.0]), np.array([y.mean()]))
        return model
    model.base, model.trees = boost(z[trees], y[trees])
    if len(np.unique(y[rest])) < 2:
        rest = trees
    model.knots = isotonic(model.raw(z[rest]), y[rest])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row of docs; null and empty texts have features of 0 and are scored too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # LEXICON words and TREES trees at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        extract = Extractor(m.lexicon)
        for batch in batches:
            for ids, raw in common.steps(batch.column(0), batch.column(1)):
                yield pa.RecordBatch.from_arrays([ids, pa.array(m.score(extract([b.decode() for b in raw])))], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(doc_id: Column) -> Column:
    """Whether a row's label is for testing only: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classified(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs, from the labels that aren't held out."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))), sample=sample)
    rows = score(docs, model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def kept(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs without the rows that are scored 0.5 or more; equal ids have equal fates only if their texts have."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))), sample=sample)
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = Extractor(shared.value.lexicon)
        for batch in batches:
            done = 0
            for ids, raw in common.steps(batch.column(at), batch.column(at)):
                clean = shared.value.score(extract([b.decode() for b in raw])) < 0.5
                yield batch.slice(done, len(ids)).filter(pa.array(clean))
                done += len(ids)

    return docs.mapInArrow(run, docs.schema)
