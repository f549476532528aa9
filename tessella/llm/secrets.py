"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control. DataFrame functions only.

Base spans come from three patterns (assign, access, hex). The battery looks at further runs of 20 and more encoding
characters; a run that is of no one encoding (NAME=value, a path before a key) is cut into its longest stretches of either
base64 alphabet, each with the '=' that end it. Of each, the encoding is inferred (hex, base32, base64) and three tests are
made, each a normal score that is about 0 for random characters and falls the less random they are:

* chi-squared uniformity over the encoding's alphabet,
* runs of character classes (lower, upper, digit, other),
* circular lag-1 serial correlation of the codes, of either sign.

A candidate that decodes (hex or base64) to UTF-8 without control characters is encoded text, no secret, and takes no part:
20 random characters do so by chance in fewer than one of 3,000 cases as hex and one of 100,000 as base64.

Their sum is the candidate's score. The null hypothesis is "made of words or numbers, no secret". Its law is measured, not
assumed: every document gives one artificial token, of one of FORMS by its hash, from words of a window of its own text whose
place goes by its hash (identifiers in camel case without and with numbers, paths, upper-case names, decimal numbers), which passes the same tests. Mean and spread of
their scores by form, encoding and length make a p-value of a score: the largest over the forms, so the form
that is most like a secret counts, and dependence between the three tests is in it. Few documents are helped by PRIOR, the
same figures of a typical corpus, which count as WEIGHT tokens.

Short candidates score less clearly, so each stratum of encoding and length has its own Benjamini-Hochberg threshold at level
FDR, from a histogram of scores over all documents. Thresholds and laws (a few dozen rows) reach the driver, nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import common

#: False-discovery level.
FDR = 0.01
#: The kinds in their order.
KINDS = ("assign", "access", "hex", "random")
#: The words of an assignment.
WORDS = ("password", "passwd", "secret", "token", "api_?key")
#: Alphabet size, and share of neighbours of different classes among random characters (from the classes' sizes).
ENCODINGS = {"hex": (16, 2 * 10 * 6 / 16**2), "base32": (32, 2 * 26 * 6 / 32**2), "base64": (64, 1 - (26**2 + 26**2 + 10**2 + 2**2) / 64**2)}
#: Forms of the artificial tokens, with their encoding.
FORMS = {"camel": "base64", "numbered": "base64", "path": "base64", "upper": "base32", "decimal": "hex"}
#: Characters of the window that an artificial token's words are from.
WINDOW = 512
#: What decoded text doesn't hold: control characters that aren't white space.
CONTROL = r"[\x00-\x08\x0E-\x1F\x7F]"
#: Words of an artificial token, one of these by the text's hash; words are of 3 to 12 ASCII letters.
WORDS_OF, WORD = (4, 7, 14, 28), "[A-Za-z]{3,12}"
#: Fall of the mean score for each character, and spread for each root of the length (in 1 / STEPS), of each form in prose of
#: four languages; and the number of artificial tokens that these count as in each stratum.
PRIOR = {"camel": (3.0, 3.3), "numbered": (2.3, 3.2), "path": (4.4, 3.9), "upper": (3.0, 3.2), "decimal": (2.6, 2.5)}
WEIGHT = 30
#: Length classes are quarters of powers of two: 4 n for 2^n characters. The last holds all longer candidates, whose law
#: lies further from random still.
SHORTEST, LONGEST = 17, 31
#: Scores are counted in steps of 1 / STEPS.
STEPS = 8

_LETTERS = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "|".join(WORDS))
ASSIGN = rf"""(?:{_LETTERS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
#: A candidate of one encoding, and the stretches of the other ones.
WHOLE = "^([A-Za-z0-9+/]+|[A-Za-z0-9_-]+)=*$"
HEXED = "^([0-9a-f]+|[0-9A-F]+)$"
STRETCHES = tuple(f"[{c}]{{20,}}(?:=++(?![A-Za-z0-9+/_-]))?" for c in ("A-Za-z0-9+/", "A-Za-z0-9_-"))
_NONE = "array<string>"


def _bound(value: Column, use) -> Column:
    """use(value) where value is evaluated once, however often use names it."""
    return F.get(F.transform(F.array(value), use), 0)


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda s, x: s + x)


def _running(lengths: Column) -> Column:
    """Sums of all earlier elements, by blocks of 64, so that very many elements don't cost their square."""
    last = F.floor((F.size(lengths) - 1) / 64).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(lengths, b * 64 + 1, 64))
    before = F.aggregate(blocks, F.array(F.lit(0).cast("long")), lambda out, x: F.concat(out, F.array(F.element_at(out, -1) + _sum(x))))
    within = lambda b, block: F.transform(block, lambda _, i: b + _sum(F.slice(block, 1, i)))
    return F.flatten(F.zip_with(F.slice(before, 1, last + 1), blocks, within))


def _found(df: DataFrame, name: str, pattern: str, kind: int, least: int = 0) -> DataFrame:
    """df with column name: the spans of pattern in column text, those kept whose group 1 has least characters."""
    there = F.col("text").rlike(pattern)
    none = F.array().cast(_NONE)
    df = df.withColumns({"_m": F.when(there, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none), "_p": F.when(there, F.split("text", pattern, -1)).otherwise(none), "_g": F.when(there, F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).otherwise(none) if least else none})
    size = lambda c: F.transform(c, lambda x: F.char_length(x).cast("long"))
    df = df.withColumns({"_n": size(F.col("_m")), "_p": size(F.col("_p")), "_g": size(F.col("_g"))})
    # the k-th match starts after k + 1 pieces and k matches
    df = df.withColumn("_both", F.zip_with(F.slice("_p", 1, F.size("_n")), "_n", lambda p, n: p + n))
    spans = F.zip_with(F.arrays_zip(_running(F.col("_both")).alias("at"), F.slice("_p", 1, F.size("_n")).alias("p")), F.arrays_zip("_n", "_m", "_g"), lambda a, b: F.struct((a["at"] + a["p"]).alias("start"), F.lit(kind).alias("kind"), (a["at"] + a["p"] + b["_n"]).alias("end"), b["_m"].alias("text"), b["_g"].alias("value")))
    spans = F.when(F.size("_n") > 0, spans).otherwise(F.array().cast("array<struct<start:long,kind:int,end:long,text:string,value:long>>"))
    if least:
        spans = F.filter(spans, lambda s: s["value"] >= least)
    return df.withColumn(name, spans).drop("_m", "_p", "_g", "_n", "_both")


def _is_text(token: Column) -> Column:
    """Whether a token decodes to text: hex by pairs of digits, base64 of either alphabet with or without its '='."""
    bare = F.translate(token, "-_=", "+/")
    whole = F.char_length(bare) - F.when(F.char_length(bare) % 4 == 1, 1).otherwise(0)
    padded = F.rpad(F.substring(bare, F.lit(1), whole), F.ceil(whole / 4).cast("int") * 4, F.lit("="))
    pairs = F.substring(token, F.lit(1), F.floor(F.char_length(token) / 2).cast("int") * 2)
    decoded = F.when(token.rlike(HEXED), F.unhex(pairs)).when(token.rlike(WHOLE), F.unbase64(padded)).cast("string")
    return _bound(decoded, lambda t: F.coalesce(F.is_valid_utf8(t) & ~t.rlike(CONTROL), F.lit(False)))


def _encoding(token: Column) -> Column:
    return F.when(_is_text(token), F.lit(None)).when(token.rlike(HEXED), "hex").when(token.rlike("^[A-Z2-7]+=*$"), "base32").when(token.rlike(WHOLE), "base64")


def _scored(token: Column, encoding: Column) -> Column:
    """encoding, length class (quarters of powers of two) and score (in 1 / STEPS) of a token; the encoding is null where the battery doesn't apply."""
    n = F.char_length(token).cast("long")
    pick = lambda i: F.when(encoding == "hex", F.lit(float(ENCODINGS["hex"][i]))).when(encoding == "base32", F.lit(float(ENCODINGS["base32"][i]))).otherwise(F.lit(float(ENCODINGS["base64"][i])))
    k, share = pick(0), pick(1)
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    squares = _sum(F.transform(F.array_distinct(chars), lambda c: F.pow(n - F.char_length(F.replace(token, c, F.lit(""))), 2).cast("long")))
    z_chi = ((k - 1) - (k * squares / n - n)) / F.sqrt(2 * (k - 1))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "[a-z]", "l"), "[A-Z]", "u"), "[0-9]", "d"), "[^lud]", "o")
    changes = F.char_length(F.regexp_replace(classes, r"(.)\1*", "x")) - 1
    z_runs = (changes - (n - 1) * share) / F.sqrt((n - 1) * share * (1 - share))
    lag = lambda c: _sum(F.zip_with(c, F.concat(F.slice(c, 2, F.size(c)), F.slice(c, 1, 1)), lambda x, y: x * y))
    sums = _bound(F.transform(chars, lambda c: F.ascii(c).cast("long")), lambda c: F.struct(_sum(c).alias("total"), _sum(F.transform(c, lambda x: x * x)).alias("squared"), lag(c).alias("lagged")))
    spread = lambda s: n * s["squared"] - s["total"] * s["total"]
    z_serial = _bound(sums, lambda s: F.when(spread(s) > 0, F.abs(n * s["lagged"] - s["total"] * s["total"]) * F.sqrt(n.cast("double")) / spread(s)).otherwise(F.lit(500.0)))
    score = F.least(F.lit(20.0), F.greatest(F.lit(-500.0), z_chi + z_runs - z_serial))
    power = F.length(F.bin(n)) - 1
    size = F.least(F.lit(LONGEST), (4 * power + F.floor(4 * n / F.pow(F.lit(2), power)) - 4).cast("int"))
    return F.struct(encoding.alias("encoding"), size.alias("size"), F.floor(score * STEPS).cast("int").alias("score"))


def _artificial(text: Column) -> Column:
    """An array of the one (form, token) of a text, its form by the text's hash, from words of a window of it; empty where
    that has fewer than three words."""
    digits = lambda seed, at, n: F.conv(F.substring(seed, at, n), 16, 10).cast("long")

    def of(seed: Column, found: Column) -> Column:
        many = F.element_at(F.array(*map(F.lit, WORDS_OF)), (digits(seed, F.lit(1), F.lit(4)) % len(WORDS_OF) + 1).cast("int"))
        places = F.transform(F.sequence(F.lit(0), many - 1), lambda i: ((digits(seed, 1 + i % 27, F.lit(6)) + i * 7919) % F.size(found) + 1).cast("int"))
        words = F.transform(places, lambda k: F.lower(F.element_at(found, k)))
        capital = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 20)))
        numbered = F.transform(capital, lambda w, i: F.when(i % 3 == 2, F.concat(w, (digits(seed, 1 + i % 29, F.lit(2)) % 100).cast("string"))).otherwise(w))
        decimal = F.substring(F.array_join(F.transform(places, lambda k: k.cast("string")), ""), 1, 255)
        tokens = {"camel": F.array_join(capital, ""), "numbered": F.array_join(numbered, ""), "path": F.array_join(words, "/"), "upper": F.upper(F.array_join(words, "")), "decimal": decimal}
        which, token = digits(seed, F.lit(5), F.lit(4)) % len(FORMS), F.lit(None).cast("string")
        for k, form in reversed(list(enumerate(FORMS))):
            token = F.when(which == k, tokens[form]).otherwise(token)  # the others aren't evaluated
        return F.array(F.struct(F.element_at(F.array(*map(F.lit, FORMS)), (which + 1).cast("int")).alias("form"), token.alias("token")))

    def within(seed: Column) -> Column:
        at = digits(seed, F.lit(9), F.lit(8)) % F.greatest(F.lit(1), F.char_length(text) - WINDOW + 1) + 1
        found = F.regexp_extract_all(F.substring(text, at.cast("int"), F.lit(WINDOW)), F.lit(WORD), F.lit(0))
        return _bound(found, lambda w: F.when(F.size(w) >= 3, of(seed, w)).otherwise(F.array().cast("array<struct<form:string,token:string>>")))

    return _bound(F.md5(text.cast("binary")), within)


def _null_tests(text: Column) -> Column:
    """(form, size, score) of the artificial token if it has 20 to 255 characters."""
    fit = F.filter(_artificial(text), lambda t: F.char_length(t["token"]).between(20, 255))
    encoding = lambda t: F.element_at(F.create_map(*(F.lit(x) for kv in FORMS.items() for x in kv)), t["form"])
    return F.transform(fit, lambda t: F.struct(t["form"].alias("form"), _scored(t["token"], encoding(t)).alias("t")))


def _with_stretches(rows: DataFrame) -> DataFrame:
    """rows with the stretches of column random's runs of no one encoding in the place of these runs."""
    rows = rows.withColumns({"_mixed": F.filter("random", lambda r: ~r["text"].rlike(WHOLE)), "random": F.filter("random", lambda r: r["text"].rlike(WHOLE))})
    text = F.col("text")
    # texts without mixed runs aren't searched again
    rows = rows.withColumns({"_whole": text, "text": F.when(F.size("_mixed") > 0, text).otherwise(F.lit(""))})
    for k, pattern in enumerate(STRETCHES):
        rows = _found(rows, f"_s{k}", pattern, KINDS.index("random"))
    within = F.filter(F.array_distinct(F.concat("_s0", "_s1")), lambda s: F.exists("_mixed", lambda r: (r["start"] <= s["start"]) & (s["end"] <= r["end"])))
    return rows.withColumn("random", F.concat("random", within)).withColumn("text", F.col("_whole")).drop("_mixed", "_whole", "_s0", "_s1")


def prior_laws() -> list[tuple[str, str, int, float, float]]:
    """Form, encoding, length class, mean and spread by PRIOR at the class's least length."""
    chars = {size: 2.0 ** (size // 4) * (4 + size % 4) / 4 for size in range(SHORTEST, LONGEST + 1)}
    return [(f, e, size, -PRIOR[f][0] * n, PRIOR[f][1] * n**0.5) for f, e in FORMS.items() for size, n in chars.items()]


def laws(tests: DataFrame) -> DataFrame:
    """(form, encoding, size, mean, spread) of the scores of artificial tokens (form, size, score), PRIOR taken in.

    The mean is the median and the spread that of the normal law's upper half with the same 95th percentile, since only
    that side matters and the other has outliers. Scores are few whole numbers, so percentiles need no sorted list."""
    prior = tests.sparkSession.createDataFrame(prior_laws(), "form string, encoding string, size int, m double, s double")
    found = tests.groupBy("form", "size").agg(F.count("*").alias("n"), F.percentile("score", F.lit(0.5)).alias("a"), F.percentile("score", F.lit(0.95)).alias("b"))
    both = F.broadcast(prior).join(found, ["form", "size"], "left").fillna(0, ["n", "a", "b"])
    part = lambda x, y: (F.col("n") * x + WEIGHT * F.col(y)) / (F.col("n") + WEIGHT)
    return both.select("form", "encoding", "size", part(F.col("a"), "m").alias("mean"), part((F.col("b") - F.col("a")) / F.lit(1.645), "s").alias("spread"))


def thresholds(histogram: DataFrame, law: DataFrame, fdr: float = FDR) -> DataFrame:
    """(encoding, size, least): the least score that counts in each stratum of histogram (encoding, size, score, n)."""
    stratum = Window.partitionBy("encoding", "size")
    above = stratum.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    z = (F.col("score") - F.col("mean")) / F.col("spread")
    tail = F.when(z > 0, F.lit(0.5) * F.exp(F.lit(-0.717) * z - F.lit(0.416) * z * z)).otherwise(F.lit(1.0))  # of the normal law
    scored = histogram.join(F.broadcast(law), ["encoding", "size"]).groupBy("encoding", "size", "score", "n").agg(F.max(tail).alias("p"))
    ranked = scored.withColumn("rank", F.sum("n").over(above)).withColumn("all", F.sum("n").over(stratum))
    return ranked.where(F.col("p") * F.col("all") <= F.lit(fdr) * F.col("rank")).groupBy("encoding", "size").agg(F.min("score").alias("least"))


def _scanned(docs: DataFrame, text_col: str, columns: list[str], fdr: float) -> DataFrame:
    """(row: struct of columns, assign, access, hex, random): the scan of every row of docs by its own text."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    for name, pattern, least in (("assign", ASSIGN, 8), ("access", ACCESS, 0), ("hex", HEX, 0), ("random", CANDIDATE, 0)):
        rows = _found(rows, name, pattern, KINDS.index(name), least)
    rows = _with_stretches(rows)
    rows = rows.withColumns({"base": F.concat("assign", "access", "hex"), "null": _null_tests(F.col("text"))}).drop("text")
    rows = rows.withColumn("random", F.filter("random", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))))
    rows = rows.withColumn("random", F.transform("random", lambda r: r.withField("test", _scored(r["text"], _encoding(r["text"]))))).drop("base")
    rows = common.keep(rows, "secrets")
    tests = rows.select(F.explode("random.test").alias("t")).where("t.encoding is not null").groupBy("t.encoding", "t.size", "t.score").agg(F.count("*").alias("n"))
    law = laws(rows.select(F.explode("null").alias("x")).select("x.form", "x.t.size", "x.t.score"))
    least = {(r["encoding"], r["size"]): r["least"] for r in thresholds(tests, law, fdr).collect()}  # a row for each encoding and length class
    kept = F.filter("random", lambda r: _counts(r["test"], least))
    return rows.withColumn("random", F.transform(kept, lambda r: r.dropFields("test"))).drop("null")


def scan(docs: DataFrame, fdr: float = FDR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, assign, access, hex, random): arrays of spans (start, kind, end, text, value) by code points, end exclusive.

    Null texts are empty and have no spans; every repeated row is scanned; other columns aren't read. A random span never
    overlaps a base span. An empty table gives an empty table."""
    return _scanned(docs, text_col, [id_col], fdr).select(f"row.`{id_col}`", *KINDS)


def _counts(test: Column, least: dict) -> Column:
    out = F.lit(False)
    for (encoding, size), score in sorted(least.items()):
        out = out | ((test["encoding"] == encoding) & (test["size"] == size) & (test["score"] >= score))
    return F.coalesce(out, F.lit(False))


def _said(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.concat_ws(",", F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"]))), lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of the scan of docs."""
    rows = scan(docs)
    base = F.concat("assign", "access", "hex")
    return rows.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]), F.sha2(_said(base), 256).alias("base_sha256"), _said(F.concat(base, "random")).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[secret]", fdr: float = FDR, length_col: str | None = None) -> DataFrame:
    """docs (text and any other columns) with every span of its texts replaced by mark; touching and overlapping spans are
    one. Where that changes a text, length_col (if given) becomes its length in code points. Null texts stay null. Every row
    is redacted by the spans found in it, so null and repeated ids and any column names do no harm."""
    spans = F.array_sort(F.transform(F.concat(*KINDS), lambda s: F.struct(s["start"], s["end"])))
    text = F.col("row.text")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    piece = lambda a, b: F.substring(text, (a + 1).cast("int"), F.greatest(F.lit(0), b - a).cast("int"))
    step = lambda s, x: F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], F.when(x["start"] > s["at"], F.concat(piece(s["at"], x["start"]), F.lit(mark))).when(s["out"] == "", F.lit(mark)).otherwise(F.lit(""))).alias("out"))
    done = F.aggregate(spans, start, step, lambda s: F.concat(s["out"], piece(s["at"], F.char_length(text).cast("long"))))
    any_ = text.isNotNull() & (F.size(F.concat(*KINDS)) > 0)
    new = {"text": F.when(any_, done).otherwise(text)}
    if length_col:
        new[length_col] = F.when(any_, F.char_length(done).cast(docs.schema[length_col].dataType)).otherwise(F.col(f"row.`{length_col}`"))
    return _scanned(docs, "text", docs.columns, fdr).select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
