"""Each operator against brute force, an exact round trip or held-out labels, with nulls, empty and repeated rows, empty
tables and further columns."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import decontam, gif_media, html_text, ngram_join, packing, queries, secrets, suffix_dedup, token_counts, toxicity, warc
from tessella.llm.oracles import ORACLE_SQL

DOCS = "doc_id long, text string, n long, kind string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DOCS)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.mark.parametrize("name", ["op1_secret_scans", "op8_warc"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    at = [want.columns.index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(tuple(r[k] for k in at) for r in want.fetchall())


def test_secrets_edges(spark):
    key = hashlib.sha256(b"k").hexdigest()
    text = f'é 😀 password: token :abcdefgh\nAPI-KEY no api_key="abcd1234+/" AKIA{"A" * 12} {key} x'
    rows = [(1, None), (2, ""), (3, text), (3, text), (4, "aB3$ Zk9Qw7LmX2vTb5NcR8yHj4PdS6gFe1U")]
    got = [r for r in secrets.digests(docs(spark, rows)).collect() if r["doc_id"] == 3]
    assert len(got) == 2 and (got[0]["n_assign"], got[0]["n_access"], got[0]["n_hex"]) == (1, 1, 1)
    a, b = next((int(x.split(":")[1]), int(x.split(":")[2])) for x in got[0]["spans"].split(",") if x.startswith("hex"))
    assert text[a:b] == key
    clean = secrets.redacted(docs(spark, rows[:3])).where("doc_id = 3").first()["text"]
    assert key not in clean and clean.startswith("é 😀 password: token :abcdefgh") and clean.endswith(" x")
    assert secrets.digests(docs(spark, [])).count() == 0


@pytest.mark.parametrize("encoding", ["hex", "base32", "base64"])
def test_random_keys_are_found_and_identifiers_are_not(spark, sf_dir, encoding, tmp_path):
    """Planted keys by length, beside as many identifiers, upper-case names or decimal numbers; and the SQL finds the same."""
    rng = random.Random(encoding)
    alphabet = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}[encoding]
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    terms = [w for r in given.limit(60).collect() for w in (r["text"] or "").split() if w.isascii() and w.isalpha() and len(w) > 2]

    def other(n):
        if encoding == "hex":
            return "".join(rng.choice("0123456789") for _ in range(n))
        made = ""
        while len(made) < n:
            made += rng.choice(terms).capitalize()
        return made.upper() if encoding == "base32" else made[0].lower() + made[1:]

    sizes = (24, 30) if encoding == "hex" else (24, 32, 44, 64)
    keys = {n: ["".join(rng.choice(alphabet) for _ in range(n)) for _ in range(60)] for n in sizes}
    plain = [other(n) for n in sizes for _ in range(60)]
    rows = [(f"{words(rng, 4)} {k} {words(rng, 3)}", n) for n in sizes for k in keys[n]] + [(f"{words(rng, 4)} {k} {words(rng, 3)}", 0) for k in plain]
    frame = given.union(spark.createDataFrame([(10_000 + i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")).repartition(4)
    frame.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    digests = secrets.digests(frame).collect()
    got = {r["doc_id"] - 10_000: r["spans"] for r in digests}
    flagged = [i for i in range(len(rows)) if "random" in got[i]]
    for n in sizes:
        mine = [i for i, (_, m) in enumerate(rows) if m == n]
        assert sum(i in flagged for i in mine) >= 0.85 * len(mine), n
    found = sum(rows[i][1] > 0 for i in flagged)
    assert found >= 0.9 * len(sizes) * 60 and len(flagged) - found <= 0.02 * len(flagged)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(ORACLE_SQL["op1_secret_scans"])
    assert Counter(tuple(r[c] for c in want.columns) for r in digests) == Counter(want.fetchall())


def test_secrets_redaction_is_by_row_with_any_columns(spark):
    key = hashlib.sha256(b"k").hexdigest()
    frame = spark.createDataFrame([(1, f"a {key} b", 1, 68), (1, "plain", 2, 5), (None, f"{key}", 3, 64), (None, None, 4, None), (2, "", 5, 0)], "doc_id long, text string, _id long, n_chars long")
    frame = frame.withColumn("_spans", F.lit(1)).withColumn("row", F.lit("r")).withColumn("random", F.lit(2))
    got = {r["_id"]: (r["doc_id"], r["text"], r["n_chars"]) for r in secrets.redacted(frame, length_col="n_chars").collect()}
    assert got == {1: (1, "a [secret] b", 12), 2: (1, "plain", 5), 3: (None, "[secret]", 8), 4: (None, None, None), 5: (2, "", 0)}
    assert secrets.redacted(frame.limit(0)).columns == frame.columns


def test_secrets_within_mixed_runs(spark):
    """A value after its name and '=', in a query string and after a path is reported and redacted; prose in such runs isn't."""
    rng = random.Random(12)
    value = lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(44))
    forms = ["AWS_SECRET_ACCESS_KEY={}", "AUTH={}==", "http://x/?sig={}&b=1", "my_files/of/{}"]
    plain = "thelongnameofavariable=anditsvalueinplainwords"
    values = [value() for _ in range(40)]
    rows = [(k, f"é {forms[k % 4].format(v)} x") for k, v in enumerate(values)] + [(100, plain), (101, None)]
    spans = {r["doc_id"]: r["spans"] for r in secrets.digests(docs(spark, rows)).collect()}
    clean = {r["doc_id"]: r["text"] for r in secrets.redacted(docs(spark, rows)).collect()}
    for k, v in enumerate(values):
        assert "random:" in spans[k] and v not in clean[k] and clean[k].endswith(" x")
    assert spans[100] == "" and clean[100] == plain


def test_ngram_join_equals_brute_force(spark):
    rng = random.Random(4)
    base = [words(rng, 60) for _ in range(6)]
    rows = [(k, b) for k, b in enumerate(base)] + [(100, None), (101, ""), (102, "one two"), (103, "One two"), (104, " \t ")]
    for k in range(60):
        w = base[k % 6].split()
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = words(rng, 1)
        rows.append((200 + k, " ".join(w)))
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    for how in ({}, {"block": 3, "hot": 8, "cell": 4}):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs(spark, rows), **how).collect()}
        assert got == {i: (len(s), label[i]) for i, s in sets.items()}


def test_parity_sketches_differ_in_no_more_bits_than_sets():
    rng = np.random.default_rng(3)
    for n in (3, 40, 150, 700):
        one = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for _ in range(20)]
        two = [np.union1d(s[len(s) // 5 :], rng.integers(0, 2**64, len(s) // 5, dtype=np.uint64)) for s in one]
        far = ngram_join._far([ngram_join._parity(s) for s in one], [ngram_join._parity(s) for s in two])
        assert all(f <= len(np.setxor1d(s, t)) for f, s, t in zip(far.tolist(), one, two, strict=True) if f < 1 << 40)


def test_ngram_join_of_a_group_of_edited_copies(spark):
    """Copies with edits at random places share shingles in large blocks; many pairs are close to the threshold."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(260):
        words = list(base)
        for k in rng.sample(range(150), rng.randrange(1, 7)):
            words[k] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(146)} for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    for how in ({}, {"block": 4, "cell": 16}):
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(docs(spark, rows), **how).collect()}
        assert [got[i] for i in range(len(rows))] == label


def test_gif_round_trip(spark):
    rng = random.Random(1)
    rows = [(1, None), (2, ""), (3, "é" * 500), (4, words(rng, 30_000)), (4, "x" * 192)]
    for r in gif_media.digests(gif_media.store_texts(docs(spark, rows))).collect():
        texts = [(t or "").encode() for i, t in rows if i == r["doc_id"]]
        payloads = [b + b" " * ((-len(b) % 192) or (0 if b else 192)) for b in texts]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) in [(len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])) for p in payloads]


def lzw(samples, size):
    """A plain encoder with growing codes, for the decoder's sake."""
    clear, out, bits, held = 1 << size, bytearray(), 0, 0

    def put(code, width):
        nonlocal bits, held
        held |= code << bits
        bits += width
        while bits >= 8:
            out.append(held & 255)
            held >>= 8
            bits -= 8

    width, table, new, now = size + 1, {bytes([k]): k for k in range(clear)}, clear + 2, b""
    put(clear, width)
    for s in samples:
        if now + bytes([s]) in table:
            now += bytes([s])
            continue
        put(table[now], width)
        if new < 4096:
            table[now + bytes([s])] = new
            width += new == 1 << width and width < 12
            new += 1
        now = bytes([s])
    put(table[now], width)
    width += new < 4096 and new == 1 << width and width < 12
    put(clear + 1, width)
    return bytes(out) + bytes([held & 255])


@pytest.mark.parametrize(("size", "n"), [(2, 5), (8, 300), (8, 60_000), (4, 30_000)])
def test_lzw_streams(size, n):
    rng = random.Random(n)
    s = bytes(rng.choice((0, 0, 0, 1, rng.randrange(1 << size))) for _ in range(n))
    assert gif_media.expand(lzw(s, size), size).tobytes() == s


def test_gif_transparency_and_disposal():
    def frame(samples, disposal, clear=None):
        packed = disposal << 2 | (clear is not None)
        stream = lzw(samples, 2)
        return b"\x21\xf9\x04" + bytes([packed, 5, 0, clear or 0]) + b"\0\x2c" + bytes([0, 0, 0, 0, 2, 0, 1, 0, 0]) + b"\x02" + bytes([len(stream)]) + stream + b"\0"

    head = b"GIF89a" + bytes([2, 0, 1, 0, 0x91, 0, 0]) + bytes([0, 0, 0, 9, 9, 9, 50, 60, 70, 1, 2, 3])
    shown = [f.rgb[0, :, 0].tolist() for f in gif_media.frames(head + frame([2, 2], 1) + frame([1, 0], 3, 0) + frame([0, 3], 2, 0) + frame([1, 0], 1, 0) + b"\x3b")]
    assert shown == [[50, 50], [9, 50], [50, 1], [9, 0]]


def test_packing(spark):
    path = queries.tokenizer_path("word_bpe_49k.json")
    rng = random.Random(2)
    rows = [(1, None), (2, ""), (3, words(rng, 3000)), (4, "The end. É! don't <|endoftext|> x"), (4, "again")] + [(10 + k, words(rng, rng.randint(1, 900))) for k in range(40)]
    got = packing.pack(docs(spark, rows).repartition(3), path).collect()
    from tokenizers import Tokenizer

    model, want = Tokenizer.from_file(path), Counter()
    for i, t in rows:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], np.uint32)
        want.update((i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(r["length"] for r in got)
    assert len(by) <= -(-total // 2048) + 2
    assert packing.pack(docs(spark, []), path).count() == 0


def test_packed_ids_equal_the_library_on_odd_texts(spark):
    from tokenizers import Tokenizer

    path, rng = queries.tokenizer_path("word_bpe_49k.json"), random.Random(5)
    model = Tokenizer.from_file(path)
    bits = ["\u0130", "\u00df", "\u00e9", "e\u0301", "\u0391\u03a3", "\u03c3\u03c2", "'s", "don't", "I'LL", "...", "?!", "<|endoftext|>", "<|EndOfText|>", "a<|startoftext|>b", "\u00a0", "\u2003", "\u200b", "\u65e5\u672c", "\ud55c", "\u1100", "\u1161", "\u01c5", "\ufb01", "\u00b2", "1", "23", "_", "-", "\U0001f600", "&&&", "|", "\x1c", "\x85", "Hello", "World", "ab", "zzqx", "\u060c", "\u0640", "\u093e", "\u0915", "K", "\u212b", " ", "  ", "\n", "\t", ".", ",", ";", "'"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + ["x" * 300_000, "ab " * 200_000]
    got = {}
    for r in packing.pack(docs(spark, list(enumerate(texts))), path).select("doc_id", "piece", "length", "ids_crc32").collect():
        got.setdefault(r["doc_id"], {})[r["piece"]] = (r["length"], r["ids_crc32"])
    for k, t in enumerate(texts):
        ids = np.array([*model.encode(t, add_special_tokens=False).ids, 0], np.uint32)
        assert [got[k][p] for p in range(len(got[k]))] == [(len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for a in range(0, len(ids), 2048)]


def test_packing_patterns_fill_and_the_plan_places_all():
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1, 2049, 3000), np.clip(rng.lognormal(5.5, 1, 20000).astype(int), 1, 2048), rng.integers(20, 60, 5000), np.array([2048, 2048, 1])):
        values, counts = np.unique(lengths, return_counts=True)
        found = packing.patterns(values, 2048)
        assert ((found[:, 0] * found[:, 1] + found[:, 2] + found[:, 3]) == 2048).all()
        runs = packing.plan(dict(zip(values.tolist(), counts.tolist(), strict=True)), 2048)
        placed, filled = Counter(), Counter()
        for n, a, b, sequence, _ in runs:
            placed[n] += b - a
            for k in range(b - a):
                filled[sequence + k] += n
        assert placed == dict(zip(values.tolist(), counts.tolist(), strict=True)) and max(filled.values()) <= 2048
        assert len(filled) <= -(-int(lengths.sum()) // 2048) * 1.06 + 1


def test_decontamination(spark):
    rng = random.Random(3)
    items = [(k, words(rng, 30)) for k in range(5)] + [(9, None), (10, "too short")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    edited = items[1][1].split()
    edited[4] = edited[15] = edited[26] = "other"
    rows = [(1, None), (2, ""), (3, words(rng, 300)), (4, words(rng, 50) + " " + items[0][1].upper() + ", " + words(rng, 50)), (5, " ".join(edited))] + [(100 + k, items[2][1]) for k in range(30)]
    for how in ({}, {"block_words": 40}):
        got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.leaks(docs(spark, rows), bench, **how).collect()}
        assert set(got) == {(4, 0), (5, 1), *((100 + k, 2) for k in range(30))} and got[4, 0] == 1.0 and 0.6 < got[5, 1] < 1
    assert decontam.clean(docs(spark, rows), bench).count() == 3
    assert decontam.leaks(docs(spark, rows), bench.limit(0)).count() == 0


@pytest.mark.parametrize("share", [0.05, 0.1, 0.2])
def test_decontamination_finds_copies_by_share_of_edits(spark, share):
    """In 200 documents, copies of items of 30 words with a share of their words replaced."""
    rng = random.Random(share)
    items = [(k, words(rng, 30)) for k in range(100)]
    rows = [(1000 + k, words(rng, 80)) for k in range(100)]
    for k, t in items:
        rows.append((k, f"{words(rng, 20)} {' '.join('other' if rng.random() < share else w for w in t.split())} {words(rng, 20)}"))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all(d == i for d, i in got) and len(got) >= 95


def test_short_items_match_texts_of_just_their_words(spark):
    bench = spark.createDataFrame([(1, "Yes, no"), (2, "yes no"), (3, "one"), (4, ""), (5, "...")], "item_id long, text string")
    rows = [(10, "yes; NO!"), (10, "yes no"), (11, "they said yes no and more"), (12, "one"), (13, "no yes"), (14, None), (15, "..."), (None, "one")]
    got = Counter((r["doc_id"], r["item_id"], r["score"]) for r in decontam.leaks(docs(spark, rows), bench).collect())
    assert got == Counter({(10, 1, 1.0): 2, (10, 2, 1.0): 2, (12, 3, 1.0): 1, (None, 3, 1.0): 1})


def test_alignment_equals_plain_smith_waterman():
    rng = np.random.default_rng(4)
    pairs = [(rng.integers(1, 9, rng.integers(1, 14)).astype(np.uint64), rng.integers(1, 9, rng.integers(1, 30)).astype(np.uint64)) for _ in range(200)]
    want = []
    for a, b in pairs:
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = max(0, table[i, j] + (2 if a[i] == b[j] else -1), table[i, j + 1] - 1, table[i + 1, j] - 1)
        want.append(table.max() / (2 * len(a)))
    assert np.allclose(decontam.align([a for a, _ in pairs], [b for _, b in pairs]), want)


@pytest.mark.parametrize(("copies", "others"), [(1, 60), (8, 0), (30, 400)])
def test_decontamination_of_edited_copies(spark, copies, others):
    """Four edits destroy more than half of an item's n-grams; what is left must find one copy in few documents, and many."""
    rng = random.Random(11)
    item = words(rng, 30)
    edited = item.split()
    for k in (5, 11, 17, 23):
        edited[k] = "other"
    rows = [(k, words(rng, 20)) for k in range(others)] + [(1000 + k, " ".join(edited)) for k in range(copies)]
    got = decontam.leaks(docs(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == {1000 + k for k in range(copies)} and all(0.7 < r["score"] < 0.9 for r in got)


def test_token_counts_equal_the_library(spark, sf_dir):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(5)
    texts = [None, "", " ", "  a  b ▁ ", "日本 é\n\tx<s>", "ab" * 400 + " " * 40, *("".join(rng.choice("ab ▁é日e t\n.") for _ in range(rng.randint(0, 80))) for _ in range(200))]
    texts += [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.counts(docs(spark, rows), path).collect()}
    assert got == {i: (len((t or "").encode()), len(model.encode(t or ""))) for i, t in rows}


def test_toxicity_on_held_out_labels(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(600):
        bad = k % 4 == 0
        w = words(rng, 60).split()
        if bad:
            for _ in range(4):
                w[rng.randrange(60)] = rng.choice(["you idiot", "stupid", "zzgrompf", "1d10t"])
        rows.append((k, " ".join(w)))
        labels.append((k, int(bad)))
    rows += [(900, None), (901, "")]
    labels.append((5000, None))
    got = toxicity.classified(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == 602 and all(0 <= r["score"] <= 1 for r in got)
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    again = toxicity.classified(docs(spark, rows), spark.createDataFrame(labels * 2, "doc_id long, toxic int")).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))  # several labels of one id count once
    empty = toxicity.classified(docs(spark, rows), spark.createDataFrame([], "doc_id long, toxic int"))
    assert empty.count() == 602


def test_warc_edges(spark, tmp_path):
    rows = [(3, "http://a/x", "<p>é</p>", 1), (1, "http://a/y", "<p>é</p>", 1), (2, None, None, 1), (4, "u", "", 1), (None, "v", "z", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to long")
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.archive(pages, str(tmp_path / "w")).collect()}
    assert got == {3: ("revisit", 1, 9), 1: ("response", None, 9), 2: ("response", None, 0), 4: ("revisit", 2, 0), None: ("response", None, 1)}
    (tmp_path / "e").mkdir()
    assert warc.archive(pages.limit(0), str(tmp_path / "e")).count() == 0
    import gzip

    (tmp_path / "g").mkdir()
    record = b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <x>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "g" / "a.warc.gz").write_bytes(gzip.compress(record % b"resource") + gzip.compress(record % b"response"))
    (tmp_path / "g" / "b.warc").write_bytes(record % b"metadata")
    assert [r["payload"] for r in warc.read_records(spark, str(tmp_path / "g")).where("record_type = 'resource'").collect()] == [b"hello"]


def without_repeats(rows):
    """By brute force: bytes, removed bytes, runs and what is kept of each text."""
    counts = Counter()
    for _, t in rows:
        b = (t or "").encode()
        counts.update(b[i : i + 200] for i in range(len(b) - 199))
    want = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if counts[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        want[d] = (len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1])), hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return want


@pytest.mark.parametrize("hot", [50_000, 20])
def test_suffix_dedup_equals_brute_force(spark, sf_dir, hot):
    rng = random.Random(7)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    rows += [(900, None), (901, ""), (902, "a" * 900), (903, "ab" * 300), (904, rows[0][1]), (905, "x" * 150 + rows[3][1][50:400] + "y" * 90), (906, "é" * 400), (907, words(rng, 200))]
    want = without_repeats(rows)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.digests(docs(spark, rows).repartition(3), hot=hot).collect()}
    assert got == want


@pytest.mark.parametrize("hot", [10, 50_000])
def test_suffix_dedup_of_large_groups(spark, hot):
    """A passage that all texts share, hundreds of equal texts, and hundreds that differ in a word."""
    rng = random.Random(8)
    passage, text = words(rng, 60), words(rng, 150).split()
    rows = [(k, f"{words(rng, rng.randint(0, 30))} {passage} {words(rng, rng.randint(0, 30))}") for k in range(300)]
    rows += [(1000 + k, " ".join(text)) for k in range(300)]
    rows += [(2000 + k, " ".join([*text[: (i := rng.randrange(150))], words(rng, 1), *text[i + 1 :]])) for k in range(300)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.digests(docs(spark, rows).repartition(5), hot=hot).collect()}
    assert got == without_repeats(rows)
    assert suffix_dedup.digests(docs(spark, [])).count() == 0


def test_merging_of_front_coded_runs():
    rng = random.Random(8)
    for k in (1, 2, 5, 8):
        runs = []
        for _ in range(k):
            s = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 40)))
            runs.append((s, [0, *(next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(s, s[1:]))]))
        run, place, shared = suffix_dedup.merge(runs)
        out = [runs[r][0][p] for r, p in zip(run, place)]
        assert out == sorted(x for s, _ in runs for x in s)
        for a, b, n in zip(out, out[1:], shared[1:]):
            assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


def test_warc_of_other_writers(spark, tmp_path):
    """Many records in one gzip member, one in each, plain files, extra blank lines, long blocks, blocks without a HTTP header."""
    import gzip

    def record(k, block, end=b"\r\n\r\n"):
        return b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:x:%d>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % (b"response" if k % 2 else b"request", k, len(block)) + block + end

    blocks = [b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody", b"no header end", b"HTTP/1.1 200 OK\r\n\r\n" + b"x\r\n\r\n" * 300_000, b"", b"HTTP/1.1 200 OK\r\n\r\nlast"]
    payloads = [b"body", b"no header end", b"x\r\n\r\n" * 300_000, b"", b"last"]
    records = [record(k, b, b"\r\n\r\n\r\n" if k == 1 else b"\r\n\r\n") for k, b in enumerate(blocks)]
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "each.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    got = warc.read_records(spark, str(tmp_path))
    assert Counter((r["record_id"], bytes(r["payload"])) for r in got.collect()) == Counter({(f"<urn:x:{k}>", p): 3 for k, p in enumerate(payloads)})
    assert warc.read_records(spark, str(tmp_path), payload=False).where("record_type = 'response'").count() == 6


def test_html(spark):
    chrome = "<div>Site A</div><nav><a>Home</a></nav>{}<p>Imprint</p>"
    rows = [
        (1, "http://a/1", chrome.format("<article><h1>T &amp; x</h1><p>One<br>two\n three<p>Four<div class='comments'>no</div></article>")),
        (2, "http://a/2", chrome.format("<div><p>Only here</p></div>")),
        (3, "http://a/3", chrome.format("<div><p>Else where</p></div>")),
        (4, "http://b/1", None), (5, None, ""), (5, None, "<p>a<script>x</p></script>b</p><!-- c --><div class='ad'>y</div>"),
    ]
    got = Counter((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == Counter([(1, "T & x\n\nOne two three\n\nFour", 26), (2, "Only here", 9), (3, "Else where", 10), (4, "", 0), (5, "", 0), (5, "ab", 2)])


@pytest.mark.parametrize("page", ["<body class='single right-sidebar'><article>{}</article></body>", "<main class='no-sidebar'>{}</main>", "<article class='post has-comments'>{}</article>", "<div class='content-with-sidebar'><article>{}</article></div>", "<div class='sidebar'><main><article>{}</article></main></div>", "<div id='modal'><article>{}</article></div>"])
def test_html_names_around_articles(page):
    inner = "<p>One</p><div class='cookie-banner'>no</div><div class='site-footer'>no</div><p>Two</p>"
    got = html_text.lines("<div class='related'><p>no</p></div>" + page.format(inner))
    assert [t for t, inside, furniture in got if inside and not furniture] == ["One", "Two"]


def test_html_related_articles_stay_furniture():
    got = html_text.lines("<main><article>One</article></main><div class='related'><article>no</article></div>")
    assert [t for t, inside, furniture in got if inside and not furniture] == ["One"]


def test_longest_common_subsequences():
    rng = random.Random(9)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(0, 12))] for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        for cells in (1 << 20, 6, 1):
            found = html_text.shared(a, b, cells)
            it = iter(b)
            assert len(found) == table[-1][-1] and all(a[k] in it for k in sorted(found))
    many = [rng.randrange(1000) for _ in range(20_000)]
    assert len(html_text.shared(many, many[5:9000] + many[9100:], 1 << 20)) == len(many) - 105


def test_html_differencing_without_telling_names(spark):
    """Pages of meaningless elements: lines shared with a neighbour by path go, copies don't empty each other, hosts don't mix."""
    rng = random.Random(6)
    rows, want = [], {}
    for host in range(4):
        top, end = [words(rng, 4) for _ in range(3)], [words(rng, 5) for _ in range(4)]
        for k in range(12):
            own = [words(rng, rng.randint(2, 30)) for _ in range(rng.randint(1, 6))]
            page = 100 * host + k
            rows.append((page, f"http://h{host}.x/p/{k:02}?q={rng.random()}", "".join(f"<div class='c{rng.randrange(99)}'><span>{t}</span></div>" for t in [*top, *own, *end])))
            want[page] = "\n\n".join(own)
        rows.append((100 * host + 50, f"http://h{host}.x/p/03/copy", rows[-9][2]))  # of page 3
        want[100 * host + 50] = want[100 * host + 3]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert got == want
    alone = [(1, "http://a/1", "<div>x</div><div>y</div>"), (2, "http://a/2", "<div>x</div><div>y</div>"), (3, "http://b/1", "<div>x</div>")]
    assert {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(alone, "page_id long, url string, html string")).collect()} == {1: "x\n\ny", 2: "x\n\ny", 3: "x"}
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string, lines int")).count() == 0


def test_html_differencing_inside_articles(spark):
    """A line of both neighbours' articles goes, one of a single neighbour is a quotation, near copies keep theirs."""
    rng = random.Random(16)
    quote, notice = words(rng, 20), words(rng, 9)
    own = {k: [words(rng, 12) for _ in range(4)] for k in range(1, 7)}
    own[2] = own[2][:2] + [quote] + own[2][2:]
    own[3] = own[3][:1] + [quote] + own[3][1:]
    own[6] = own[5][:3] + [words(rng, 12)]  # a near copy of its neighbour
    rows = [(k, f"http://a/{k}", "<article>" + "".join(f"<p>{t}</p>" for t in [*x[:1], notice, *x[1:]]) + "</article>") for k, x in own.items()]
    got = {r["page_id"]: r["text"].split("\n\n") for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == own[k] for k in (2, 3, 4))
    assert all(set(own[k]) <= set(got[k]) for k in (1, 5, 6))  # pages with one neighbour that isn't a near copy keep all


def test_stages_with_null_and_repeated_ids(spark, sf_dir):
    """Clean rows without an id stay, one of two equal rows does, and each row is redacted and tested by its own text."""
    rng = random.Random(13)
    clean, twice, leak = words(rng, 60), words(rng, 60), spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("length(text) > 200").first()["text"]
    key = [hashlib.sha256(bytes([k])).hexdigest() for k in range(3)]
    secret = [f"{words(rng, 9)} {k} {words(rng, 40)}" for k in key]
    kind = "doc_id long, text string, n_chars long"
    rows = [(None, clean), (7, twice), (7, twice), (8, secret[0]), (8, secret[1]), (None, secret[2]), (None, leak), (9, None), (None, None)]
    frame = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], kind)
    once = [(None, clean), (7, twice), (8, secret[0]), (8, secret[1]), (None, secret[2]), (None, leak), (9, None), (None, None)]
    pairs = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    assert pairs(corpus_pipeline.without_copies(spark, frame, sf_dir)) == Counter(once)
    assert pairs(corpus_pipeline.without_benchmark(spark, frame, sf_dir)) == Counter(r for r in rows if r[1] != leak)
    marked = [(i, next((t.replace(k, "[secret]") for k in key if t and k in t), t)) for i, t in rows]
    assert pairs(corpus_pipeline.without_secrets(spark, frame, sf_dir)) == Counter(marked)


def test_pipeline_keeps_clean_documents(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = frame
    for _, stage in corpus_pipeline.STAGES[1:4]:
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == frame.columns
    groups = {r["component_id"] for r in ngram_join.join(frame).collect()}
    bad = {r["doc_id"] for r in decontam.leaks(frame, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    rows = kept.collect()
    assert {r["doc_id"] for r in rows} == groups - bad and len(rows) == len(groups - bad)
    assert all(r["n_chars"] == len(r["text"]) for r in rows if "[secret]" in (r["text"] or ""))
