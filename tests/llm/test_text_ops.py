"""Line dedup, conversation repair and spelling variants against plain versions."""

import functools
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import conversations, line_dedup, queries, spelling

# ---------------------------------------------------------------- lines


def plain_lines(rows):
    holders = defaultdict(list)
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))
    low = lambda i: -(1 << 63) if i is None else i
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 40:
                holders[k].append(low(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders[key(x)]) >= 5 and low(i) != max(holders[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def line_rows():
    rng = random.Random(5)
    pool = [f"  Repeated line number {k} with ÄÖÜ and some more words\t"[: rng.randint(38, 60)] for k in range(40)] + ["ß" * 39, "ß" * 40, "x" * 40, "", "short"]
    rows = [(k, "\n".join(rng.choice(pool) if rng.random() < 0.7 else f"{rng.random()} {rng.random()} own line {k} of text" for _ in range(rng.randint(0, 12)))) for k in range(60)]
    rows += [(None, pool[0] + "\n" + pool[1]), (None, pool[0]), (3, pool[2]), (3, pool[2]), (77, None), (78, ""), (79, "\n\n"), (80, "\n".join(pool[k % 40].upper() for k in range(30000)))]
    return rows


@pytest.mark.parametrize("settings", [{}, {"bound": 0, "shard_keys": 3}, {"shard_keys": 2}])
def test_lines_by_both_ways(spark, settings):
    rows = line_rows()
    got = line_dedup.digests(spark.createDataFrame(rows, "doc_id int, text string").repartition(5), **settings)
    assert Counter(map(tuple, got.collect())) == Counter(plain_lines(rows))


@pytest.mark.parametrize("bound", [0, 1 << 20])
def test_lines_keep_other_columns(spark, bound):
    line = "a line that is long enough to be judged here"
    rows = [(k, f"{line}\nown {k}", [k], "q") for k in range(6)]
    df = spark.createDataFrame(rows, "id long, body string, `a.b` array<int>, n_dropped string")
    got = line_dedup.without_repeated_lines(df, "id", "body", bound=bound)
    assert got.columns == ["id", "body", "a.b", "n_lines", "n_dropped"]
    assert sorted(map(tuple, got.collect())) == [(k, f"own {k}" if k < 5 else f"{line}\nown 5", [k], 2, int(k < 5)) for k in range(6)]
    assert line_dedup.without_repeated_lines(df.limit(0), "id", "body", bound=bound).count() == 0


def test_a_shard_numbers_its_keys_and_no_others():
    import numpy as np

    rng = np.random.default_rng(2)
    h1, h2 = rng.integers(0, 2**64, 5000, np.uint64), rng.integers(0, 2**64, 5000, np.uint64)
    h1[:50] = h1[0]  # equal halves
    shard = line_dedup.Shard(**line_dedup.build(h1, h2, np.arange(5000), np.arange(5000) * 7))
    n = shard.number(h1, h2)
    assert sorted(n) == list(range(5000)) and (shard.lasts[n] == np.arange(5000) * 7).all() and (shard.counts[n] == np.arange(5000)).all()
    assert (shard.number(h1, h2 + np.uint64(1)) == -1).all() and (shard.number(rng.integers(0, 2**64, 5000, np.uint64), h2) == -1).all()


def test_lines_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    df = queries.op11_line_dedup(spark, sf_dir)
    want = con.sql(queries.ORACLE_SQL["op11_line_dedup"])
    rows = df.select(*want.columns).collect()
    assert sorted(map(tuple, rows)) == sorted(want.fetchall()) and sum(r["n_dropped"] for r in rows)


# ---------------------------------------------------------------- conversations


def plain_repair(rows):
    """Audit, repaired text and cost of (role, text, fault) rows, by the best suffix of each place."""

    @functools.cache
    def best(i, state):  # state: what stands so far, as its last initial, "" for nothing
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        nexts = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        name = {"u": "user", "a": "assistant"}[nexts]

        def go(cost, letter, j, to, out):
            if depth_ok(j, i, to, state):
                c, a, rest = best(j, to)
                found.append((cost + c, letter + a, out + rest))

        def depth_ok(j, i, to, state):
            return j > i

        # inserted rows are taken together with what follows them, three at most
        for n in range(4):
            at, made = state, []
            for _ in range(n):
                at = {"": "u", "s": "u", "u": "a", "a": "u"}[at]
                made.append(({"u": "user", "a": "assistant"}[at], ""))
            if i == len(rows):
                if at in ("", "a"):
                    found.append((2 * n, "I" * n, tuple(made)))
                continue
            role, text, fault = rows[i]
            follow = {"": "u", "s": "u", "u": "a", "a": "u"}[at]
            moves = [("D", 3, at, ())]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                moves.append(("R", 2 + more, follow, (({"u": "user", "a": "assistant"}[follow], text),)))
                if role[:1] == follow or (role[:1] == "s" and at == ""):
                    moves.append(("K", more, role[:1], ((role, text),)))
            for letter, cost, to, out in moves:
                go(2 * n + cost, "I" * n + letter, i + 1, to, tuple(made) + out)
        del name
        return min(found)

    cost, audit, out = best(0, "")
    return cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def plain_conversations(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        own = by[conv]
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        own += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    out = []
    signed = lambda t: (lambda v: v - (1 << 64) if v >> 63 else v)(xxhash.xxh64_intdigest(t.encode(), 42))
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], signed(r[2])))
        seen, judged = set(), []
        for _, role, text in own:
            left = text.strip(" \t\n\v\f\r")
            fault = "blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else None
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = {t for t, _, _ in own if t is not None}
        n = Counter(f for _, _, f in judged)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:], strict=False))
        cost, audit, sha = plain_repair(tuple(judged))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, sha))
    return out


def conversation_rows():
    rng = random.Random(11)
    texts = ["Hello.", "cut off", "", " \n", "Yes!", "Why? ", "ends in nbsp. ", None] + [f"{k}." for k in range(40)]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    rows = []
    for conv in [*range(120), None]:
        for turn in range(rng.randint(0, 14)):
            rows.append((conv, None if rng.random() < 0.03 else turn + 5 * (rng.random() < 0.05), rng.choice(roles), rng.choice(texts)))
    rows += [(500, k, "user", f"{k}.") for k in range(200)] + [(501, k, ("user", "assistant")[k % 2], "same.") for k in range(90)] + [(502, 7, "user", "a.")] * 4
    return rows + rows[:20]


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_conversations_in_chunks_of_any_size(spark, chunk):
    rows = conversation_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit(1)).repartition(6)
    got = conversations.damaged_and_repaired(df, chunk=chunk)
    assert Counter(map(tuple, got.collect())) == Counter(plain_conversations(rows))
    assert conversations.damaged_and_repaired(df.limit(0)).count() == 0


def test_given_conversations(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = queries.op12_conversation_repair(spark, sf_dir)
    assert Counter(map(tuple, got.collect())) == Counter(plain_conversations([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]))


def test_long_runs_multiply_by_binary_powers():
    powers = conversations.Powers()
    for symbol in conversations.SYMBOLS:
        after = conversations.END
        for _ in range(1000):
            after = conversations.times(powers.kept[symbol][0], after)
        assert (powers.before(symbol, 1000, conversations.END) == after).all()
    assert len(powers.kept["u"]) == 10  # and no more matrices than bits
    assert powers.before("x", 1 << 40, conversations.END)[0] == min(3 << 40, conversations.FAR)


# ---------------------------------------------------------------- words


def plain_words(rows, thinned=31):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if thinned and h % thinned == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 7
    n = {w: k for w, k in n.items() if k >= 2}
    by = defaultdict(set)  # a word with one place open, or one place put in
    for w in n:
        for k in range(len(w)):
            by[w[:k] + "\0" + w[k + 1 :]].add(w)
        for k in range(len(w) + 1):
            by[w[:k] + "\0" + w[k:]].add(w)
    near = defaultdict(set)
    for words in by.values():
        for w in words:
            near[w] |= words - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def word_rows():
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randint(7, 10))) for _ in range(50)] + ["aaaaaaa", "aaaaaaaa", "abababab", "babababa", "ababababa", "Straßenbahn", "naïveté×÷ÿ"]
    rows = []
    for k in range(200):
        words = []
        for _ in range(60):
            w = rng.choice(base[: 1 + int(57 * rng.random() ** 2)])
            if rng.random() < 0.3:
                at = rng.randrange(len(w) + 1)
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abcdéz") + w[at:], w[:at] + rng.choice("abcdéz") + w[at + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((k, " ".join(words)))
    return rows + [(None, rows[0][1]), (5, rows[1][1]), (7, None), (8, ""), (9, "aaaaaaa " * 20000)]


@pytest.mark.parametrize("settings", [{}, {"shard_words": 100, "split": 30}])
def test_variants_of_made_words(spark, settings):
    rows = word_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(0)).repartition(3)
    want = plain_words(rows)
    assert Counter(map(tuple, spelling.variants(df, **settings).collect())) == Counter(want)
    assert any(r[1] and r[2] != r[1] for r in want)  # forms follow forms
    assert spelling.variants(df.limit(0)).count() == 0


def test_variants_of_the_given_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, queries.op13_spelling_variants(spark, sf_dir).collect())) == Counter(plain_words(rows))


def test_index_finds_what_all_pairs_have():
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abz") for _ in range(rng.randint(7, 9))) for _ in range(400)})
    index = spelling.BiIndex(words)
    for left in (True, False):
        a, b = spelling.near(index, words, left)
        got = set(zip(a.tolist(), b.tolist(), strict=True))
        half = lambda x, w: x.endswith(w[len(w) // 2 :]) if left else x.startswith(w[: len(w) // 2])  # noqa: E731, B023
        want = {(i, j) for i, w in enumerate(words) for j, v in enumerate(words) if one_edit(w, v) and half(v, w)}
        assert got == want and all(index.words[j] == words[j] for _, j in got)
