"""The table of overlap counts of the n-gram join against plain sets."""

import random

from tessella.llm import ngram_join


def shingled(text):
    w = (text or "").split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def edited(rng, words, n):
    words = list(words)
    for k in rng.sample(range(len(words)), n):
        words[k] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def many(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def plain_links(rows, percent=75):
    least = {}
    for i, t in rows:
        if s := shingled(t):
            least[s] = min(i, least.get(s, i))
    sets = sorted((i, s) for s, i in least.items())
    out = []
    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            both = len(s & t)
            if 100 * both >= percent * (len(s) + len(t) - both):
                out.append((j, i, both, len(t), len(s)))
    return sorted(out)


def test_overlap_counts_equal_brute_force(spark):
    """A linked group, a group under the threshold that shares a hot passage, exact copies, texts longer than one piece of a
    set (on both sides of a step of their number too), and texts of few or no words."""
    rng = random.Random(21)
    base, passage = many(rng, 120), many(rng, 30)
    texts = [edited(rng, base, rng.randrange(0, 7)) for _ in range(70)]
    texts += [" ".join(passage + many(rng, 40)) for _ in range(60)]
    texts += [texts[3]] * 5 + [None, "", " ", "one two", "one two", "one two three"]
    for n in (8100, 8190, 8196, 16_380, 40_000):
        long = many(rng, n)
        texts += [" ".join(long), edited(rng, long, n // 100), edited(rng, long, n // 50) + " " + " ".join(many(rng, n // 50)), edited(rng, long, n // 12)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for how in ({}, {"block": 4, "hot": 30, "cell": 16}):
        got = sorted(tuple(r) for r in ngram_join.overlaps(df, **how).select("a", "b", "both", "n_a", "n_b").collect())
        assert got == plain_links(rows)


def test_overlap_counts_at_other_thresholds_and_of_nothing(spark):
    rng = random.Random(22)
    base = many(rng, 100)
    rows = [(k, edited(rng, base, k % 12)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in ngram_join.overlaps(df, percent=30).collect())
    assert got == plain_links(rows, 30)
    assert ngram_join.overlaps(df.where("doc_id < 0")).count() == 0
