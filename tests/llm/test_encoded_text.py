"""Encoded text is no secret, random keys beside it are."""

import base64
import random
from collections import Counter

import duckdb

from tessella.llm import secrets
from tessella.llm.oracles import OP1


def test_encoded_text_is_no_secret(spark, sf_dir, tmp_path):
    rng = random.Random(41)
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    prose = [r["text"] for r in given.collect() if r["text"] and len(r["text"]) > 300]
    accented = "Überall größere Bäche, où l'été était très doux, и ещё немного слов 日本語の文章です "
    forms = {
        "base64": lambda b: base64.b64encode(b).decode(),
        "base64url": lambda b: base64.urlsafe_b64encode(b).decode(),
        "bare": lambda b: base64.b64encode(b).decode().rstrip("="),
        "hex": lambda b: b.hex().upper(),
    }
    plain, keys = [], []
    for name, form in forms.items():
        for k in range(100):
            text = (accented * 3 if k % 10 == 0 else rng.choice(prose))[k % 50 :]
            plain.append((name, form(text[: rng.randint(17, 200)].encode())))
            keys.append((name, form(rng.randbytes(rng.choice([24, 32, 48])))))
    rows = [(10_000 + k, f"a text with {t} in it") for k, (_, t) in enumerate(plain + keys)]
    frame = given.union(spark.createDataFrame(rows, "doc_id long, text string")).repartition(4)
    frame.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    digests = secrets.digests(frame).collect()
    spans = {r["doc_id"]: r["spans"] for r in digests}
    flagged = Counter(name for k, (name, _) in enumerate(plain) if "random" in spans[10_000 + k])
    found = Counter(name for k, (name, _) in enumerate(keys) if "random" in spans[10_000 + len(plain) + k])
    assert sum(flagged.values()) <= 4, flagged
    assert all(found[name] >= 95 for name in forms), found
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(OP1)
    assert Counter(tuple(r[c] for c in want.columns) for r in digests) == Counter(want.fetchall())
