"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from tessella.llm import secrets

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

JACCARD_LINKS = f"""
w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                                                  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
"""

OP2 = f"""
WITH RECURSIVE {JACCARD_LINKS}
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id,
       CASE WHEN len(s.s) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY s.s) END::BIGINT AS copies
FROM s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = s.doc_id
"""

OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS least FROM pages)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = least THEN NULL ELSE least END AS refers_to
FROM p
"""


def _spans(name: str, pattern: str, kind: int, least: int) -> str:
    """A table of the spans of one pattern: (doc_id, start, kind, end, text)."""
    p = pattern.replace("'", "''")
    group = f"regexp_extract_all(text, '{p}', 1)" if least else "[]"
    keep = f"WHERE length(g) >= {least}" if least else ""
    return f"""
{name}_all AS (SELECT doc_id, string_split_regex(text, '{p}') AS p, regexp_extract_all(text, '{p}') AS m, {group} AS g FROM t WHERE regexp_matches(text, '{p}')),
{name}_rows AS (SELECT doc_id, p, m, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS text, {"unnest(g)" if least else "NULL"} AS g FROM {name}_all),
{name} AS (SELECT doc_id, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT AS a, {kind} AS kind, text, g FROM {name}_rows),
{name}_spans AS (SELECT doc_id, a, kind, (a + length(text))::BIGINT AS b, text FROM {name} {keep})"""


def _case(i: int) -> str:
    return " ".join(["CASE", *(f"WHEN enc = '{e}' THEN {v[i]}::DOUBLE" for e, v in secrets.ENCODINGS.items()), "END"])


def _joined(table: str, where: str = "true") -> str:
    names = "['assign', 'access', 'hex', 'random']"
    return f"(SELECT doc_id, string_agg({names}[kind + 1] || ':' || a || ':' || b, ',' ORDER BY a, kind) AS s FROM {table} WHERE {where} GROUP BY doc_id)"


def _tested(name: str, source: str) -> str:
    """Tables that add size and score to the rows of source (text, enc and more), as the battery does."""
    return f"""
{name}1 AS (SELECT *, length(text)::BIGINT AS n, string_split(text, '') AS chars FROM ({source}) WHERE enc IS NOT NULL),
{name}2 AS (SELECT *, {_case(0)} AS k, {_case(1)} AS share, list_transform(chars, lambda x: ascii(x)::BIGINT) AS codes,
  list_sum(list_transform(list_distinct(chars), lambda x: pow(n - length(replace(text, x, '')), 2)::BIGINT))::BIGINT AS squares,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[a-z]', 'l', 'g'), '[A-Z]', 'u', 'g'), '[0-9]', 'd', 'g'), '[^lud]', 'o', 'g') AS classes FROM {name}1),
{name}3 AS (SELECT *, list_sum(list_transform(range(2, n + 1), lambda i: CASE WHEN classes[i] <> classes[i - 1] THEN 1 ELSE 0 END))::BIGINT AS changes,
  list_sum(codes)::BIGINT AS total, list_sum(list_transform(codes, lambda x: x * x))::BIGINT AS squared,
  list_sum(list_transform(range(1, n + 1), lambda i: codes[i] * codes[i % n + 1]))::BIGINT AS lagged, length(bin(n)) - 1 AS power FROM {name}2),
{name}4 AS (SELECT *, ((k - 1) - (k * squares / n - n)) / sqrt(2 * (k - 1)) AS z_chi, (changes - (n - 1) * share) / sqrt((n - 1) * share * (1 - share)) AS z_runs,
  CASE WHEN n * squared - total * total > 0 THEN abs(n * lagged - total * total) * sqrt(n::DOUBLE) / (n * squared - total * total) ELSE 500.0::DOUBLE END AS z_serial FROM {name}3),
{name} AS (SELECT *, least({secrets.LONGEST}, 4 * power + floor(4 * n / pow(2::DOUBLE, power)) - 4)::INT AS size,
  floor(least(20.0::DOUBLE, greatest(-500.0::DOUBLE, z_chi + z_runs - z_serial)) * {secrets.STEPS})::INT AS score FROM {name}4)"""


_SEED = "('0x' || substr(seed, ({}), {}))::BIGINT"
_FORMS = {
    "camel": "array_to_string(capital, '')",
    "numbered": f"array_to_string(list_transform(range(1, many + 1), lambda i: capital[i] || CASE WHEN (i - 1) % 3 = 2 THEN ({_SEED.format('1 + (i - 1) % 29', 2)} % 100)::VARCHAR ELSE '' END), '')",
    "path": "array_to_string(words, '/')",
    "upper": "upper(array_to_string(words, ''))",
    "decimal": "substr(array_to_string(list_transform(places, lambda k: k::VARCHAR), ''), 1, 255)",
}
_ARTIFICIAL = " UNION ALL ".join(f"SELECT '{f}' AS form, '{secrets.FORMS[f]}' AS enc, {x} AS text FROM a3 WHERE {_SEED.format(5, 4)} % {len(_FORMS)} = {k}" for k, (f, x) in enumerate(_FORMS.items()))
_BARE = "translate(text, '-_=', '+/')"
_BASE64 = f"substr({_BARE}, 1, length({_BARE}) - CASE WHEN length({_BARE}) % 4 = 1 THEN 1 ELSE 0 END)"
_WHOLE = "'^([A-Za-z0-9+/]+|[A-Za-z0-9_-]+)=*$'"
_DECODED = f"""CASE WHEN regexp_matches(text, '{secrets.HEXED}') THEN try(decode(unhex(substr(text, 1, length(text) // 2 * 2))))
  WHEN regexp_matches(text, {_WHOLE}) THEN try(decode(from_base64(rpad({_BASE64}, ((length({_BASE64}) + 3) // 4 * 4)::INT, '=')))) END"""
_PRIOR = ", ".join(f"('{f}', '{e}', {size}, {m!r}::DOUBLE, {s!r}::DOUBLE)" for f, e, size, m, s in secrets.prior_laws())

OP1 = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{_spans("assign", secrets.ASSIGN, 0, 8)}, {_spans("access", secrets.ACCESS, 1, 0)}, {_spans("hex", secrets.HEX, 2, 0)}, {_spans("random", secrets.CANDIDATE, 3, 0)},
base AS (FROM assign_spans UNION ALL FROM access_spans UNION ALL FROM hex_spans),
c AS (SELECT *, CASE WHEN coalesce(NOT regexp_matches({_DECODED}, '{secrets.CONTROL}'), false) THEN NULL
       WHEN regexp_matches(text, '{secrets.HEXED}') THEN 'hex' WHEN regexp_matches(text, '^[A-Z2-7]+=*$') THEN 'base32'
       WHEN regexp_matches(text, {_WHOLE}) THEN 'base64' END AS enc
  FROM random_spans r WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = r.doc_id AND b.a < r.b AND r.a < b.b)),
{_tested("tested", "FROM c")},
a0 AS (SELECT md5(text) AS seed, text FROM t),
a1 AS (SELECT seed, regexp_extract_all(substr(text, {_SEED.format(9, 8)} % greatest(1, length(text) - {secrets.WINDOW} + 1) + 1, {secrets.WINDOW}), '{secrets.WORD}') AS found FROM a0),
a2 AS (SELECT *, {list(secrets.WORDS_OF)}[({_SEED.format(1, 4)} % {len(secrets.WORDS_OF)} + 1)::INT]::BIGINT AS many FROM a1 WHERE len(found) >= 3),
a21 AS (SELECT *, list_transform(range(0, many), lambda i: ({_SEED.format("1 + i % 27", 6)} + i * 7919) % len(found) + 1) AS places FROM a2),
a22 AS (SELECT *, list_transform(places, lambda k: lower(found[k])) AS words FROM a21),
a3 AS (SELECT *, list_transform(words, lambda w: upper(substr(w, 1, 1)) || substr(w, 2, 20)) AS capital FROM a22),
{_tested("null_", f"SELECT * FROM ({_ARTIFICIAL}) WHERE length(text) BETWEEN 20 AND 255")},
prior AS (SELECT * FROM (VALUES {_PRIOR}) v(form, enc, size, m, s)),
found_ AS (SELECT form, size, count(*) AS n, quantile_cont(score, 0.5)::DOUBLE AS a, quantile_cont(score, 0.95)::DOUBLE AS b FROM null_ GROUP BY ALL),
law AS (SELECT form, enc, size, (coalesce(n, 0) * coalesce(a, 0) + {secrets.WEIGHT} * m) / (coalesce(n, 0) + {secrets.WEIGHT}) AS mean,
  (coalesce(n, 0) * (coalesce(b, 0) - coalesce(a, 0)) / 1.645::DOUBLE + {secrets.WEIGHT} * s) / (coalesce(n, 0) + {secrets.WEIGHT}) AS spread FROM prior LEFT JOIN found_ USING (form, size)),
h AS (SELECT enc, size, score, count(*) AS n FROM tested GROUP BY ALL),
z AS (SELECT *, (score - mean) / spread AS z FROM h JOIN law USING (enc, size)),
p AS (SELECT enc, size, score, n, max(CASE WHEN z > 0 THEN 0.5::DOUBLE * exp(-0.717::DOUBLE * z - 0.416::DOUBLE * z * z) ELSE 1.0 END) AS p FROM z GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY enc, size ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS rank, sum(n) OVER (PARTITION BY enc, size) AS everything FROM p),
least_ AS (SELECT enc, size, min(score) AS least FROM r WHERE p * everything <= {secrets.FDR}::DOUBLE * rank GROUP BY enc, size),
every AS (FROM base UNION ALL SELECT doc_id, a, kind, b, text FROM tested JOIN least_ USING (enc, size) WHERE score >= least)
SELECT t.doc_id, (SELECT count(*) FROM base b WHERE b.doc_id = t.doc_id AND kind = 0) AS n_assign, (SELECT count(*) FROM base b WHERE b.doc_id = t.doc_id AND kind = 1) AS n_access,
  (SELECT count(*) FROM base b WHERE b.doc_id = t.doc_id AND kind = 2) AS n_hex, sha256(coalesce(x.s, '')) AS base_sha256, coalesce(y.s, '') AS spans
FROM t LEFT JOIN {_joined("base")} x ON x.doc_id = t.doc_id LEFT JOIN {_joined("every")} y ON y.doc_id = t.doc_id
"""

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP11 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM d),
k AS (SELECT *, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, line, place, (r.key IS NOT NULL AND k.doc_id <> r.last) AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

ORACLE_SQL: dict[str, str] = {"op1_secret_scans": OP1, "op2_ngram_join": OP2, "op8_warc": OP8, "op11_line_dedup": OP11}
