"""Queries of this subpackage: opN_<name> over whole tables, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .ann import search

    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_documents(spark, sf_dir), tokenizer_path())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = _documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out_column().alias("held_out"), "score", "predicted", "language")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import repeated_words

    return repeated_words(_documents(spark, sf_dir))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import overlap

    return overlap(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(_documents(spark, sf_dir))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardups import near_components

    return near_components(_documents(spark, sf_dir))


def op8_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pagetext import extract_text

    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfile import token_files

    return token_files(spark, _documents(spark, sf_dir), tokenizer_path())


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencounts import token_counts

    return token_counts(_documents(spark, sf_dir), vocabulary_path())


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secretscan import scan_secrets

    return scan_secrets(_documents(spark, sf_dir))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    return resample(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_cross_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .crosstok import cross_alignment

    return cross_alignment(_documents(spark, sf_dir), vocabulary_path(), model_path())


QUERIES = {
    f.__name__: f
    for f in (
        op1_nearest_neighbours, op2_packing, op3_toxicity, op4_substring_dedup, op5_decontamination, op6_license_scan, op7_near_duplicates, op8_page_text,
        op9_token_files, op10_token_counts, op11_secret_scan, op12_importance, op13_cross_alignment,
    )
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words of the three kinds that the contracts name.
_ALNUM = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PLAIN = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_PLAIN_LOWER = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+')"

OP5_SQL = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_ALNUM} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS w
  FROM (SELECT item_id, ws, least(10, len(ws)) AS k, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS w
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(ws) >= k)),
hit AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, w)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op6_sql() -> str:
    from .licenses import BASE, TEMPLATES, Template

    place = "[i - 1 FOR i IN range(1, len(ws) + 1) IF {test}]"
    places = {
        label: place.format(test=" AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(phrase.split())))
        for phrase, label in BASE.items()
    }
    columns = ", ".join(f"{p} AS p{k}" for k, p in enumerate(places.values()))
    every = " || ".join(f"p{k}" for k in range(len(places)))
    base = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in enumerate(places))
    more = ", ".join(f"CASE WHEN regexp_matches(norm, '{Template.regex(t)}') THEN '{label}' END" for label, t in TEMPLATES.items())
    joined = "array_to_string(list_sort(list_distinct({})), ',')"
    return f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS ws FROM documents),
p AS (SELECT doc_id, ws, ' ' || array_to_string(ws, ' ') || ' ' AS norm, {columns} FROM d),
q AS (SELECT doc_id, ws, {every} AS places, list_filter([{base}], lambda x: x IS NOT NULL) AS b, list_filter([{more}], lambda x: x IS NOT NULL) AS t FROM p)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) AS BIGINT) AS first_word,
  CAST(list_max(places) AS BIGINT) AS last_word, {joined.format("b")} AS base_labels, {joined.format("b || t")} AS labels,
  CASE WHEN len(t) > 0 THEN 1.0::DOUBLE WHEN len(b) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM q
"""


OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_PLAIN} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
low AS (SELECT w, min(doc_id) AS low FROM win GROUP BY w),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM win JOIN low USING (w) WHERE low < doc_id),
words AS (SELECT doc_id, ws[i] AS word, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP7_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_PLAIN_LOWER} AS ws FROM documents),
sets AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * shared >= 75 * (p.n + q.n - shared)),
near AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, near.b FROM reach JOIN near ON near.a = reach.r),
comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM comp LEFT JOIN size USING (doc_id)
"""


def op11_sql() -> str:
    """Matches of each kind by the pieces between them; checksums bit by bit and symbol by symbol."""
    from .secretscan import BASE62, BECH32, BECH32_GENERATOR, KINDS, bech32_holds, crc_holds

    step = "xor(c >> 1, CASE WHEN (c + x) % 2 = 1 THEN 3988292384 ELSE 0 END)"
    bits = "flatten([[(ascii(x) >> k) & 1 FOR k IN range(8)] FOR x IN string_split(m[-36:-7], '')])"
    crc = f"xor(list_reduce([4294967295::BIGINT] || {bits}, lambda c, x: {step}), 4294967295)"
    digits = " || ".join(f"substr('{BASE62}', CAST(({crc}) // {62**k} % 62 + 1 AS INTEGER), 1)" for k in range(5, -1, -1))
    human = "string_split(lower(m)[1:n - 59], '')"
    symbols = f"[CAST(instr('{BECH32}', x) - 1 AS BIGINT) FOR x IN string_split(lower(m)[-58:], '')]"
    values = f"[1::BIGINT] || [ascii(x) >> 5 FOR x IN {human}] || [0] || [ascii(x) & 31 FOR x IN {human}] || {symbols}"
    mixed = "xor((c & 33554431) << 5, x)"
    for k, g in enumerate(BECH32_GENERATOR):
        mixed = f"xor({mixed}, CASE WHEN (c >> {25 + k}) & 1 = 1 THEN {g} ELSE 0 END)"
    checks = {crc_holds: f"m[-6:] = {digits}", bech32_holds: f"list_min({symbols}) >= 0 AND list_reduce({values}, lambda c, x: {mixed}) = 1", None: "true"}
    parts = []
    for i, k in enumerate(KINDS):
        pattern = k.pattern.replace("'", "''")
        size = f"length(regexp_extract(m, '{pattern}', {k.group}))"
        keep = f"{size} >= {k.least} AND {size} <= {k.most or 'length(m)'} AND {checks[k.holds]}"
        parts.append(f"""SELECT doc_id, t, {i} AS kind, '{k.name}' AS name, {str(k.base).lower()} AS base, first, first + n AS last FROM (
  SELECT *, length(m) AS n, sum(length(piece)) OVER w + sum(length(m)) OVER w - length(m) AS first FROM (
    SELECT doc_id, t, unnest(found) AS m, unnest(string_split_regex(text, '{pattern}')[1:len(found)]) AS piece, unnest(range(len(found))) AS i
    FROM (SELECT *, regexp_extract_all(text, '{pattern}') AS found FROM d)) WINDOW w AS (PARTITION BY t ORDER BY i)) WHERE {keep}""")
    spans = " UNION ALL ".join(parts)
    listed = "coalesce(string_agg(name || ':' || CAST(first AS BIGINT) || ':' || CAST(last AS BIGINT), ',' ORDER BY first, kind){}, '')"
    counts = ", ".join(f"count(*) FILTER (kind = {i}) AS n_{k.name}" for i, k in enumerate(KINDS[:3]))
    return f"""
WITH d AS (SELECT row_number() OVER () AS t, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({spans})
SELECT d.doc_id, {counts}, sha256({listed.format(" FILTER (base)")}) AS base_sha256, {listed.format("")} AS spans
FROM d LEFT JOIN spans USING (t) GROUP BY d.t, d.doc_id
"""


# crc32 is linear: a byte at distance d from the end adds roll(d, byte), the initial state roll(length, 256).
OP12_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_ALNUM} AS ws FROM documents),
words AS (SELECT row_number() OVER () AS t, true AS corpus, doc_id, ws FROM d UNION ALL SELECT -row_number() OVER (), false, null, {_ALNUM} FROM benchmark),
one AS (SELECT t, corpus, ws, unnest(range(1, len(ws) + 1)) AS i FROM words),
f AS MATERIALIZED (SELECT t, corpus, unnest(CASE WHEN i < len(ws) THEN [ws[i], ws[i] || ' ' || ws[i + 1]] ELSE [ws[i]] END) AS f FROM one),
distinct_f AS MATERIALIZED (SELECT f, hex(encode(f)) AS h, strlen(f) AS n FROM (SELECT DISTINCT f FROM f)),
bytes AS (SELECT b, list_reduce([CAST(b AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(b)),
roll AS (SELECT CAST(0 AS BIGINT) AS d, b AS k, c FROM bytes UNION ALL SELECT 0, 256, 4294967295
  UNION ALL SELECT d + 1, roll.k, xor(roll.c >> 8, bytes.c) FROM roll JOIN bytes ON bytes.b = roll.c & 255 WHERE d < (SELECT max(n) FROM distinct_f)),
places AS (SELECT f, n - 1 - i AS d, 16 * (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) + instr('0123456789ABCDEF', h[2 * i + 2]) - 1 AS k
  FROM (SELECT f, h, n, unnest(range(n)) AS i FROM distinct_f) UNION ALL SELECT f, n, 256 FROM distinct_f),
bucket AS MATERIALIZED (SELECT f, xor(bit_xor(c), 4294967295) % 10000 AS b FROM places JOIN roll USING (d, k) GROUP BY f),
placed AS MATERIALIZED (SELECT t, corpus, b FROM f JOIN bucket USING (f)),
n AS (SELECT b, count(*) FILTER (corpus) AS s, count(*) FILTER (NOT corpus) AS t FROM placed GROUP BY b),
gain AS (SELECT b, floor(1000 * ln((t + 1.0::DOUBLE) * ((SELECT sum(s) FROM n)::DOUBLE + 10000) / ((s + 1.0::DOUBLE) * ((SELECT sum(t) FROM n)::DOUBLE + 10000)))) AS g FROM n),
weight AS (SELECT t, count(*) AS n_features, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight FROM placed JOIN gain USING (b) WHERE corpus GROUP BY t),
hashed AS (SELECT t, doc_id, len(ws) AS n_words, list_reduce([CAST(instr('0123456789abcdef', x) - 1 AS BIGINT) FOR x IN string_split(sha256('7:' || doc_id)[1:8], '')], lambda a, x: 16 * a + x) AS h
  FROM words WHERE corpus),
scored AS (SELECT doc_id, n_words >= 20 AS may, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM hashed LEFT JOIN weight USING (t)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id) AS r, count(*) FILTER (may) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND r <= 25 * n // 100 THEN r END AS rank FROM ranked
"""

ORACLE_SQL: dict[str, str] = {"op11_secret_scan": op11_sql(), "op12_importance": OP12_SQL, "op7_near_duplicates": OP7_SQL, "op4_substring_dedup": OP4_SQL, "op5_decontamination": OP5_SQL, "op6_license_scan": op6_sql()}
