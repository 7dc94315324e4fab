"""Parsing, signatures, segments, anomaly fusion, joins, patterns, hypotheses, clusters, chart tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.lineage import cut
from ..operators import anomaly, cluster, counts, crypto, hypotheses, ordinals, parse, patterns, quotations, resample, segments, signature, stability, stats
from ..sources import corpora
from .models import rounded
from .registry import BI, EVENTS, STREAMS, TOK, TURNS, query

# Line items as instruction notation, for example 17n(3)
NOTE = "note AS (SELECT l_orderkey AS doc, l_suppkey * 1000 + l_linenumber AS line, CAST(l_quantity AS INTEGER) || lower(l_returnflag) || '(' || l_linenumber || ')' || CAST(l_tax * 100 AS INTEGER) || '>l' AS text FROM lineitem)"


def notation(spark, d):
    i = corpora.table(spark, d, "lineitem")
    text = F.concat(F.col("l_quantity").cast("int"), F.lower("l_returnflag"), F.lit("("), F.col("l_linenumber"), F.lit(")"), F.round(F.col("l_tax") * 100).cast("int"), F.lit(">l"))
    return i.select(F.col("l_orderkey").alias("doc"), (F.col("l_suppkey") * 1000 + F.col("l_linenumber")).alias("line"), text.alias("text"))


@query("tokenize_flat", f"""WITH {NOTE} SELECT array_to_string(regexp_extract_all(lower(text), '\\([^()]*\\)|\\d+>?|<\\d+|[lpagxr]'), ' ') AS tokens, count(*) AS n FROM note GROUP BY 1""")
def tokenize_flat(spark, d):
    return notation(spark, d).select(F.array_join(parse.tokenize_flat(F.col("text")), " ").alias("tokens")).groupBy("tokens").agg(F.count("*").alias("n"))


@query("tokenize_nested", f"""WITH {NOTE} SELECT array_to_string(regexp_extract_all(lower(text), '\\([^()]*\\)|\\d+>?|<\\d+|[lpagxr]'), ' ') AS tokens, count(*) AS n FROM note GROUP BY 1""")
def tokenize_nested(spark, d):
    return notation(spark, d).select(F.array_join(parse.tokenize(F.col("text")), " ").alias("tokens")).groupBy("tokens").agg(F.count("*").alias("n"))


@query("enrich_tokens", f"""WITH {NOTE}, t AS (SELECT doc, line, regexp_extract_all(lower(text), '\\([^()]*\\)|\\d+>?|<\\d+|[lpagxr]') AS ts FROM note),
u AS (SELECT len(ts) AS n, unnest(ts) AS token, unnest(range(0, len(ts))) AS index FROM t)
SELECT index, token, round(CASE WHEN n > 1 THEN index / (n - 1) ELSE 0.0 END, 4) AS pos_norm, length(token) AS length, token LIKE '(%)' AS is_macro, CASE WHEN token LIKE '(%' THEN 1 ELSE 0 END AS depth, count(*) AS rows FROM u GROUP BY 1, 2, 3, 4, 5, 6""")  # fmt: skip
def enrich_tokens(spark, d):
    lines = notation(spark, d).select("doc", "line", parse.tokenize_flat(F.col("text")).alias("tokens"))
    return parse.enriched_counts(lines)


@query("expand_flat", f"""WITH {NOTE}, t AS (SELECT doc, line, regexp_extract_all(text, '\\(\\d+\\)|\\d+>|<\\d+|\\d*[A-Za-z]|\\d+') AS ps FROM note),
e AS (SELECT flatten([CASE WHEN regexp_full_match(p, '\\d+[A-Za-z]') THEN [right(p, 1) FOR i IN range(0, CAST(left(p, length(p) - 1) AS INTEGER))] ELSE [p] END FOR p IN ps]) AS tokens FROM t)
SELECT array_to_string(tokens, ' ') AS tokens, count(*) AS n FROM e GROUP BY 1""")  # fmt: skip
def expand_flat(spark, d):
    return notation(spark, d).select(F.array_join(parse.expand_flat(F.col("text")), " ").alias("tokens")).groupBy("tokens").agg(F.count("*").alias("n"))


@query("expand_full")
def expand_full(spark, d):
    out = parse.block_stats(parse.expand(notation(spark, d), "text"))
    return out.select("doc", "line", F.array_join("tokens", " ").alias("tokens"), "n_blocks", "repeats")


@query("expand_rows", f"""WITH {NOTE}, t AS (SELECT regexp_extract_all(lower(text), '\\(\\d+\\)|\\d|[lpgavxr]') AS ps FROM note),
e AS (SELECT flatten([CASE WHEN regexp_matches(p, '\\d') THEN ['l' FOR i IN range(0, CAST(regexp_extract(p, '\\d+') AS INTEGER))] ELSE [p] END FOR p IN ps]) AS tokens FROM t)
SELECT array_to_string(tokens, '') AS tokens, count(*) AS n FROM e GROUP BY 1""")  # fmt: skip
def expand_rows(spark, d):
    return notation(spark, d).select(F.array_join(parse.expand_row(F.col("text")), "").alias("tokens")).groupBy("tokens").agg(F.count("*").alias("n"))


@query("row_parser", """WITH t AS (SELECT o_orderkey || ' ' || o_orderpriority AS v FROM orders UNION ALL SELECT o_orderpriority FROM orders)
SELECT CAST(regexp_extract(v, '^(\\d+)\\s', 1) AS INTEGER) AS line, regexp_extract(v, '^\\d+\\s+(.*)$', 1) AS raw, count(*) AS n FROM t WHERE regexp_matches(v, '^\\d+\\s+\\S') GROUP BY 1, 2""")  # fmt: skip
def row_parser(spark, d):
    o = corpora.table(spark, d, "orders")
    rows = o.select(F.concat_ws(" ", "o_orderkey", "o_orderpriority").alias("v")).unionAll(o.select("o_orderpriority"))
    return parse.numbered_rows(rows, "v").groupBy("line", "raw").agg(F.count("*").alias("n"))


@query("name_cleaner", """WITH t AS (SELECT DISTINCT p_brand || '. ' || p_size || '. ' || p_type || '.txt' AS f FROM part UNION SELECT DISTINCT p_name || '.txt' FROM part)
SELECT CASE WHEN regexp_matches(s, '^[A-Za-z]+\\.\\s*[\\d\\-]+\\.\\s*.+$') THEN regexp_extract(s, '^([A-Za-z]+)\\.', 1) || '_' || trim(regexp_extract(s, '^[A-Za-z]+\\.\\s*[\\d\\-]+\\.\\s*(.+)$', 1)) ELSE s END AS name, count(*) AS n
FROM (SELECT regexp_replace(f, '\\.txt$', '') AS s FROM t) GROUP BY 1""")  # fmt: skip
def name_cleaner(spark, d):
    p = corpora.table(spark, d, "part")
    f = p.select(F.concat("p_brand", F.lit(". "), "p_size", F.lit(". "), "p_type", F.lit(".txt")).alias("f")).union(p.select(F.concat("p_name", F.lit(".txt")))).distinct()
    return f.groupBy(parse.clean_name(F.col("f")).alias("name")).agg(F.count("*").alias("n"))


@query("palindromes", f"WITH {TURNS}, {TOK} SELECT token, count(*) AS n FROM tok WHERE token = reverse(token) GROUP BY token")
def palindromes(spark, d):
    return parse.palindromes(counts.token_counts(corpora.conversation_lines(spark, d)), "token")


@query("symbol_pivot", """PIVOT (SELECT role, unnest(string_split(regexp_replace(lower(text), '[^a-zà-öø-ÿ]', '', 'g'), '')) AS c FROM conversations WHERE regexp_matches(lower(text), '[a-zà-öø-ÿ]')) ON c USING count(*) GROUP BY role""")
def symbol_pivot(spark, d):
    """A column for every letter that occurs; their number is bounded by the alphabet."""
    letters = F.regexp_replace(F.lower("text"), "[^a-zà-öø-ÿ]", "")
    chars = corpora.table(spark, d, "conversations").select("role", letters.alias("t")).where("t != ''").select("role", F.explode(F.split("t", "")).alias("c")).where("c != ''")
    return chars.groupBy("role").pivot("c").agg(F.count("c")).na.fill(0)


@query("substring_counts", """SELECT role, CAST(sum((length(text) - length(replace(text, 'th', ''))) / 2) AS BIGINT) AS th, CAST(sum((length(text) - length(replace(text, 'ere', ''))) / 3) AS BIGINT) AS ere FROM conversations GROUP BY role""")
def substring_counts(spark, d):
    t = corpora.table(spark, d, "conversations")
    return t.groupBy("role").agg(*(F.sum(scalars.overlap_free_count(F.col("text"), F.lit(p))).alias(p) for p in ("th", "ere")))


@query("truncated_text", "SELECT conv_id, turn, role, CASE WHEN length(text) > 24 THEN left(text, 23) || '...' ELSE text END AS head FROM conversations")
def truncated_text(spark, d):
    return corpora.table(spark, d, "conversations").select("conv_id", "turn", "role", scalars.truncated(F.col("text"), 24).alias("head"))


# Signatures: classes of event types
CLASSES = {"view": "C0", "click": "C0", "signup": "C1", "purchase": "C2"}  # error has none
CLS = "cls AS (SELECT * FROM (VALUES ('view', 'C0'), ('click', 'C0'), ('signup', 'C1'), ('purchase', 'C2')) v(token, class))"
SIGN = f"""{CLS}, ct AS (SELECT doc, line, class FROM tok LEFT JOIN cls USING (token)),
sg AS (SELECT doc, line, count(*) AS n, count(*) FILTER (class IS NULL) AS unknown, [coalesce(count(*) FILTER (class = 'C0') / nullif(count(class), 0), 0.0), coalesce(count(*) FILTER (class = 'C1') / nullif(count(class), 0), 0.0), coalesce(count(*) FILTER (class = 'C2') / nullif(count(class), 0), 0.0)] AS v FROM ct GROUP BY 1, 2)"""


def classes_of(spark):
    return spark.createDataFrame(list(CLASSES.items()), "token string, class string")


def signatures(spark, d):
    return signature.composition(signature.classified(corpora.event_lines(spark, d), classes_of(spark)), ["C0", "C1", "C2"])


def _parts(df):
    return df.select("doc", F.col("line").cast("string").alias("line"), *(c for c in df.columns if c not in ("doc", "line", "vector")))


@query("line_composition", f"WITH {EVENTS}, {TOK}, {SIGN} SELECT doc, CAST(line AS VARCHAR) AS line, n, unknown, round(v[1], 6) AS c0, round(v[2], 6) AS c1, round(v[3], 6) AS c2 FROM sg")
def line_composition(spark, d):
    s = signatures(spark, d)
    return _parts(s.withColumns({f"c{i}": F.round(F.col("vector")[i], 6) for i in range(3)}))


_COS = "CASE WHEN p IS NULL THEN NULL WHEN list_sum([x * x FOR x IN p]) * list_sum([x * x FOR x IN v]) = 0 THEN 1.0 ELSE 1 - greatest(-1, least(1, list_inner_product(p, v) / (sqrt(list_inner_product(p, p)) * sqrt(list_inner_product(v, v))))) END"


@query("line_jump_cosine", f"WITH {EVENTS}, {TOK}, {SIGN}, l AS (SELECT *, lag(v) OVER (PARTITION BY doc ORDER BY line) AS p FROM sg) SELECT doc, CAST(line AS VARCHAR) AS line, n, unknown, round({_COS}, 6) AS jump FROM l")
def line_jump_cosine(spark, d):
    return _parts(rounded(signature.jumps(signatures(spark, d)), "jump"))


_CENTER = "ctr AS (SELECT label, list(x ORDER BY i) AS p FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY label)"


@query("centroid_distance", f"WITH {_CENTER}, e AS (SELECT vec_id, label, p, embedding::DOUBLE[] AS v FROM embeddings JOIN ctr USING (label)), dd AS (SELECT vec_id, label, {_COS} AS distance FROM e) SELECT vec_id, label, round(distance, 6) AS distance, round(coalesce((distance - avg(distance) OVER (PARTITION BY label)) / nullif(stddev_pop(distance) OVER (PARTITION BY label), 0), 0), 4) AS z FROM dd")
def centroid_distance(spark, d):
    out = signature.centre_distance(corpora.table(spark, d, "embeddings"), "label", "embedding").drop("embedding")
    return rounded(rounded(out, "distance"), "z", digits=4)


@query("zscore_global", "SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), 6) AS z FROM events")
def zscore_global(spark, d):
    return rounded(stats.z_global(corpora.table(spark, d, "events"), "value", "z").select("event_id", "z"), "z")


@query("zscore_group", "SELECT event_id, event_type, round(coalesce((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 0), 6) AS z FROM events WINDOW w AS (PARTITION BY event_type)")
def zscore_group(spark, d):
    e = corpora.table(spark, d, "events")
    return e.select("event_id", "event_type", F.round(scalars.z_within(F.col("value"), "event_type"), 6).alias("z"))


@query("type_sequences", f"WITH {STREAMS} SELECT doc, array_to_string([coalesce(map {{'view': 'C0', 'click': 'C0', 'signup': 'C1', 'purchase': 'C2'}}[t], 'VOID') FOR t IN tokens], ' ') AS types, len(tokens) AS length FROM lines")
def type_sequences(spark, d):
    m = F.create_map(*(F.lit(x) for kv in CLASSES.items() for x in kv))
    lines = corpora.user_streams(spark, d)
    return lines.select("doc", F.array_join(F.transform("tokens", lambda t: F.coalesce(m[t], F.lit("VOID"))), " ").alias("types"), F.size("tokens").alias("length"))


# Series: the events of a user, scored by value and by errors
SER = """s0 AS (SELECT user_id, ts, event_id, value, CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END AS err FROM events),
s1 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, round((value - avg(value) OVER ()) / stddev_pop(value) OVER () + (err - avg(err) OVER ()) / stddev_pop(err) OVER (), 9) AS score FROM s0),
sc AS (SELECT *, score >= (SELECT quantile_cont(score, 0.6) FROM s1) AS high FROM s1)"""
RUNS = f"""{SER}, rr AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM sc WHERE high),
seg AS (SELECT user_id, min(i) AS first, max(i) AS last, count(*) AS length FROM rr GROUP BY user_id, g HAVING count(*) >= 3)"""


def series(spark, d):
    e = corpora.table(spark, d, "events").withColumn("err", F.when(F.col("event_type") == "error", 1.0).otherwise(0.0))
    e = e.select("user_id", "ts", "event_id", "event_type", "value", "err")
    z = stats.z_global(stats.z_global(e, "value", "z_g", "centred"), "err", "z_l", "centred").withColumn("score", F.round(F.col("z_g") + F.col("z_l"), 9))
    z = cut(z)
    return z.withColumn("high", F.col("score") >= F.lit(stats.percentile_values(z, "score", [0.6])[0]))


def user_runs(spark, d):
    return segments.maximal_runs(series(spark, d), ["user_id"], ["ts", "event_id"], F.col("high"))


def placed(spark, d):
    return ordinals.in_pieces(series(spark, d), ["user_id"], ["ts", "event_id"])[0].drop("piece_")


@query("combined_scores", f"WITH {SER} SELECT event_id, round(score, 6) AS score, high FROM sc")
def combined_scores(spark, d):
    return rounded(series(spark, d).select("event_id", "score", "high"), "score")


@query("maximal_runs", f"WITH {RUNS} SELECT user_id, first, last, length FROM seg")
def maximal_runs(spark, d):
    return user_runs(spark, d)


@query("gap_islands", """WITH n AS (SELECT DISTINCT l_suppkey, CAST(l_orderkey AS BIGINT) AS k FROM lineitem),
g AS (SELECT *, CASE WHEN k - lag(k) OVER (PARTITION BY l_suppkey ORDER BY k) > 20 THEN 1 ELSE 0 END AS new FROM n), i AS (SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY k) AS isl FROM g)
SELECT l_suppkey, min(k) AS first, max(k) AS last, count(*) AS length FROM i GROUP BY l_suppkey, isl HAVING count(*) >= 3""")  # fmt: skip
def gap_islands(spark, d):
    n = corpora.table(spark, d, "lineitem").select("l_suppkey", F.col("l_orderkey").cast("long").alias("k")).distinct()
    return segments.gap_islands(n, ["l_suppkey"], "k", gap=20)


@query("rolling_max_mean", """WITH r AS (SELECT user_id, CASE WHEN row_number() OVER w >= 5 THEN avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING) END AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, round(max(m), 6) AS max_mean FROM r GROUP BY user_id""")  # fmt: skip
def rolling_max_mean(spark, d):
    return rounded(segments.max_window_mean(corpora.table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", 5), "max_mean")


@query("segment_permutation", f"""WITH {RUNS}, sm AS (SELECT seg.*, avg(score) AS mean_score, sum(score) AS total_score FROM seg JOIN sc ON sc.user_id = seg.user_id AND sc.i BETWEEN first AND last GROUP BY ALL),
pm AS (SELECT sc.user_id, p AS perm, score, row_number() OVER (PARTITION BY sc.user_id, p ORDER BY md5(concat_ws('|', '42', p, sc.user_id, i))) AS j FROM sc SEMI JOIN seg USING (user_id), range(0, 50) r(p)),
ps AS (SELECT user_id, perm, j, sum(score) OVER (PARTITION BY user_id, perm ORDER BY j) AS s FROM pm UNION ALL SELECT DISTINCT user_id, p, 0, 0.0 FROM seg, range(0, 50) r(p)),
bt AS (SELECT a.user_id, a.perm, l.length, max((a.s - b.s) / l.length) AS best FROM ps a JOIN (SELECT DISTINCT user_id, length FROM seg) l ON l.user_id = a.user_id JOIN ps b ON b.user_id = a.user_id AND b.perm = a.perm AND b.j = a.j - l.length GROUP BY 1, 2, 3),
pv AS (SELECT sm.user_id, first, last, sm.length, mean_score, total_score, (count(*) FILTER (best >= mean_score - 1e-12) + 1) / (count(*) + 1) AS p FROM sm JOIN bt ON bt.user_id = sm.user_id AND bt.length = sm.length GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (ORDER BY p, user_id, first) AS r, count(*) OVER () AS m FROM pv), q AS (SELECT *, least(1.0, min(p * m / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS q FROM rk)
SELECT user_id, first, last, length, round(mean_score, 6) AS mean_score, round(total_score, 6) AS total_score, round(p, 6) AS p_value, round(q, 6) AS q_value, q <= 0.05 AS significant FROM q""")  # fmt: skip
def segment_permutation(spark, d):
    return rounded(segments.segment_significance(series(spark, d), "user_id", ["ts", "event_id"], 50), "mean_score", "total_score", "p_value", "q_value")


_GL = "z AS (SELECT sc.*, value > (SELECT quantile_cont(value, 0.9) FROM events) AS gram, err > 0 AS lex FROM sc)"
_CLASS = "CASE WHEN gram AND lex THEN 'CONVERGENT' WHEN gram THEN 'GRAMATICAL' WHEN lex THEN 'LEXICA' ELSE 'CAP' END"


def classed(spark, d):
    p = placed(spark, d)
    most = stats.percentile_values(corpora.table(spark, d, "events"), "value", [0.9])[0]
    z = p.withColumns({"gram": F.col("value") > F.lit(most), "lex": F.col("err") > 0})
    return z.withColumn("class", segments.line_class(F.col("gram"), F.col("lex")))


@query("segment_verdict", f"""WITH {RUNS}, {_GL}, c AS (SELECT z.*, {_CLASS} AS class FROM z),
s AS (SELECT seg.user_id, first, last, count(*) AS n, count(*) FILTER (class = 'CONVERGENT') AS n_conv, count(*) FILTER (class = 'GRAMATICAL') AS n_gram, count(*) FILTER (class = 'LEXICA') AS n_lex FROM seg JOIN c ON c.user_id = seg.user_id AND c.i BETWEEN first AND last GROUP BY 1, 2, 3)
SELECT *, round(n_gram / n, 6) AS frac_gram, round(n_lex / n, 6) AS frac_lex, CASE WHEN n_conv > 0 THEN 'CONVERGENCIA' WHEN n_gram > 0 AND n_lex = 0 THEN 'PERFIL_GRAMATICAL' WHEN n_lex > 0 AND n_gram = 0 THEN 'PERFIL_LEXIC' WHEN n_gram > 0 AND n_lex > 0 THEN 'MIXT' ELSE 'SENSE_SENYAL' END AS verdict FROM s""")  # fmt: skip
def segment_verdict(spark, d):
    m = segments.members(user_runs(spark, d), classed(spark, d), "user_id")
    c = F.col("class")
    s = m.groupBy("user_id", "first", "last").agg(F.count("*").alias("n"), F.count_if(c == "CONVERGENT").alias("n_conv"), F.count_if(c == "GRAMATICAL").alias("n_gram"), F.count_if(c == "LEXICA").alias("n_lex"))
    v = segments.verdict(F.col("n_conv"), F.col("n_gram"), F.col("n_lex"))
    return s.withColumns({"frac_gram": F.round(F.col("n_gram") / F.col("n"), 6), "frac_lex": F.round(F.col("n_lex") / F.col("n"), 6), "verdict": v})


@query("orphans_anti", f"WITH {RUNS}, {_GL} SELECT event_id, {_CLASS} AS class FROM z WHERE (gram OR lex) AND NOT EXISTS (SELECT 1 FROM seg WHERE seg.user_id = z.user_id AND z.i BETWEEN first AND last)")
def orphans_anti(spark, d):
    return segments.orphans(classed(spark, d).where("gram or lex"), user_runs(spark, d), "user_id").select("event_id", "class")


@query("covered_semi", f"WITH {RUNS}, {_GL} SELECT event_id, {_CLASS} AS class FROM z WHERE (gram OR lex) AND EXISTS (SELECT 1 FROM seg WHERE seg.user_id = z.user_id AND z.i BETWEEN first AND last)")
def covered_semi(spark, d):
    return segments.covered(classed(spark, d).where("gram or lex"), user_runs(spark, d), "user_id").select("event_id", "class")


@query("orphan_histogram", f"WITH {RUNS}, {_GL} SELECT {_CLASS} AS class, count(*) AS n FROM z WHERE (gram OR lex) AND NOT EXISTS (SELECT 1 FROM seg WHERE seg.user_id = z.user_id AND z.i BETWEEN first AND last) GROUP BY 1")
def orphan_histogram(spark, d):
    return segments.orphans(classed(spark, d).where("gram or lex"), user_runs(spark, d), "user_id").groupBy("class").agg(F.count("*").alias("n"))


# Flags over events: value, error, night, repeated type
FLAGS = """fl AS (SELECT event_id, user_id, value, abs(value - avg(value) OVER ()) / stddev_pop(value) OVER () >= 2 AS f_value, event_type = 'error' AS f_error, hour(ts) < 6 AS f_night,
coalesce(event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS f_repeat FROM events),
fc AS (SELECT *, f_value::INT + f_error::INT + f_night::INT + f_repeat::INT AS n_flags, (f_value OR f_night)::INT + (f_error OR f_repeat)::INT >= 2 AS cross FROM fl),
ca AS (SELECT *, CASE WHEN n_flags >= 3 THEN 'CRITICA' WHEN n_flags = 2 THEN 'ALTA' WHEN n_flags = 1 THEN 'MODERADA' ELSE 'NORMAL' END AS category FROM fc)"""


def flags(spark, d):
    e = stats.z_global(corpora.table(spark, d, "events"), "value", "z")
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    tests = {"f_value": F.abs("z") >= 2, "f_error": F.col("event_type") == "error", "f_night": F.hour("ts") < 6, "f_repeat": F.col("event_type") == before}
    return anomaly.flagged(e, tests, {"value": ["f_value", "f_night"], "type": ["f_error", "f_repeat"]})


@query("flags_category", f"WITH {FLAGS} SELECT event_id, f_value, f_error, f_night, f_repeat, n_flags, category FROM ca")
def flags_category(spark, d):
    return flags(spark, d).select("event_id", "f_value", "f_error", "f_night", "f_repeat", "n_flags", "category")


@query("cross_channel", f'WITH {FLAGS} SELECT "cross", category, count(*) AS n FROM ca GROUP BY 1, 2')
def cross_channel(spark, d):
    return flags(spark, d).groupBy("cross", "category").agg(F.count("*").alias("n"))


@query("doc_anomaly_agg", f"""WITH {FLAGS} SELECT user_id, count(*) AS n, count(*) FILTER (category = 'CRITICA') AS n_critica, count(*) FILTER (category = 'ALTA') AS n_alta, count(*) FILTER (category = 'MODERADA') AS n_moderada,
count(*) FILTER ("cross") AS n_cross, round(sum(value), 4) AS score_total, round(max(value), 6) AS score_max, round(avg(value), 6) AS score_mean FROM ca GROUP BY user_id""")  # fmt: skip
def doc_anomaly_agg(spark, d):
    return rounded(rounded(anomaly.doc_totals(flags(spark, d), "user_id", "value"), "score_max", "score_mean"), "score_total", digits=4)


@query("top_anomalies", f"WITH {FLAGS} SELECT event_id, category, n_flags, value FROM ca ORDER BY n_flags DESC, value DESC, event_id LIMIT 20")
def top_anomalies(spark, d):
    return flags(spark, d).orderBy(F.desc("n_flags"), F.desc("value"), "event_id").limit(20).select("event_id", "category", "n_flags", "value")


@query("first_component_score")
def first_component_score(spark, d):
    e = corpora.table(spark, d, "lineitem")
    return anomaly.first_component(e, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).select("l_orderkey", "l_linenumber", "score")


@query("untested_share", f"""WITH {EVENTS}, {BI}, cnt AS (SELECT a, b, count(*) AS n FROM bi GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS n_a, sum(n) OVER (PARTITION BY b) AS n_b, sum(n) OVER () AS total FROM cnt),
s AS (SELECT a, b, (n / n_a) / (n_b / total) > 1 AS significant FROM m WHERE n >= 3)
SELECT doc, CAST(line AS VARCHAR) AS line, count(significant) AS tested, count(*) FILTER (NOT significant) AS not_valid, round(count(*) FILTER (NOT significant) / nullif(count(significant), 0), 6) AS frac_not_valid FROM bi LEFT JOIN s USING (a, b) GROUP BY 1, 2""")  # fmt: skip
def untested_share(spark, d):
    lines = corpora.event_lines(spark, d)
    t = counts.with_margins(counts.bigram_counts(lines)).where("n >= 3")
    s = t.select("a", "b", ((F.col("n") / F.col("n_a")) / (F.col("n_b") / F.col("total")) > 1).alias("significant"))
    return _parts(rounded(anomaly.untested_share(corpora.bigrams_of(lines), s), "frac_not_valid"))


# Crypto
_RARE = "dt AS (SELECT doc, token, count(*) AS c FROM tok GROUP BY 1, 2), ra AS (SELECT doc, line, count(*) AS n_rare, array_to_string(list_sort(list(DISTINCT token)), ' | ') AS rare FROM tok JOIN dt USING (doc, token) WHERE c <= 2 GROUP BY 1, 2)"


@query("rare_tokens", f"WITH {TURNS}, {TOK}, {_RARE} SELECT * FROM ra")
def rare_tokens(spark, d):
    return crypto.rare_tokens(corpora.conversation_lines(spark, d))


@query("marker_stream", f"WITH {EVENTS}, mk AS (SELECT doc, line, [t FOR t IN tokens IF t NOT IN ('view', 'click')] AS m FROM lines) SELECT doc, CAST(line AS VARCHAR) AS line, array_to_string(m, ' ') AS markers, len(m) AS n FROM mk WHERE len(m) > 0")
def marker_stream(spark, d):
    m = crypto.markers(corpora.event_lines(spark, d), ["view", "click"]).where(F.size("tokens") > 0)
    return m.select("doc", F.col("line").cast("string").alias("line"), F.array_join("tokens", " ").alias("markers"), F.size("tokens").alias("n"))


from .models import RUNS as _RUNS  # noqa: E402


@query("candidate_priority", f"""WITH {STREAMS}, {TOK}, {_RUNS}, dt AS (SELECT doc, token, count(*) AS c FROM tok GROUP BY 1, 2),
ra AS (SELECT doc, line, count(*) AS n_rare, array_to_string(list_sort(list(DISTINCT token)), ' | ') AS rare FROM tok JOIN dt USING (doc, token) WHERE c <= 5 GROUP BY 1, 2),
od AS (SELECT doc, line, z FROM rz WHERE abs(z) > 1), mk AS (SELECT user_id AS doc, user_id AS line, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT coalesce(ra.doc, od.doc) AS doc, n_rare, rare, round(z, 6) AS z, errors, round(10 * coalesce(n_rare, 0) + abs(coalesce(z, 0)), 6) AS priority FROM ra FULL JOIN od ON ra.doc = od.doc AND ra.line = od.line LEFT JOIN mk ON mk.doc = coalesce(ra.doc, od.doc)""")  # fmt: skip
def candidate_priority(spark, d):
    pieces = corpora.user_pieces(spark, d)
    odd = stats.stream_runs_test(pieces, "view").where("abs(z) > 1")
    marked = corpora.table(spark, d, "events").where("event_type = 'error'").groupBy(F.col("user_id").alias("doc")).agg(F.count("*").alias("errors")).withColumn("line", F.col("doc"))
    out = crypto.candidates(crypto.rare_tokens(pieces, 5, whole=True), odd, marked)
    return rounded(out.select("doc", "n_rare", "rare", "z", "errors", "priority"), "z", "priority")


# Patterns over user days
_PAT = """g AS (SELECT doc, k AS length, array_to_string(tokens[i:i + k - 1], ' ') AS pattern FROM (SELECT *, unnest(range(1, len(tokens) - k + 2)) AS i FROM lines, (VALUES (2), (3), (4)) v(k) WHERE len(tokens) >= k)),
pat AS (SELECT pattern, length, count(DISTINCT doc) AS docs, count(*) AS n FROM g GROUP BY 1, 2 HAVING count(DISTINCT doc) >= 2)"""
_EDGE = "ed AS (SELECT p.pattern AS parent, c.pattern AS child FROM pat p JOIN pat c ON p.length > c.length AND contains(' ' || p.pattern || ' ', ' ' || c.pattern || ' '))"


def _patterns(spark, d):
    return patterns.shared_grams(corpora.event_lines(spark, d))


@query("shared_patterns", f"WITH {EVENTS}, {_PAT} SELECT pattern, length, docs, n FROM pat")
def shared_patterns(spark, d):
    return _patterns(spark, d)


@query("pattern_containment", f"WITH {EVENTS}, {_PAT}, {_EDGE} SELECT parent, child FROM ed")
def pattern_containment(spark, d):
    return patterns.containment(_patterns(spark, d))


@query("pattern_genealogy_reduced", f"WITH {EVENTS}, {_PAT}, {_EDGE} SELECT parent, child FROM ed WHERE NOT EXISTS (SELECT 1 FROM ed x JOIN ed y ON x.child = y.parent WHERE x.parent = ed.parent AND y.child = ed.child)")
def pattern_genealogy_reduced(spark, d):
    return patterns.reduced(patterns.containment(_patterns(spark, d)))


@query("pattern_ranking", f"WITH {EVENTS}, {_PAT} SELECT * FROM (SELECT pattern, length, docs, n, row_number() OVER (PARTITION BY length ORDER BY n DESC, pattern) AS rank FROM pat) WHERE rank <= 5")
def pattern_ranking(spark, d):
    return patterns.ranked_patterns(_patterns(spark, d), 5)


@query("repeated_patterns_greedy")
def repeated_patterns_greedy(spark, d):
    return patterns.repeated_patterns(corpora.user_streams(spark, d))


# Hypotheses
@query("morse_groups", """WITH g AS (SELECT conv_id, turn, [x FOR x IN regexp_split_to_array(lower(text), '[^et]+') IF x <> '' AND length(x) <= 5] AS g FROM conversations),
s AS (SELECT conv_id, turn, len(g) AS groups, array_to_string(g, '') AS j FROM g WHERE len(g) >= 20)
SELECT conv_id * 1000 + turn AS k, 'et' AS pair, groups, length(j) - length(replace(j, 'e', '')) AS n1, length(j) - length(replace(j, 't', '')) AS n2, round((length(j) - length(replace(j, 'e', ''))) / nullif(length(j) - length(replace(j, 't', '')), 0), 6) AS ratio FROM s""")  # fmt: skip
def morse_groups(spark, d):
    t = corpora.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text")
    return rounded(hypotheses.morse_test(t, "k", "text", [("e", "t")], 20).drop("reading"), "ratio")


@query("morse_readings")
def morse_readings(spark, d):
    t = corpora.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text")
    return hypotheses.morse_test(t, "k", "text", [("e", "t"), ("a", "n"), ("t", "e")], 20)


@query("local_discordance", """WITH lines AS (SELECT o_custkey AS doc, o_custkey AS line, list(o_orderstatus ORDER BY o_orderdate, o_orderkey) AS tokens FROM orders GROUP BY 1), w AS (SELECT doc, i, tokens[i:i + 7] AS w FROM (SELECT *, unnest(range(1, len(tokens) - 6)) AS i FROM lines WHERE len(tokens) >= 8)),
k AS (SELECT doc, i, w, (SELECT x FROM unnest(w) AS u(x) GROUP BY x HAVING count(*) = 7) AS ruler FROM w),
o AS (SELECT doc, i - 1 + p AS position, w[p + 1] AS symbol, ruler, i FROM (SELECT *, unnest(range(0, 8)) AS p FROM k WHERE ruler IS NOT NULL) WHERE w[p + 1] <> ruler)
SELECT doc, doc AS line, position, arg_min(symbol, i) AS symbol, arg_min(ruler, i) AS ruler FROM o GROUP BY doc, position""")  # fmt: skip
def local_discordance(spark, d):
    c = F.col
    lines = corpora.ordered_lines(corpora.table(spark, d, "orders"), c("o_custkey"), c("o_custkey"), c("o_orderstatus"), c("o_orderdate"), c("o_orderkey"))
    return hypotheses.local_discordance(lines)


_INSTRUCTION = "regexp_replace(replace(regexp_replace(lower(text), '\\s+', '', 'g'), '.)', ')'), '^\\d+[.\\-]', '')"
_QUOTED = """CASE WHEN text = quote THEN 'IDENTICA' ELSE 'SUBCADENA' END AS kind FROM l JOIN q ON text = quote OR length(quote) > 15 AND (contains(text, quote) OR contains(quote, text)) WHERE length(text) >= 1"""


# Whole normalised quotations; parts of those over 15 characters
@query("literal_match_whole", f"""WITH l AS (SELECT conv_id, turn, regexp_replace(lower(text), '\\s+', '', 'g') AS text FROM conversations), q AS (SELECT item_id, regexp_replace(lower(text), '\\s+', '', 'g') AS quote FROM benchmark)
SELECT conv_id, turn, item_id, {_QUOTED}""")  # fmt: skip
def literal_match_whole(spark, d):
    strip = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    lines = corpora.table(spark, d, "conversations").select("conv_id", "turn", strip("text").alias("text"))
    quotes = corpora.table(spark, d, "benchmark").select("item_id", strip("text").alias("quote"))
    return quotations.quotation_matches(lines, quotes).select("conv_id", "turn", "item_id", "kind")


@query("quotation_match", f"""WITH l AS (SELECT doc_id, line, {_INSTRUCTION} AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)),
q AS (SELECT item_id, {_INSTRUCTION} AS quote FROM benchmark)
SELECT doc_id, CAST(line AS BIGINT) AS line, item_id, {_QUOTED}""")  # fmt: skip
def quotation_match(spark, d):
    lines = corpora.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    lines = lines.select("doc_id", (F.col("line") + 1).cast("long").alias("line"), parse.normalized_instruction(F.col("t")).alias("text"))
    quotes = corpora.table(spark, d, "benchmark").select("item_id", parse.normalized_instruction(F.col("text")).alias("quote"))
    return quotations.quotation_matches(lines, quotes).select("doc_id", "line", "item_id", "kind")


# Clusters
@query("ari", """WITH c AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*) AS n FROM lineitem GROUP BY 1, 2), a AS (SELECT sum(n * (n - 1) / 2) AS sa FROM (SELECT sum(n) AS n FROM c GROUP BY x)), b AS (SELECT sum(n * (n - 1) / 2) AS sb FROM (SELECT sum(n) AS n FROM c GROUP BY y)),
t AS (SELECT sum(n * (n - 1) / 2) AS sc, sum(n) AS n FROM c)
SELECT CAST(n AS BIGINT) AS n, round((sc - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)), 6) AS ari FROM t, a, b""")  # fmt: skip
def ari(spark, d):
    return rounded(cluster.adjusted_rand(corpora.table(spark, d, "lineitem"), "l_returnflag", "l_linestatus"), "ari")


@query("silhouette_cosine", """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT vec_id, label, [x / sqrt(list_inner_product(v, v)) FOR x IN v] AS u FROM e),
s AS (SELECT label, list(x ORDER BY i) AS s, any_value(n) AS n FROM (SELECT label, i, sum(x) AS x, count(*) AS n FROM (SELECT label, unnest(u) AS x, unnest(range(0, len(u))) AS i FROM u) GROUP BY 1, 2) GROUP BY label),
d AS (SELECT u.vec_id, u.label, s.label AS other, CASE WHEN u.label = s.label THEN (n - 1 - (list_inner_product(u, s) - list_inner_product(u, u))) / nullif(n - 1, 0) ELSE 1 - list_inner_product(u, s) / n END AS d FROM u, s),
ab AS (SELECT vec_id, max(CASE WHEN label = other THEN d END) AS a, min(CASE WHEN label <> other THEN d END) AS b FROM d GROUP BY vec_id)
SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, count(*) AS n FROM ab""")  # fmt: skip
def silhouette_cosine(spark, d):
    return rounded(cluster.silhouette_cosine(corpora.table(spark, d, "embeddings"), "vec_id", "embedding", "label"), "silhouette")


@query("pca_scores")
def pca_scores(spark, d):
    v = cluster.reduced(cluster.vectors(corpora.table(spark, d, "embeddings"), "vec_id", "embedding"), 2)
    return cluster.as_array(v.select("vec_id", "pca"), "pca")


@query("kmeans_labels")
def kmeans_labels(spark, d):
    v = cluster.reduced(cluster.vectors(corpora.table(spark, d, "embeddings"), "vec_id", "embedding"), 5)
    return cluster.best_kmeans(v, 8, 2)[0].select("vec_id", "label")


@query("token_classes")
def token_classes(spark, d):
    """Classes of the words of conversations, by all their contexts, k from 2 to 18."""
    return stability.original_classes(corpora.conversation_lines(spark, d), range(2, 19))


@query("bootstrap_stability", """WITH r AS (SELECT conv_id AS doc, turn AS line, role, p AS rep, CAST('0x' || left(md5(concat_ws('|', '42', p, conv_id, turn)), 8) AS BIGINT) / 4294967296.0 AS u FROM conversations, range(0, 20) x(p)),
w AS (SELECT *, (u >= 0.36787944117144233)::INT + (u >= 0.7357588823428847)::INT + (u >= 0.9196986029286058)::INT + (u >= 0.9810118431238462)::INT + (u >= 0.9963401531726563)::INT + (u >= 0.9994058151824183)::INT + (u >= 0.9999167588507119)::INT AS weight FROM r)
SELECT rep, CAST(sum(weight) AS BIGINT) AS draws, count(*) AS lines FROM w WHERE weight > 0 GROUP BY rep""")  # fmt: skip
def bootstrap_stability(spark, d):
    out = resample.bootstrap_counts(corpora.conversation_lines(spark, d), 20)
    return out.groupBy("rep").agg(F.sum("weight").alias("draws"), F.count("*").alias("lines"))


# Chart tables
@query("unpivot_relative", """WITH u AS (UNPIVOT (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME metric VALUE value),
s AS (SELECT metric, count(*) AS n, sum(value) AS total FROM u WHERE value > 0 GROUP BY metric) SELECT metric, n, round(total, 2) AS total, round(total / (SELECT sum(total) FROM s), 6) AS share FROM s""")  # fmt: skip
def unpivot_relative(spark, d):
    i = corpora.table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax")
    s = i.unpivot([], ["l_quantity", "l_discount", "l_tax"], "metric", "value").where("value > 0").groupBy("metric").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    whole = s.agg(F.sum("total").alias("whole"))
    return s.join(F.broadcast(whole)).select("metric", "n", F.round("total", 2).alias("total"), F.round(F.col("total") / F.col("whole"), 6).alias("share"))


@query("transition_matrix", f"""WITH {EVENTS}, {BI}, c AS (SELECT a, b, count(*) AS n FROM bi GROUP BY 1, 2), p AS (SELECT a, b, n / sum(n) OVER (PARTITION BY a) AS p FROM c)
SELECT a, round(max(CASE WHEN b = 'click' THEN p END), 6) AS click, round(max(CASE WHEN b = 'error' THEN p END), 6) AS error, round(max(CASE WHEN b = 'purchase' THEN p END), 6) AS purchase, round(max(CASE WHEN b = 'signup' THEN p END), 6) AS signup, round(max(CASE WHEN b = 'view' THEN p END), 6) AS view FROM p GROUP BY a""")  # fmt: skip
def transition_matrix(spark, d):
    p = counts.transition_probs(corpora.event_lines(spark, d))
    return p.groupBy("a").pivot("b", ["click", "error", "purchase", "signup", "view"]).agg(F.round(F.max("p_b_given_a"), 6))


@query("symbol_rates", f"""WITH {TURNS}, {TOK}, c AS (SELECT doc, left(token, 1) AS symbol, count(*) AS n FROM tok GROUP BY 1, 2), i AS (SELECT doc, count(*) AS lines FROM lines GROUP BY doc) SELECT doc, symbol, round(n / greatest(coalesce(lines, 1), 1), 6) AS per_line FROM c LEFT JOIN i USING (doc)""")
def symbol_rates(spark, d):
    lines = corpora.conversation_lines(spark, d)
    c = corpora.tokens_of(lines).groupBy("doc", F.substring("token", 1, 1).alias("symbol")).agg(F.count("*").alias("n"))
    i = lines.groupBy("doc").agg(F.count("*").alias("lines"))
    return c.join(i, "doc", "left").select("doc", "symbol", F.round(F.col("n") / F.greatest(F.coalesce("lines", F.lit(1)), F.lit(1)), 6).alias("per_line"))


@query("score_quadrants", f"""WITH {SER}, z AS (SELECT (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS zg, (err - avg(err) OVER ()) / stddev_pop(err) OVER () AS zl FROM s0)
SELECT CASE WHEN zg >= 0 AND zl >= 0 THEN 'both' WHEN zg >= 0 THEN 'grammar' WHEN zl >= 0 THEN 'lexical' ELSE 'none' END AS quadrant, count(*) AS n FROM z GROUP BY 1""")  # fmt: skip
def score_quadrants(spark, d):
    g, x = F.col("z_g") >= 0, F.col("z_l") >= 0
    return series(spark, d).groupBy(F.when(g & x, "both").when(g, "grammar").when(x, "lexical").otherwise("none").alias("quadrant")).agg(F.count("*").alias("n"))


@query("label_sort", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY p_brand")
def label_sort(spark, d):
    return corpora.table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(*scalars.label_order(F.col("p_brand")))


@query("last_of_key", "SELECT l_orderkey, l_linenumber, arg_max(l_partkey, l_partkey * 100000 + l_suppkey) AS l_partkey FROM lineitem GROUP BY 1, 2")
def last_of_key(spark, d):
    rows = corpora.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("o"))
    return corpora.last_of_key(rows, ["l_orderkey", "l_linenumber"], "o").drop("o")


@query("label_triangulation", """WITH f AS (SELECT d.doc_id, quality, toxic, CASE WHEN toxic = 1 AND quality = 0 THEN 'CONVERGENT' WHEN toxic = 1 THEN 'GRAMATICAL' WHEN quality = 0 THEN 'LEXICA' WHEN quality IS NULL THEN 'ORFE' ELSE 'CAP' END AS class FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT class, count(*) AS n FROM f GROUP BY class""")  # fmt: skip
def label_triangulation(spark, d):
    f = corpora.table(spark, d, "documents").select("doc_id").join(corpora.table(spark, d, "labels"), "doc_id", "left")
    t, q = F.col("toxic") == 1, F.col("quality") == 0
    return f.groupBy(F.when(t & q, "CONVERGENT").when(t, "GRAMATICAL").when(q, "LEXICA").when(F.col("quality").isNull(), "ORFE").otherwise("CAP").alias("class")).agg(F.count("*").alias("n"))


@query("vocabulary_sets", f"""WITH {TURNS}, {TOK}, a AS (SELECT DISTINCT token FROM tok), b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-zà-öø-ÿ]+')) AS token FROM benchmark)
SELECT (SELECT count(*) FROM (SELECT token FROM a UNION SELECT token FROM b)) AS either, (SELECT count(*) FROM (SELECT token FROM a INTERSECT SELECT token FROM b)) AS both_, (SELECT count(*) FROM (SELECT token FROM a EXCEPT SELECT token FROM b)) AS only_a""")  # fmt: skip
def vocabulary_sets(spark, d):
    a = corpora.tokens_of(corpora.conversation_lines(spark, d)).select("token").distinct()
    words = F.regexp_extract_all(F.lower("text"), F.lit(f"({corpora.WORD})"), F.lit(1))
    b = corpora.table(spark, d, "benchmark").select(F.explode(words).alias("token")).distinct()
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(a.union(b).distinct(), "either").join(F.broadcast(n(a.intersect(b), "both_"))).join(F.broadcast(n(a.subtract(b), "only_a")))




@query("anomaly_report", f"""WITH {RUNS}, z AS (SELECT *, coalesce((value - (SELECT avg(value) FROM s0)) / (SELECT stddev_pop(value) FROM s0) >= 2, false) AS gram, coalesce((err - (SELECT avg(err) FROM s0)) / (SELECT stddev_pop(err) FROM s0) >= 2, false) AS lex FROM sc)
SELECT {_CLASS} AS class, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM seg WHERE seg.user_id = z.user_id AND z.i BETWEEN first AND last)) AS inside FROM z GROUP BY 1""")  # fmt: skip
def anomaly_report(spark, d):
    from ..plans.report import anomaly_report as report

    e = series(spark, d).select("user_id", "ts", "event_id", "value", "err")
    parts = report(e, "user_id", ["ts", "event_id"], "value", "err", 20)
    inside = segments.covered(parts["scores"], user_runs(spark, d), "user_id").select("event_id", F.lit(1).alias("in_"))
    return parts["scores"].join(inside, "event_id", "left").groupBy("class").agg(F.count("*").alias("n"), F.count("in_").alias("inside"))


@query("corpus_roll_up", f"""WITH {EVENTS}, {TOK}, {BI} SELECT 'lines' AS "table", count(*) AS rows FROM lines UNION ALL SELECT 'tokens', count(*) FROM tok UNION ALL SELECT 'bigrams', count(*) FROM bi""")
def corpus_roll_up(spark, d):
    from ..plans.report import summary

    lines = corpora.event_lines(spark, d)
    return summary({"lines": lines, "tokens": corpora.tokens_of(lines), "bigrams": corpora.bigrams_of(lines)})
