"""Further joins, summaries and chart tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.lineage import new_folder
from ..operators import cluster, crypto, hypotheses, ngram, signature, stats, views
from ..sources import corpora, files
from .lines import RUNS, placed, user_runs
from .models import LOO_SQL, rounded
from .registry import EVENTS, STREAMS, TEXTS, TOK, TURNS, query


@query("dimension_lookup", """SELECT coalesce(n_name, '') AS n_name, count(*) AS n FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) n ON c_nationkey = n_nationkey GROUP BY 1""")
def dimension_lookup(spark, d):
    n = corpora.table(spark, d, "nation").where("n_nationkey < 20").withColumnRenamed("n_nationkey", "c_nationkey")
    return views.with_dimension(corpora.table(spark, d, "customer"), n, "c_nationkey", "n_name").groupBy("n_name").agg(F.count("*").alias("n"))


@query("corpus_selection", "SELECT source, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents WHERE source IN ('src0', 'src1') GROUP BY source UNION ALL SELECT 'TOTS', count(*), CAST(sum(length(text)) AS BIGINT) FROM documents")
def corpus_selection(spark, d):
    docs = corpora.table(spark, d, "documents").select("source", "text")
    one = lambda df: df.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))
    return one(docs.where(F.col("source").isin("src0", "src1"))).unionByName(one(docs.withColumn("source", F.lit("TOTS"))))


_LAST = "SELECT l_orderkey AS k, l_linenumber AS v, arg_max({x}, o) AS {x} FROM b GROUP BY 1, 2"


@query("channels_joined", f"""WITH b AS (SELECT *, l_extendedprice * 1000 + l_discount * 10 + l_tax + l_quantity AS o FROM lineitem), x AS ({_LAST.format(x='l_quantity')}), y AS ({_LAST.format(x='l_tax')}), z AS ({_LAST.format(x='l_discount')})
SELECT k, v, l_quantity, l_tax, l_discount FROM x LEFT JOIN y USING (k, v) LEFT JOIN z USING (k, v)""")  # fmt: skip
def channels_joined(spark, d):
    b = corpora.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("v"), (F.col("l_extendedprice") * 1000 + F.col("l_discount") * 10 + F.col("l_tax") + F.col("l_quantity")).alias("o"), "l_quantity", "l_tax", "l_discount")
    part = lambda c: b.select("k", "v", "o", c)
    return views.channels_joined(part("l_quantity"), [part("l_tax"), part("l_discount")], ["k", "v"], "o").drop("o")


@query("pattern_doc_counts", f"""WITH {EVENTS}, g AS (SELECT doc, array_to_string(tokens[i:i + k - 1], ' ') AS pattern FROM (SELECT *, unnest(range(1, len(tokens) - k + 2)) AS i FROM lines, (VALUES (2), (3)) v(k) WHERE len(tokens) >= k)),
s AS (SELECT pattern FROM g GROUP BY 1 HAVING count(DISTINCT doc) >= 2), l AS (SELECT doc, count(*) AS doc_lines FROM lines GROUP BY doc)
SELECT doc, pattern, count(*) AS n, doc_lines FROM g SEMI JOIN s USING (pattern) JOIN l USING (doc) GROUP BY doc, pattern, doc_lines""")  # fmt: skip
def pattern_doc_counts(spark, d):
    return views.pattern_doc_counts(corpora.event_lines(spark, d))


@query("line_ranges", f"WITH {TEXTS} SELECT doc, min(line) AS first_line, max(line) AS last_line, count(*) AS n_lines FROM lines GROUP BY doc")
def line_ranges(spark, d):
    return views.line_ranges(corpora.document_lines(spark, d))


@query("line_increment", f"WITH {TEXTS} SELECT doc, round((max(line) - min(line)) / nullif(count(*) - 1, 0), 6) AS increment FROM lines GROUP BY doc")
def line_increment(spark, d):
    return rounded(views.mean_increment(corpora.document_lines(spark, d)), "increment")


@query("first_places", f"WITH {TURNS}, {TOK} SELECT doc, line, token, count(*) AS n, array_to_string(list_sort(list(pos))[1:5], ',') AS places FROM tok GROUP BY 1, 2, 3")
def first_places(spark, d):
    return views.first_places(corpora.conversation_lines(spark, d))


@query("largest_deviation", """SELECT round(greatest(max(l_quantity) - avg(l_quantity), avg(l_quantity) - min(l_quantity)) / stddev_pop(l_quantity), 6) AS quantity,
round(greatest(max(l_extendedprice) - avg(l_extendedprice), avg(l_extendedprice) - min(l_extendedprice)) / stddev_pop(l_extendedprice), 6) AS price FROM lineitem""")  # fmt: skip
def largest_deviation(spark, d):
    columns = {"quantity": F.col("l_quantity"), "price": F.col("l_extendedprice")}
    return rounded(views.largest_deviation(corpora.table(spark, d, "lineitem"), columns), *columns)


@query("series_with_bands", f"WITH {RUNS} SELECT event_id, i, round(score, 6) AS score, first, last FROM sc LEFT JOIN seg ON seg.user_id = sc.user_id AND sc.i BETWEEN first AND last")
def series_with_bands(spark, d):
    return rounded(views.series_with_bands(placed(spark, d), user_runs(spark, d), "user_id").select("event_id", "i", "score", "first", "last"), "score")


@query("coincidence_verdict", f"""WITH {STREAMS}, {TOK}, f AS (SELECT doc, token, count(*) AS f FROM tok GROUP BY 1, 2), s AS (SELECT doc, sum(f * (f - 1)) / (sum(f) * (sum(f) - 1)) AS ic, sum(f) AS n FROM f GROUP BY doc),
w AS (SELECT sum(f * (f - 1)) / (sum(f) * (sum(f) - 1)) AS ic FROM (SELECT token, sum(f) AS f FROM f GROUP BY token)), r AS (SELECT doc, CASE WHEN n >= 10 THEN s.ic END / w.ic AS ratio FROM s, w)
SELECT CASE WHEN ratio IS NULL THEN 'NO_AVALUABLE' WHEN ratio < 0.85 THEN 'MES_PLA' WHEN ratio > 1.15 THEN 'MES_CONCENTRAT' ELSE 'COMPATIBLE' END AS verdict, count(*) AS docs FROM r GROUP BY 1""")  # fmt: skip
def coincidence_verdict(spark, d):
    t = corpora.tokens_of(corpora.user_pieces(spark, d))
    whole = stats.index_of_coincidence(t).select(F.col("ic").alias("whole"))
    ratio = F.try_divide("ic", "whole")
    return stats.index_of_coincidence(t, "doc").join(F.broadcast(whole)).groupBy(crypto.verdict_by_ratio(ratio).alias("verdict")).agg(F.count("*").alias("docs"))


@query("discordant_pairs", """WITH lines AS (SELECT o_custkey AS doc, list(o_orderstatus ORDER BY o_orderdate, o_orderkey) AS tokens FROM orders GROUP BY 1), w AS (SELECT doc, i, tokens[i:i + 7] AS w FROM (SELECT *, unnest(range(1, len(tokens) - 6)) AS i FROM lines WHERE len(tokens) >= 8)),
k AS (SELECT doc, i, w, (SELECT x FROM unnest(w) AS u(x) GROUP BY x HAVING count(*) = 7) AS ruler FROM w),
o AS (SELECT doc, i - 1 + p AS position, w[p + 1] AS symbol, ruler, i FROM (SELECT *, unnest(range(0, 8)) AS p FROM k WHERE ruler IS NOT NULL) WHERE w[p + 1] <> ruler),
u AS (SELECT doc, position, arg_min(symbol, i) AS symbol, arg_min(ruler, i) AS ruler FROM o GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY position) AS r FROM u)
SELECT ruler, symbol, count(*) AS n FROM r WHERE r <= 3 GROUP BY 1, 2""")  # fmt: skip
def discordant_pairs(spark, d):
    c = F.col
    lines = corpora.ordered_lines(corpora.table(spark, d, "orders"), c("o_custkey"), c("o_custkey"), c("o_orderstatus"), c("o_orderdate"), c("o_orderkey"))
    return views.discordant_pairs(hypotheses.local_discordance(lines))


@query("language_scores", """WITH t AS (SELECT conv_id, turn, lower(text) AS t FROM conversations), g AS (SELECT conv_id, turn, t, [substr(t, i, 2) FOR i IN range(1, length(t))] AS b, [substr(t, i, 3) FOR i IN range(1, length(t) - 1)] AS c FROM (SELECT conv_id, turn, replace(t, '?', '') AS t FROM t))
SELECT conv_id, turn, round(CASE WHEN length(t) < 3 THEN 0.0 ELSE (len([x FOR x IN b IF x IN ('de', 'la', 'en', 'er')]) + 3 * len([x FOR x IN c IF x IN ('que', 'con', 'the')])) / ((length(t) - 1) + 3 * (length(t) - 2)) END, 6) AS score FROM g""")  # fmt: skip
def language_scores(spark, d):
    t = corpora.table(spark, d, "conversations")
    text = F.lower("text")
    return t.select("conv_id", "turn", F.round(hypotheses.language_score(text, ["de", "la", "en", "er"], ["que", "con", "the"]), 6).alias("score"))


_LOO = LOO_SQL[: LOO_SQL.rindex("SELECT doc, CAST(sum(t)")]


@query("loo_overall", f"""{_LOO}, p AS (SELECT doc, sum(t) AS n, sum(t * loo) / sum(t) AS loo, sum(t * ins) / sum(t) AS ins FROM x GROUP BY doc)
SELECT round(sum(ins * n) / sum(n), 6) AS in_sample, round(avg(loo), 6) AS mean_loo, round(stddev_samp(loo), 6) AS sd_loo, count(*) AS docs FROM p""")  # fmt: skip
def loo_overall(spark, d):
    loo = ngram.leave_one_doc_out(corpora.user_pieces(spark, d), pieces=True)
    return rounded(
        loo.agg((F.sum(F.col("in_sample_bits") * F.col("n_tokens")) / F.sum("n_tokens")).alias("in_sample"), F.avg("loo_bits").alias("mean_loo"), F.stddev_samp("loo_bits").alias("sd_loo"), F.count("*").alias("docs")),
        "in_sample", "mean_loo", "sd_loo",
    )


@query("cluster_profile", """WITH m AS (SELECT label, i, avg(abs(x)) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY 1, 2),
s AS (SELECT label, i, x / sum(x) OVER (PARTITION BY label) AS share FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY share DESC, i) AS rank FROM s)
SELECT label, rank, 'd' || i AS class, round(share, 6) AS share FROM r WHERE rank <= 3""")  # fmt: skip
def cluster_profile(spark, d):
    e = corpora.table(spark, d, "embeddings").select("label", F.transform("embedding", lambda x: F.abs(x)).alias("vector"))
    return rounded(signature.cluster_profile(e, "label", [f"d{i}" for i in range(64)]), "share")


@query("centroid_distance_euclidean", """WITH ctr AS (SELECT label, list(x ORDER BY i) AS p FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY label)
SELECT vec_id, label, round(list_distance(embedding::DOUBLE[], p), 6) AS distance FROM embeddings JOIN ctr USING (label)""")  # fmt: skip
def centroid_distance_euclidean(spark, d):
    out = signature.centre_distance(corpora.table(spark, d, "embeddings"), "label", "embedding", "euclidean")
    return rounded(out.select("vec_id", "label", "distance"), "distance")


@query("chosen_k")
def chosen_k(spark, d):
    v = cluster.reduced(cluster.vectors(corpora.table(spark, d, "embeddings"), "vec_id", "embedding"), 5)
    k, out = cluster.choose_k(v, range(2, 6), starts=1)
    return out.groupBy("label").agg(F.count("*").alias("n")).withColumn("k", F.lit(k))


@query("category_key", "SELECT translate(role, 'áéíóú', 'aeiou') AS role, count(*) AS n FROM conversations WHERE role IN ('user', 'assistant') GROUP BY 1")
def category_key(spark, d):
    c = corpora.table(spark, d, "conversations").where(F.col("role").isin("user", "assistant"))
    return c.groupBy(scalars.accents_stripped(F.col("role")).alias("role")).agg(F.count("*").alias("n"))


# Files
@query("report_rows", "SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row, o_orderkey, o_orderstatus FROM orders")
def report_rows(spark, d):
    """Orders written as an ordered report, read back in splits of bytes with their places."""
    folder = new_folder(spark, "report")
    o = corpora.table(spark, d, "orders")
    files.write_report(o, folder, "%d %s", "o_orderkey", "o_orderstatus", order=["o_orderdate", "o_orderkey"])
    part = F.split("value", " ")
    return files.text_corpus(spark, folder).select("row", part[0].cast("long").alias("o_orderkey"), part[1].alias("o_orderstatus"))


@query("csv_rows", "SELECT l_orderkey, l_linenumber, round(l_extendedprice, 4) AS l_extendedprice, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag END AS flag, l_quantity > 25 AS many FROM lineitem WHERE l_linenumber > 1")
def csv_rows(spark, d):
    """Items written as a table of text, with blanks, words for booleans and end marks (rows without a line number), and read back."""
    folder = new_folder(spark, "csv")
    i = corpora.table(spark, d, "lineitem")
    blank = lambda c, gone: F.when(~gone, F.col(c)).alias(c)
    rows = i.select("l_orderkey", blank("l_linenumber", F.col("l_linenumber") == 1), F.col("l_extendedprice").cast("double").alias("l_extendedprice"), blank("l_returnflag", F.col("l_returnflag") == "R"), (F.col("l_quantity") > 25).alias("many"))
    files.write_csv(rows.withColumnRenamed("l_returnflag", "flag"), folder)
    return files.read_csv(spark, folder, "l_orderkey long, l_linenumber int, l_extendedprice double, flag string, many boolean", required=["l_linenumber"])
