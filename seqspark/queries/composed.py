"""Operators put together: ordered reports, dashboards, positional joins, stability of classes, hypotheses over all lines."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.lineage import cut
from ..operators import cluster, counts, crypto, hypotheses, morse, ngram, occurrences, ordinals, parse, patterns, segments, signature, stability, stats, views
from ..sources import corpora
from .lines import _COS, _EDGE, _PAT, SIGN, _patterns, classes_of, notation, signatures
from .models import _SIG, rounded
from .registry import BI, CNT, EVENTS, MARG, STREAMS, TOK, TURNS, query

# Line items with vertical blocks, for example g(n2l-3v)(4)
BLOCKS = "note AS (SELECT l_orderkey AS doc, l_suppkey * 1000 + l_linenumber AS line, 'g(' || lower(l_returnflag) || l_linenumber || 'l-' || (l_linenumber % 3 + 1) || 'v)(' || CAST(l_tax * 100 AS INTEGER) || ')' || CAST(l_quantity AS INTEGER) AS text FROM lineitem)"
_ROWS = """t AS (SELECT doc, line, regexp_extract_all(text, '\\(\\d+\\)|\\([^()]+-\\d+v\\)|\\d|[lpgavxr]') AS ps FROM note),
e AS (SELECT doc, line, flatten([CASE WHEN p LIKE '(%v)' THEN flatten([flatten([CASE WHEN regexp_matches(x, '\\d') THEN ['l' FOR j IN range(0, CAST(x AS INTEGER))] ELSE [x] END FOR x IN regexp_extract_all(regexp_extract(p, '^\\((.*)-\\d+v\\)$', 1), '\\d|[lpgavxr]')]) FOR k IN range(0, CAST(regexp_extract(p, '-(\\d+)v\\)$', 1) AS INTEGER))])
 WHEN regexp_matches(p, '\\d') THEN ['l' FOR i IN range(0, CAST(regexp_extract(p, '\\d+') AS INTEGER))] ELSE [p] END FOR p IN ps]) AS tokens FROM t)"""


def block_text(items, *more):
    n = F.col("l_linenumber")
    text = F.concat(F.lit("g("), F.lower("l_returnflag"), n, F.lit("l-"), n % 3 + 1, F.lit("v)("), F.round(F.col("l_tax") * 100).cast("int"), F.lit(")"), F.col("l_quantity").cast("int"))
    return items.select(F.col("l_orderkey").alias("doc"), (F.col("l_suppkey") * 1000 + n).alias("line"), *more, text.alias("text"))


def block_notation(spark, d):
    return block_text(corpora.table(spark, d, "lineitem"))


@query("expand_rows_blocks", f"WITH {BLOCKS}, {_ROWS} SELECT array_to_string(tokens, '') AS tokens, count(*) AS n FROM e GROUP BY 1")
def expand_rows_blocks(spark, d):
    return block_notation(spark, d).select(F.array_join(parse.expand_row(F.col("text")), "").alias("tokens")).groupBy("tokens").agg(F.count("*").alias("n"))


# B4 > E11 > E10 > D19: rows of at least five symbols, the first three odd places of each, runs of rows that have some
_ODD = f"""{BLOCKS}, {_ROWS}, w AS (SELECT doc, line, i, tokens[i:i + 7] AS w FROM (SELECT *, unnest(range(1, len(tokens) - 6)) AS i FROM e WHERE len(tokens) >= 8)),
k AS (SELECT *, CASE WHEN w[1] = w[2] OR w[1] = w[3] THEN w[1] ELSE w[2] END AS ruler FROM w),
o AS (SELECT doc, line, i - 1 + p AS position, w[p + 1] AS symbol, ruler, i FROM (SELECT *, unnest(range(0, 8)) AS p FROM k WHERE len([x FOR x IN w IF x = ruler]) = 7) WHERE w[p + 1] <> ruler),
u AS (SELECT doc, line, position, arg_min(symbol, i) AS symbol, arg_min(ruler, i) AS ruler FROM o GROUP BY 1, 2, 3)"""


def odd_places(spark, d):
    """Of rows with the same doc and line that which stands first in its file counts, as in the SQL read in order."""
    place = [("file_", F.col("_metadata.file_path")), ("at_", F.col("_metadata.row_index"))]
    i = corpora.table(spark, d, "lineitem").select("*", *(c.alias(n) for n, c in place))
    lines = block_text(i, "file_", "at_").select("doc", "line", "file_", "at_", parse.expand_row(F.col("text")).alias("tokens"))
    return hypotheses.local_discordance(lines.where(F.size("tokens") >= 5), ties=["file_", "at_"])


@query("discordant_rows", f"WITH {_ODD}, r AS (SELECT *, row_number() OVER (PARTITION BY doc, line ORDER BY position) AS r FROM u) SELECT ruler, symbol, count(*) AS n FROM r WHERE r <= 3 GROUP BY 1, 2")
def discordant_rows(spark, d):
    return views.discordant_pairs(odd_places(spark, d))


@query("discordant_row_runs", f"""WITH {_ODD}, n AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY line) AS i, line FROM e), a AS (SELECT DISTINCT n.doc, n.i FROM u JOIN n ON n.doc = u.doc AND n.line = u.line),
s AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc ORDER BY i) > 2 THEN 1 ELSE 0 END AS new FROM a), g AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY i) AS g FROM s)
SELECT doc, min(i) AS first, max(i) AS last, count(*) AS length FROM g GROUP BY doc, g HAVING count(*) >= 3""")  # fmt: skip
def discordant_row_runs(spark, d):
    lines = block_notation(spark, d).select("doc", "line", parse.expand_row(F.col("text")).alias("tokens"))
    # a doc's rows are dealt once: numbered, and odd if one of the same line is
    marked = hypotheses.discordant_lines(lines).select(
        "doc", F.row_number().over(Window.partitionBy("doc").orderBy("line")).alias("i"), F.max("odd").over(Window.partitionBy("doc", "line")).alias("odd")
    )
    return segments.gap_islands(marked.where("odd").select("doc", "i"), ["doc"], "i")


@query("morse_pairs")
def morse_pairs(spark, d):
    """21 symbol pairs in both polarities with their shuffled control."""
    t = corpora.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text")
    return hypotheses.morse_scores(t, "k", "text", "lgapvxr", ["DE", "LA", "EN", "ER", "ES", "EL"], ["QUE", "CON", "EST", "ENT"])


# Common Spanish bigrams and trigrams (fixed values)
BIGRAMS = "DE LA EL EN UN SE NO RE ER AR CO ES IO OS AN AS CI ON TE DO ME NT ST AL TA OR TI RA RO TO LE DA CA RI NA LO IS ND NC TR ED EM".split()
TRIGRAMS = "QUE ENT CIO NTE DEL LOS EST CON ADO ION ARA RES STA ERE PRE COM UNA PER ANT CIA STR TER PAR LAS TRA ESP ERA LLA NDO".split()


@query("morse_corpus")
def morse_corpus(spark, d):
    """21 symbol pairs in both polarities over all documents as one text, with 15 shuffled controls."""
    return morse.corpus_test(corpora.table(spark, d, "documents"), ["doc_id"], "text", "lgapvxr", BIGRAMS, TRIGRAMS)


# Patterns
@query("doc_patterns")
def doc_patterns(spark, d):
    return patterns.doc_patterns(corpora.order_lines(spark, d))


_REDUCED = f"{_PAT}, {_EDGE}, re AS (SELECT parent, child FROM ed WHERE NOT EXISTS (SELECT 1 FROM ed x JOIN ed y ON x.child = y.parent WHERE x.parent = ed.parent AND y.child = ed.child))"


@query("pattern_layers", f"WITH RECURSIVE {EVENTS}, {_REDUCED}, walk AS (SELECT pattern AS node, 0 AS depth FROM pat UNION ALL SELECT child, depth + 1 FROM walk JOIN re ON parent = node) SELECT node, max(depth) AS depth FROM walk GROUP BY node")
def pattern_layers(spark, d):
    p = _patterns(spark, d)
    return patterns.depths(patterns.reduced(patterns.containment(p)), p, layers=2)  # lengths 2 to 4


@query("long_pattern_docs", f"""WITH {TURNS}, {TOK}, g AS (SELECT doc, array_to_string(tokens[i:i + 1], ' ') AS pattern FROM (SELECT *, unnest(range(1, len(tokens))) AS i FROM lines WHERE len(tokens) >= 2)),
s AS (SELECT pattern FROM g GROUP BY 1 HAVING count(DISTINCT doc) >= 2), l AS (SELECT doc, count(*) AS doc_lines FROM lines GROUP BY doc),
dm AS (SELECT doc, list(token) AS ds FROM (SELECT doc, token, row_number() OVER (PARTITION BY doc ORDER BY count(*) * length(token) DESC, token) AS r FROM tok GROUP BY doc, token) WHERE r <= 5 GROUP BY doc)
SELECT g.doc, g.pattern, count(*) AS n, doc_lines, list_contains(ds, string_split(g.pattern, ' ')[1]) OR list_contains(ds, string_split(g.pattern, ' ')[2]) AS dominant FROM g SEMI JOIN s USING (pattern) JOIN l ON l.doc = g.doc LEFT JOIN dm ON dm.doc = g.doc GROUP BY g.doc, g.pattern, doc_lines, ds""")  # fmt: skip
def long_pattern_docs(spark, d):
    lines = corpora.conversation_lines(spark, d)
    leading = counts.dominants(lines).groupBy("doc").agg(F.collect_list("token").alias("ds"))  # five a doc
    found = views.pattern_doc_counts(lines, 2, 2).join(leading, "doc", "left")
    return found.select("doc", "pattern", "n", "doc_lines", F.arrays_overlap("ds", F.split("pattern", " ")).alias("dominant"))


_SENTENCES = "(SELECT DISTINCT regexp_extract_all(lower(s), '[a-zà-öø-ÿ]+') AS p FROM (SELECT unnest(regexp_split_to_array(text, '[.\\n]')) AS s FROM benchmark))"
_MARKED = "array_to_string([chr(30) || x || chr(31) FOR x IN {}], '')"


@query("sentence_counts", f"""WITH l AS (SELECT doc_id AS doc, {_MARKED.format("regexp_extract_all(lower(s), '[a-zà-öø-ÿ]+')")} AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents)),
p AS (SELECT array_to_string(p, ' ') AS pattern, len(p) AS length, {_MARKED.format("p")} AS m FROM {_SENTENCES} WHERE len(p) >= 2)
SELECT doc, pattern, CAST(length AS BIGINT) AS length, CAST(sum((length(t) - length(replace(t, m, ''))) // length(m)) AS BIGINT) AS n FROM l JOIN p ON contains(t, m) GROUP BY doc, pattern, length""")  # fmt: skip
def sentence_counts(spark, d):
    """Sentences of the benchmark, of two words or more, in all lines of documents."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(f"({corpora.WORD})"), F.lit(1))
    lines = corpora.table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.explode(F.split("text", "\n")).alias("s")).select("doc", words(F.col("s")).alias("tokens"))
    sentences = corpora.table(spark, d, "benchmark").select(F.explode(F.split("text", "[.\n]")).alias("s")).select(words(F.col("s")).alias("pattern")).where(F.size("pattern") >= 2)
    found = occurrences.pattern_counts(lines, sentences)
    return found.select("doc", "pattern", F.size(F.split("pattern", " ")).cast("long").alias("length"), "n")


@query("cover_pattern_counts")
def cover_pattern_counts(spark, d):
    """Patterns of any length that the covers of two conversations hold, in all turns of all conversations."""
    lines = corpora.conversation_lines(spark, d)
    return occurrences.pattern_counts(lines, occurrences.shared_patterns_of_docs(lines))


PARTS = ["the", "er", "ti", "th.", "on", "sch"]


@query("pattern_line_counts", "SELECT conv_id, " + ", ".join(f"CAST(sum((length(t) - length(replace(t, '{p}', ''))) / {len(p)}) AS BIGINT) AS n{i}" for i, p in enumerate(PARTS)) + " FROM (SELECT conv_id, regexp_replace(lower(text), '\\s+', '', 'g') AS t FROM conversations) GROUP BY conv_id")
def pattern_line_counts(spark, d):
    t = corpora.table(spark, d, "conversations").select("conv_id", F.regexp_replace(F.lower("text"), r"\s+", "").alias("t"))
    return t.groupBy("conv_id").agg(*(F.sum(scalars.overlap_free_count(F.col("t"), F.lit(p))).alias(f"n{i}") for i, p in enumerate(PARTS)))


@query("palindromic_docs", """WITH l AS (SELECT l_orderkey, o_custkey AS doc, string_agg(l_returnflag, '' ORDER BY l_linenumber, l_partkey, l_suppkey) AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT doc, count(*) AS lines, round(count(*) FILTER (t = reverse(t)) / count(*), 6) AS m6 FROM l GROUP BY doc""")  # fmt: skip
def palindromic_docs(spark, d):
    c = F.col
    items = corpora.table(spark, d, "lineitem").join(corpora.table(spark, d, "orders"), c("l_orderkey") == c("o_orderkey"))
    lines = corpora.ordered_lines(items, c("o_custkey"), c("l_orderkey"), c("l_returnflag"), c("l_linenumber"), c("l_partkey"), c("l_suppkey"))
    return rounded(stats.palindromic_share(lines.withColumn("t", F.array_join("tokens", "")), "doc", "t"), "m6")


# Orders, vocabularies, positions
@query("significance_ranked", f"""WITH {TURNS}, {BI}, {CNT}, {MARG}, {_SIG}, s AS (SELECT a, b, n, round(lift, 6) AS lift, round(p_value, 9) AS p_value, round(p_value, 9) < 0.01 AS significant FROM sig)
SELECT row_number() OVER (ORDER BY significant DESC, lift DESC, p_value, a, b) AS rank, a, b, n, lift, significant FROM s QUALIFY rank <= 50""")  # fmt: skip
def significance_ranked(spark, d):
    """The 50 first bigrams: significant ones, then by falling lift and rising p."""
    s = stats.significance(corpora.conversation_lines(spark, d)).select("a", "b", "n", F.round("lift", 6).alias("lift"), F.round("p_value", 9).alias("p_value"))
    order = [F.desc("significant"), F.desc("lift"), "p_value", "a", "b"]
    top = s.withColumn("significant", F.col("p_value") < 0.01).orderBy(*order).limit(50)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", "a", "b", "n", "lift", "significant")


@query("lift_ranked", f"""WITH {TURNS}, {BI}, {CNT}, {MARG}, s AS (SELECT a, b, n, round((n / n_a) / (n_b / total), 6) AS lift FROM m WHERE n >= 3)
SELECT row_number() OVER (ORDER BY n >= 5 DESC, lift DESC, n DESC, a, b) AS rank, a, b, n, lift FROM s QUALIFY rank <= 50""")  # fmt: skip
def lift_ranked(spark, d):
    m = counts.with_margins(counts.bigram_counts(corpora.conversation_lines(spark, d))).where("n >= 3")
    s = m.select("a", "b", "n", F.round((F.col("n") / F.col("n_a")) / (F.col("n_b") / F.col("total")), 6).alias("lift"))
    order = [F.desc(F.col("n") >= 5), F.desc("lift"), F.desc("n"), "a", "b"]
    return s.orderBy(*order).limit(50).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


@query("dashboard_tokens", f"""WITH {TURNS}, {TOK}, c AS (SELECT doc, token, count(*) AS n FROM tok GROUP BY 1, 2), dm AS (SELECT doc, token FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n * length(token) DESC, token) AS r FROM c) WHERE r <= 5),
o AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n DESC, token) AS r FROM c ANTI JOIN dm USING (doc, token))
SELECT doc, token, n, false AS dominant FROM o WHERE r <= 10 UNION ALL SELECT doc, token, n, true FROM c SEMI JOIN dm USING (doc, token)""")  # fmt: skip
def dashboard_tokens(spark, d):
    lines = corpora.conversation_lines(spark, d)
    per = corpora.tokens_of(lines).groupBy("doc", "token").agg(F.count("*").alias("n"))
    leading = counts.dominants(lines).select("doc", "token")
    others = per.join(leading, ["doc", "token"], "left_anti").withColumn("r", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("n"), "token")))
    return others.where("r <= 10").select("doc", "token", "n", F.lit(False).alias("dominant")).unionByName(per.join(leading, ["doc", "token"], "left_semi").withColumn("dominant", F.lit(True)))


@query("symbol_vocabulary", "SELECT source AS doc, string_agg(c, '' ORDER BY c) AS symbols, count(*) AS n FROM (SELECT DISTINCT source, unnest(string_split(regexp_replace(lower(text), '[^a-z]', '', 'g'), '')) AS c FROM documents) WHERE c <> '' GROUP BY source")
def symbol_vocabulary(spark, d):
    docs = corpora.table(spark, d, "documents")
    once = docs.select("source", F.explode(F.array_distinct(F.split(F.regexp_replace(F.lower("text"), "[^a-z]", ""), ""))).alias("c")).where("c <> ''").distinct()
    return once.groupBy(F.col("source").alias("doc")).agg(F.array_join(F.array_sort(F.collect_list("c")), "").alias("symbols"), F.count("*").alias("n"))


@query("stream_ordinals", "SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS ordinal FROM conversations")
def stream_ordinals(spark, d):
    return ordinals.stream_ordinals(corpora.table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn")


_DAYS = f"{EVENTS}, seqs AS (SELECT doc, list(tokens[1] ORDER BY line) || ['<EOS>'] AS items FROM lines GROUP BY doc), pl AS (SELECT doc, line, row_number() OVER (PARTITION BY doc ORDER BY line) - 1 AS ordinal FROM lines)"


@query("sequence_zip", f"WITH {_DAYS}, it AS (SELECT doc, unnest(range(0, len(items))) AS ordinal, unnest(items) AS item FROM seqs) SELECT it.doc, it.ordinal, item, CAST(line AS VARCHAR) AS line FROM it LEFT JOIN pl USING (doc, ordinal)")
def sequence_zip(spark, d):
    lines = corpora.event_lines(spark, d)
    items = lines.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("line", F.element_at("tokens", 1).alias("t")))).alias("x"))
    sequences = items.select("doc", F.concat(F.transform("x", lambda x: x["t"]), F.array(F.lit(ngram.EOS))).alias("items"))
    return ordinals.zipped(sequences, "items", lines).withColumn("line", F.col("line").cast("string"))


_CATEGORY = "CASE WHEN e >= 3 THEN 'CRITICA' WHEN e = 2 THEN 'ALTA' WHEN e = 1 THEN 'MODERADA' ELSE 'NORMAL' END"


@query("anomalous_line_tokens", f"""WITH {EVENTS}, f AS (SELECT user_id AS doc, CAST(ts AS DATE) AS line, {_CATEGORY} AS category FROM (SELECT user_id, ts, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS e FROM events))
SELECT doc, CAST(line AS VARCHAR) AS line, category, array_to_string(coalesce(t.tokens, []), ' ') AS tokens FROM (SELECT DISTINCT * FROM f WHERE category IN ('CRITICA', 'ALTA')) LEFT JOIN (SELECT * FROM lines WHERE len(tokens) > 3) t USING (doc, line)""")  # fmt: skip
def anomalous_line_tokens(spark, d):
    from ..operators.anomaly import category

    e = corpora.table(spark, d, "events").groupBy(F.col("user_id").alias("doc"), F.col("ts").cast("date").alias("line")).agg(F.count_if(F.col("event_type") == "error").alias("e"))
    marked = e.select("doc", "line", category(F.col("e")).alias("category")).where(F.col("category").isin("CRITICA", "ALTA"))
    lines = corpora.event_lines(spark, d).where(F.size("tokens") > 3)
    return marked.join(lines, ["doc", "line"], "left").select("doc", F.col("line").cast("string").alias("line"), "category", F.array_join(F.coalesce("tokens", F.array()), " ").alias("tokens"))


@query("dashed_rows", "SELECT CAST(regexp_extract(v, '^(\\d+)', 1) AS INTEGER) AS line, regexp_extract(v, '^\\d+[\\s\\-]\\s*(.*)$', 1) AS raw, stem FROM (SELECT p_brand || '-' || p_size AS stem, arg_max(p_partkey || CASE WHEN p_size % 2 = 0 THEN '- ' ELSE ' ' END || p_name, p_partkey) AS v FROM part GROUP BY 1)")
def dashed_rows(spark, d):
    """The second row form; of files with the same stem the last one counts."""
    p = corpora.table(spark, d, "part")
    v = F.concat("p_partkey", F.when(F.col("p_size") % 2 == 0, "- ").otherwise(" "), "p_name")
    last = corpora.last_of_key(p.select(F.concat_ws("-", "p_brand", "p_size").alias("stem"), v.alias("v"), "p_partkey"), ["stem"], "p_partkey")
    return parse.numbered_or_dashed_rows(last, "v").select("line", "raw", "stem")


@query("class_label_order", "WITH l AS (SELECT DISTINCT CASE WHEN p_size % 7 = 0 THEN 'C_RARE' ELSE 'C' || p_size END AS label FROM part) SELECT label, row_number() OVER (ORDER BY label = 'C_RARE', TRY_CAST(label[2:] AS INTEGER)) AS rank FROM l")
def class_label_order(spark, d):
    label = F.when(F.col("p_size") % 7 == 0, "C_RARE").otherwise(F.concat(F.lit("C"), "p_size"))
    labels = corpora.table(spark, d, "part").select(label.alias("label")).distinct()  # as many as sizes
    return labels.withColumn("rank", F.row_number().over(Window.orderBy(*scalars.label_order(F.col("label")))))


@query("accentless_words", f"WITH {TURNS}, {TOK} SELECT translate(token, 'áéíóúàèìòù', 'aeiouaeiou') AS word, count(*) AS n, count(DISTINCT token) AS forms FROM tok WHERE regexp_matches(token, '[áéíóúàèìòù]') GROUP BY 1")
def accentless_words(spark, d):
    t = corpora.tokens_of(corpora.conversation_lines(spark, d)).where(F.col("token").rlike("[áéíóúàèìòù]"))
    return t.groupBy(scalars.accents_stripped(F.col("token")).alias("word")).agg(F.count("*").alias("n"), F.count_distinct("token").alias("forms"))


@query("indicator_verdict", f"""WITH {STREAMS}, {TOK}, f AS (SELECT doc, token, count(*) AS f FROM tok GROUP BY 1, 2), s AS (SELECT doc, sum(f) AS n, sum(f * (f - 1)) / (sum(f) * (sum(f) - 1)) AS ic, count(*) AS types, max(f) AS top FROM f GROUP BY doc)
SELECT doc, array_to_string(list_filter([CASE WHEN ic * types > 1.15 THEN 'IC_ALT' END, CASE WHEN ic * types < 0.85 THEN 'IC_BAIX' END, CASE WHEN top / n > 0.4 THEN 'DOMINANT' END, CASE WHEN n < 10 THEN 'CURT' END], lambda x: x IS NOT NULL), ',') AS indicators FROM s WHERE n > 1""")  # fmt: skip
def indicator_verdict(spark, d):
    f = corpora.tokens_of(corpora.user_pieces(spark, d)).groupBy("doc", "token").agg(F.count("*").alias("f"))
    s = f.groupBy("doc").agg(F.sum("f").alias("n"), F.sum(F.col("f") * (F.col("f") - 1)).alias("s"), F.count("*").alias("types"), F.max("f").alias("top")).where("n > 1")
    norm = F.col("s") / (F.col("n") * (F.col("n") - 1)) * F.col("types")
    tests = {"IC_ALT": norm > 1.15, "IC_BAIX": norm < 0.85, "DOMINANT": F.col("top") / F.col("n") > 0.4, "CURT": F.col("n") < 10}
    return s.select("doc", crypto.indicators(tests).alias("indicators"))


@query("transition_marks", f"WITH {EVENTS}, {BI}, c AS (SELECT a, b, count(*) AS n FROM bi GROUP BY 1, 2) SELECT a, b, round(n / sum(n) OVER (PARTITION BY a), 6) AS p, n / sum(n) OVER (PARTITION BY a) >= 0.05 AS marked FROM c")
def transition_marks(spark, d):
    p = counts.transition_probs(corpora.event_lines(spark, d))
    return p.select("a", "b", F.round("p_b_given_a", 6).alias("p"), (F.col("p_b_given_a") >= 0.05).alias("marked"))


# Clusters
@query("cluster_summary", f"""WITH {EVENTS}, {TOK}, {SIGN}, l AS (SELECT doc, n, unknown, CASE WHEN v[1] >= v[2] AND v[1] >= v[3] THEN 'C0' WHEN v[2] >= v[3] THEN 'C1' ELSE 'C2' END AS label FROM sg), h AS (SELECT label, doc, count(*) AS k FROM l GROUP BY 1, 2)
SELECT label, count(*) AS lines, round(avg(n), 6) AS mean_length, max(n) AS max_length, round(sum(unknown) / sum(n), 6) AS unknown_share, (SELECT count(*) FROM h WHERE h.label = l.label) AS docs, (SELECT max(k) FROM h WHERE h.label = l.label) AS most_in_a_doc FROM l GROUP BY label""")  # fmt: skip
def cluster_summary(spark, d):
    v = F.col("vector")
    label = F.when((v[0] >= v[1]) & (v[0] >= v[2]), "C0").when(v[1] >= v[2], "C1").otherwise("C2")
    return rounded(signature.cluster_summary(signatures(spark, d).withColumn("label", label), "label"), "mean_length", "unknown_share")


@query("pca_loadings")
def pca_loadings(spark, d):
    v = cluster.vectors(corpora.table(spark, d, "embeddings"), "vec_id", "embedding")
    return cluster.loadings(v, 2, [f"d{i}" for i in range(64)])


def notation_lines(spark, d):
    return notation(spark, d).select("doc", "line", parse.tokenize_flat(F.col("text")).alias("tokens"))


@query("notation_classes")
def notation_classes(spark, d):
    """Classes of instruction tokens, k from 2 to 18 by silhouette."""
    return stability.original_classes(notation_lines(spark, d), range(2, 19))


@query("class_stability")
def class_stability(spark, d):
    """200 replicates of the lines: agreement of their classes with those of all lines."""
    lines = notation_lines(spark, d)
    return stability.stability(stability.agreement(lines, stability.original_classes(lines, range(2, 19)), 200))


@query("vocabulary_stability")
def vocabulary_stability(spark, d):
    """200 replicates of all conversation turns: agreement of their words' classes with those of all turns."""
    lines = corpora.conversation_lines(spark, d)
    return stability.stability(stability.agreement(lines, cut(stability.original_classes(lines, range(2, 19))), 200))


@query("token_scatter")
def token_scatter(spark, d):
    """Words of conversations on their first two components, with their classes and the classes' centres."""
    scores = stability.replicate_scores(corpora.conversation_lines(spark, d), 1, -1)
    points = scores.join(stability.classes_of(scores, range(2, 19)), "token").select("token", "label", array_to_vector("y").alias("y"))
    return cluster.scatter(points, "token", "y", "label")


# Eight flags of a user's days; the grammars are those of the users with even ids
def _bits(steps: str, of: str) -> str:
    """Bits of transitions (ctx, sym) in table `steps` of symbols in table `of`, by a model of even docs."""
    return f"""{steps}c AS (SELECT ctx, sym, count(*) AS n FROM {steps} WHERE doc % 2 = 0 GROUP BY 1, 2), {steps}t AS (SELECT ctx, sum(n) AS total FROM {steps}c GROUP BY ctx), {steps}v AS (SELECT count(DISTINCT sym) + 1 AS t FROM {of} WHERE doc % 2 = 0),
{steps}b AS (SELECT s.*, -log2(CASE WHEN total IS NULL THEN 1 / t ELSE (coalesce(n, 0) + 0.5) / (total + 0.5 * t) END) AS bits, n IS NULL AS zero FROM {steps} s LEFT JOIN {steps}c USING (ctx, sym) LEFT JOIN {steps}t USING (ctx), {steps}v)"""


_EIGHT = f"""{EVENTS}, {TOK}, {BI}, {SIGN}, ctr AS (SELECT doc, [avg(v[1]), avg(v[2]), avg(v[3])] AS p FROM sg GROUP BY doc),
di AS (SELECT doc, line, round({_COS}, 9) AS distance FROM sg JOIN ctr USING (doc)), zi AS (SELECT doc, line, coalesce((distance - avg(distance) OVER w) / nullif(stddev_pop(distance) OVER w, 0), 0) AS z_intra FROM di WINDOW w AS (PARTITION BY doc)),
ju AS (SELECT doc, line, round({_COS}, 9) AS jump FROM (SELECT *, lag(v) OVER (PARTITION BY doc ORDER BY line) AS p FROM sg)),
ty AS (SELECT doc, line, CASE WHEN list_max(v) = 0 THEN 'VOID' WHEN v[1] >= v[2] AND v[1] >= v[3] THEN 'C0' WHEN v[2] >= v[3] THEN 'C1' ELSE 'C2' END AS sym FROM sg),
ma AS (SELECT doc, line, coalesce(lag(sym) OVER (PARTITION BY doc ORDER BY line), '<BOS>') AS ctx, sym FROM ty UNION ALL SELECT doc, NULL, arg_max(sym, line), '<EOS>' FROM ty GROUP BY doc), {_bits("ma", "ty")},
cs AS (SELECT doc, line, pos, coalesce(class, 'C_RARE') AS sym FROM tok LEFT JOIN cls USING (token)),
mi AS (SELECT doc, line, coalesce(lag(sym) OVER (PARTITION BY doc, line ORDER BY pos), '<BOS>') AS ctx, sym FROM cs UNION ALL SELECT doc, line, arg_max(sym, pos), '<EOS>' FROM cs GROUP BY doc, line), {_bits("mi", "cs")},
mg AS (SELECT doc, line, avg(bits) AS micro_mean, max(bits) AS micro_max, bool_or(zero) AS micro_zero FROM mib GROUP BY 1, 2),
cnt AS (SELECT a, b, count(*) AS n FROM bi GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS n_a, sum(n) OVER (PARTITION BY b) AS n_b, sum(n) OVER () AS total FROM cnt), si AS (SELECT a, b, (n / n_a) / (n_b / total) > 1 AS significant FROM m WHERE n >= 3),
iv AS (SELECT doc, line, count(*) FILTER (NOT significant) / nullif(count(significant), 0) AS frac FROM bi LEFT JOIN si USING (a, b) GROUP BY 1, 2),
al AS (SELECT zi.*, jump, mab.bits AS macro_bits, mab.zero AS macro_zero, micro_mean, micro_max, micro_zero, frac FROM zi JOIN ju USING (doc, line) LEFT JOIN mab USING (doc, line) LEFT JOIN mg USING (doc, line) LEFT JOIN iv USING (doc, line)),
st AS (SELECT avg(jump) AS m1, stddev_pop(jump) AS s1, avg(macro_bits) AS m2, stddev_pop(macro_bits) AS s2, avg(micro_mean) AS m3, stddev_pop(micro_mean) AS s3, avg(micro_max) AS m4, stddev_pop(micro_max) AS s4, avg(frac) AS m5, stddev_pop(frac) AS s5 FROM al),
fl AS (SELECT doc, line, round(z_intra, 9) >= 2 AS flag_intra, coalesce(round((jump - m1) / s1, 9) >= 2, false) AS flag_jump, coalesce(round((macro_bits - m2) / s2, 9) >= 2, false) AS flag_macro_bits, coalesce(macro_zero, false) AS flag_macro_zero,
coalesce(round((micro_mean - m3) / s3, 9) >= 2, false) AS flag_micro_mean, coalesce(round((micro_max - m4) / s4, 9) >= 2, false) AS flag_micro_max, coalesce(micro_zero, false) AS flag_micro_zero, coalesce(round((frac - m5) / s5, 9) >= 2, false) AS flag_invalid FROM al, st),
nf AS (SELECT *, flag_intra::INT + flag_jump::INT + flag_macro_bits::INT + flag_macro_zero::INT + flag_micro_mean::INT + flag_micro_max::INT + flag_micro_zero::INT + flag_invalid::INT AS n_flags FROM fl)"""


@query("eight_flags", f"""WITH {_EIGHT} SELECT doc, CAST(line AS VARCHAR) AS line, {', '.join(f'flag_{f}' for f in ('intra', 'jump', 'macro_bits', 'macro_zero', 'micro_mean', 'micro_max', 'micro_zero', 'invalid'))}, n_flags,
CASE WHEN n_flags >= 3 THEN 'CRITICA' WHEN n_flags = 2 THEN 'ALTA' WHEN n_flags = 1 THEN 'MODERADA' ELSE 'NORMAL' END AS category, (flag_macro_bits OR flag_macro_zero) AND (flag_micro_mean OR flag_micro_max OR flag_micro_zero) AS "cross" FROM nf""")  # fmt: skip
def eight_flags(spark, d):
    from ..plans.report import line_flags, line_signals

    lines = corpora.event_lines(spark, d)
    margins = counts.with_margins(counts.bigram_counts(lines)).where("n >= 3")
    tested = margins.select("a", "b", ((F.col("n") / F.col("n_a")) / (F.col("n_b") / F.col("total")) > 1).alias("significant"))
    signals = line_signals(lines, classes_of(spark), ["C0", "C1", "C2"], tested, lines.where("doc % 2 = 0"))
    return line_flags(signals).withColumn("line", F.col("line").cast("string"))


_PHASES = {
    "corpus": "SELECT count(DISTINCT doc) AS docs, count(*) AS lines FROM lines",
    "tokens": "SELECT count(*) AS tokens, count(DISTINCT token) AS types FROM tok",
    "transitions": "SELECT count(*) AS bigrams, count(*) FILTER (n >= 3) AS tested, count(*) FILTER (n >= 3 AND (n / n_a) / (n_b / total) > 1) AS attracted FROM m",
    "grammar": "SELECT count(DISTINCT a) AS contexts, round(-sum(n / total * log2(n / n_a)), 6) AS entropy FROM m",
    "jumps": f"SELECT count(d) AS n, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS spread FROM (SELECT {_COS} AS d FROM (SELECT *, lag(v) OVER (PARTITION BY doc ORDER BY line) AS p FROM sg))",
    "flags": "SELECT count(*) FILTER (n_flags >= 3) AS critical, count(*) FILTER (n_flags = 2) AS high, count(*) FILTER (n_flags = 1) AS moderate FROM nf",
}
_FIGURES = {k: [c.split()[0].rstrip(",") for c in v.split(" FROM ")[0].split(" AS ")[1:]] for k, v in _PHASES.items()}


def _phase(k: str) -> str:
    names = ", ".join(f"('{f}', {f}::DOUBLE)" for f in _FIGURES[k])
    return f"SELECT '{k}' AS phase, figure, value FROM ({_PHASES[k]}) x, LATERAL (VALUES {names}) f(figure, value)"


@query("phase_roll_up", f"WITH {_EIGHT} " + " UNION ALL ".join(map(_phase, _PHASES)) + " UNION ALL SELECT 'references', NULL, NULL")
def phase_roll_up(spark, d):
    """Figures of every phase over events; the phase of references has no source there."""
    from ..plans.report import roll_up

    lines = corpora.event_lines(spark, d)
    m = counts.with_margins(counts.bigram_counts(lines))
    c, n = F.col, F.count_if
    h = -F.sum(c("n") / c("total") * F.log2(c("n") / c("n_a")))
    return roll_up({
        "corpus": (lines, {"docs": F.count_distinct("doc"), "lines": F.count("*")}),
        "tokens": (corpora.tokens_of(lines), {"tokens": F.count("*"), "types": F.count_distinct("token")}),
        "transitions": (m, {"bigrams": F.count("*"), "tested": n(c("n") >= 3), "attracted": n((c("n") >= 3) & ((c("n") / c("n_a")) / (c("n_b") / c("total")) > 1))}),
        "grammar": (m, {"contexts": F.count_distinct("a"), "entropy": F.round(h, 6)}),
        "jumps": (signature.jumps(signatures(spark, d)), {"n": F.count("jump"), "mean": F.round(F.avg("jump"), 6), "spread": F.round(F.stddev_pop("jump"), 6)}),
        "flags": (eight_flags(spark, d), {"critical": n(c("category") == "CRITICA"), "high": n(c("category") == "ALTA"), "moderate": n(c("category") == "MODERADA")}),
        "references": (None, {}),
    })
