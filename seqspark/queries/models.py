"""Counts, Markov tables, n-gram grammars and their statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import counts, ngram, resample, stats
from ..sources import corpora
from .registry import BI, CNT, EVENTS, MARG, ORDERS, STREAMS, TEXTS, TOK, TURNS, query

R = lambda c, d=6: F.round(c, d).alias(c)


def rounded(df, *columns, digits=6):
    return df.select(*(F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns))


@query("unigram_counts", f"WITH {TURNS}, {TOK} SELECT token, count(*) AS n FROM tok GROUP BY token")
def unigram_counts(spark, d):
    return counts.token_counts(corpora.conversation_lines(spark, d))


@query("bigram_counts", f"WITH {TEXTS}, {BI} SELECT a, b, count(*) AS n FROM bi GROUP BY a, b")
def bigram_counts(spark, d):
    return counts.bigram_counts(corpora.document_lines(spark, d))


@query("order_bigrams", f"WITH {ORDERS}, {BI} SELECT a, b, count(*) AS n FROM bi GROUP BY a, b")
def order_bigrams(spark, d):
    return counts.bigram_counts(corpora.order_lines(spark, d))


@query("trigram_counts", f"""WITH {TURNS}
SELECT tokens[i] AS a, tokens[i + 1] AS b, tokens[i + 2] AS c, count(*) AS n
FROM (SELECT tokens, unnest(range(1, len(tokens) - 1)) AS i FROM lines WHERE len(tokens) >= 3) GROUP BY 1, 2, 3""")  # fmt: skip
def trigram_counts(spark, d):
    m = ngram.model(corpora.conversation_lines(spark, d), 3)
    inner = m.where(~F.array_contains("ctx", ngram.BOS) & (F.col("sym") != ngram.EOS))
    return inner.select(F.col("ctx")[0].alias("a"), F.col("ctx")[1].alias("b"), F.col("sym").alias("c"), "n")


@query("end_counts", f"""WITH {EVENTS} SELECT token, CAST(sum(i) AS BIGINT) AS n_first, CAST(sum(f) AS BIGINT) AS n_last FROM (
SELECT tokens[1] AS token, 1 AS i, 0 AS f FROM lines UNION ALL SELECT tokens[len(tokens)], 0, 1 FROM lines) GROUP BY token""")  # fmt: skip
def end_counts(spark, d):
    return counts.end_counts(corpora.event_lines(spark, d))


@query("transition_probs", f"""WITH {EVENTS}, {BI}, {CNT}, {MARG}
SELECT a, b, n, round(n / n_a, 6) AS p_b_given_a, round(n / n_b, 6) AS p_a_given_b FROM m""")  # fmt: skip
def transition_probs(spark, d):
    return rounded(counts.transition_probs(corpora.event_lines(spark, d)), "p_b_given_a", "p_a_given_b")


_H = "SELECT {x} AS token, CAST(sum(n) AS BIGINT) AS total, count(*) AS partners, round(greatest(0.0, log2(sum(n)) - sum(n * log2(n)) / sum(n)), 6) AS entropy FROM cnt GROUP BY 1"


@query("succ_entropy", f"WITH {TURNS}, {BI}, {CNT} {_H.format(x='a')}")
def succ_entropy(spark, d):
    return rounded(counts.entropies(corpora.conversation_lines(spark, d)), "entropy")


@query("pred_entropy", f"WITH {TURNS}, {BI}, {CNT} {_H.format(x='b')}")
def pred_entropy(spark, d):
    return rounded(counts.entropies(corpora.conversation_lines(spark, d), "a", "b"), "entropy")


@query("markov_profile", f"""WITH {EVENTS}, {TOK}, {BI}, {CNT},
u AS (SELECT token, count(*) AS n, sum(count(*)) OVER () AS all_tokens FROM tok GROUP BY token),
s AS ({_H.format(x='a')}), p AS ({_H.format(x='b')}),
e AS (SELECT token, sum(i) AS f, sum(l) AS l FROM (SELECT tokens[1] AS token, 1 AS i, 0 AS l FROM lines UNION ALL SELECT tokens[len(tokens)], 0, 1 FROM lines) GROUP BY token)
SELECT u.token, n, round(n / all_tokens, 6) AS p, round(coalesce(f, 0) / (SELECT count(*) FROM lines), 6) AS p_first, round(coalesce(l, 0) / (SELECT count(*) FROM lines), 6) AS p_last,
coalesce(s.entropy, 0) AS h_succ, coalesce(s.partners, 0) AS n_succ, coalesce(p.entropy, 0) AS h_pred, coalesce(p.partners, 0) AS n_pred
FROM u LEFT JOIN e USING (token) LEFT JOIN s USING (token) LEFT JOIN p USING (token)""")  # fmt: skip
def markov_profile(spark, d):
    return rounded(counts.markov_profile(corpora.event_lines(spark, d)), "p", "p_first", "p_last", "h_succ", "h_pred")


@query("position_stats", f"""WITH {TURNS}, {TOK} SELECT token, count(*) AS n, round(avg(x), 6) AS mean_pos, round(stddev_pop(x), 6) AS sd_pos
FROM (SELECT token, CASE WHEN n > 1 THEN pos / (n - 1) ELSE 0.0 END AS x FROM tok) GROUP BY token""")  # fmt: skip
def position_stats(spark, d):
    return rounded(counts.position_stats(corpora.conversation_lines(spark, d)), "mean_pos", "sd_pos")


@query("doc_profile", f"""WITH {EVENTS}, {TOK}, c AS (SELECT token, doc, count(*) AS n FROM tok GROUP BY 1, 2)
SELECT token, doc, n, round(n / sum(n) OVER (PARTITION BY token), 8) AS share FROM c""")  # fmt: skip
def doc_profile(spark, d):
    return rounded(counts.doc_profile(corpora.event_lines(spark, d)), "share", digits=8)


@query("successor_lists", f"""WITH {EVENTS}, {BI}, {CNT} SELECT a, string_agg(b, ' ' ORDER BY n DESC, b) AS successors FROM cnt GROUP BY a""")
def successor_lists(spark, d):
    return counts.successors(corpora.event_lines(spark, d))


@query("document_frequency", f"WITH {TEXTS}, {TOK} SELECT token, count(DISTINCT doc) AS docs FROM tok GROUP BY token HAVING count(DISTINCT doc) >= 2")
def document_frequency(spark, d):
    return counts.document_frequency(corpora.document_lines(spark, d))


@query("vocabulary_split", f"""WITH {TEXTS}, {TOK}, c AS (SELECT token, count(*) AS n FROM tok GROUP BY token)
SELECT CASE WHEN n <= 1 THEN 'C_RARE' ELSE 'kept' END AS part, count(*) AS types, CAST(sum(n) AS BIGINT) AS tokens FROM c GROUP BY 1""")  # fmt: skip
def vocabulary_split(spark, d):
    return counts.vocabulary_split(corpora.document_lines(spark, d))


@query("corpus_summary", f"""WITH {TEXTS}, {TOK} SELECT (SELECT count(DISTINCT doc) FROM lines) AS docs, (SELECT count(*) FROM lines) AS lines, count(*) AS tokens,
count(DISTINCT token) AS types, round(count(*) / (SELECT count(*) FROM lines), 6) AS mean_length FROM tok""")  # fmt: skip
def corpus_summary(spark, d):
    return rounded(counts.corpus_summary(corpora.document_lines(spark, d)), "mean_length")


@query("topk_per_doc", f"""WITH {TURNS}, {TOK}, c AS (SELECT doc, token, count(*) AS n FROM tok GROUP BY 1, 2)
SELECT * FROM (SELECT doc, token, n, row_number() OVER (PARTITION BY doc ORDER BY n DESC, token) AS rank FROM c) WHERE rank <= 3""")  # fmt: skip
def topk_per_doc(spark, d):
    return counts.top_tokens(corpora.conversation_lines(spark, d), 3)


@query("dominant_tokens", f"""WITH {TURNS}, {TOK}, c AS (SELECT doc, token, count(*) * length(token) AS weight FROM tok GROUP BY 1, 2)
SELECT * FROM (SELECT doc, token, weight, row_number() OVER (PARTITION BY doc ORDER BY weight DESC, token) AS rank FROM c) WHERE rank <= 5""")  # fmt: skip
def dominant_tokens(spark, d):
    return counts.dominants(corpora.conversation_lines(spark, d))


@query("most_common", f"""WITH {TEXTS}, {TOK}, c AS (SELECT token, count(*) AS n FROM tok GROUP BY token)
SELECT token, n, round(100.0 * n / (SELECT sum(n) FROM c), 6) AS pct FROM c ORDER BY n DESC, token LIMIT 20""")  # fmt: skip
def most_common(spark, d):
    return rounded(counts.most_common(corpora.document_lines(spark, d), 20), "pct")


# n-gram grammar over user days: bigrams, k = 0.5
PAD = "pad AS (SELECT doc, line, list_concat(list_concat(['<BOS>'], tokens), ['<EOS>']) AS x FROM lines)"
POS = f"{PAD}, atp AS (SELECT doc, line, i - 2 AS pos, x[i - 1] AS ctx, x[i] AS sym FROM (SELECT *, unnest(range(2, len(x) + 1)) AS i FROM pad))"
MODEL = "mo AS (SELECT ctx, sym, count(*) AS n FROM atp GROUP BY 1, 2), tot AS (SELECT ctx, sum(n) AS total FROM mo GROUP BY ctx), v AS (SELECT count(DISTINCT token) AS v FROM tok)"
SMOOTH = """sm AS (SELECT ctx, sym, coalesce(n, 0) AS n, (coalesce(n, 0) + 0.5) / (total + 0.5 * (v + 1)) AS p
FROM (SELECT * FROM tot, v, (SELECT DISTINCT token AS sym FROM tok UNION ALL SELECT '<EOS>') t) x LEFT JOIN mo USING (ctx, sym))"""
BITS = """sp AS (SELECT atp.doc, atp.line, atp.pos, atp.ctx, atp.sym, (coalesce(n, 0) + 0.5) / (total + 0.5 * (v + 1)) AS p, total IS NOT NULL AS seen, coalesce(n, 0) = 0 AS zero
FROM v, atp LEFT JOIN tot USING (ctx) LEFT JOIN mo USING (ctx, sym))"""
_GRAMMAR = f"WITH {EVENTS}, {TOK}, {POS}, {MODEL}"


def _flat(df):
    return df.withColumn("ctx", F.array_join("ctx", " "))


@query("ngram_smoothed_probs", f"{_GRAMMAR}, {SMOOTH} SELECT ctx, sym, n, round(p, 8) AS p FROM sm")
def ngram_smoothed_probs(spark, d):
    return rounded(_flat(ngram.smoothed(corpora.event_lines(spark, d))), "p", digits=8)


@query("cond_entropy", f"{_GRAMMAR}, {SMOOTH} SELECT ctx, CAST(sum(n) AS BIGINT) AS total, round(-sum(CASE WHEN p > 1e-12 THEN p * log2(p) END), 6) AS h FROM sm GROUP BY ctx")
def cond_entropy(spark, d):
    return rounded(_flat(ngram.conditional_entropy(corpora.event_lines(spark, d))), "h")


@query("weighted_entropy", f"""{_GRAMMAR}, {SMOOTH}, c AS (SELECT ctx, sum(n) AS total, -sum(p * log2(p)) AS h FROM sm GROUP BY ctx)
SELECT round(sum(h * total) / sum(total), 6) AS h, count(*) AS contexts, CAST(sum(total) AS BIGINT) AS positions FROM c""")  # fmt: skip
def weighted_entropy(spark, d):
    return rounded(ngram.weighted_entropy(corpora.event_lines(spark, d)), "h")


@query("surprisal_positions", f"{_GRAMMAR}, {BITS} SELECT doc, CAST(line AS VARCHAR) AS line, pos, ctx, sym, round(p, 8) AS p, round(-log2(p), 6) AS bits, seen AS context_seen, zero AS zero_prob FROM sp")
def surprisal_positions(spark, d):
    out = _flat(ngram.surprisal(corpora.event_lines(spark, d)))
    return rounded(rounded(out.withColumn("line", F.col("line").cast("string")), "p", digits=8), "bits")


@query("surprisal_summary", f"""{_GRAMMAR}, {BITS} SELECT doc, count(*) AS positions, round(avg(-log2(p)), 6) AS mean_bits, round(max(-log2(p)), 6) AS max_bits,
round(pow(2, avg(-log2(p))), 6) AS perplexity, count(*) FILTER (zero) AS zero_prob, count(*) FILTER (NOT seen) AS unseen_contexts FROM sp GROUP BY doc""")  # fmt: skip
def surprisal_summary(spark, d):
    at = ngram.surprisal(corpora.event_lines(spark, d))
    return rounded(ngram.surprisal_summary(at, "doc"), "mean_bits", "max_bits", "perplexity")


@query("surprisal_ranking", f"""{_GRAMMAR}, {BITS} SELECT doc, round(avg(-log2(p)), 6) AS mean_bits FROM sp GROUP BY doc ORDER BY round(avg(-log2(p)), 6) DESC, doc LIMIT 20""")
def surprisal_ranking(spark, d):
    at = ngram.surprisal(corpora.event_lines(spark, d))
    return at.groupBy("doc").agg(F.round(F.avg("bits"), 6).alias("mean_bits")).orderBy(F.desc("mean_bits"), "doc").limit(20)


@query("rare_transitions", f"WITH {TURNS}, {TOK}, {POS}, {MODEL} SELECT ctx, sym, n FROM mo WHERE n <= 1 AND ctx <> '<BOS>'")
def rare_transitions(spark, d):
    return _flat(ngram.rare_transitions(corpora.conversation_lines(spark, d)))


@query("zero_prob_transitions", f"WITH {ORDERS}, {TOK}, {POS}, {MODEL}, {SMOOTH} SELECT ctx, sym FROM sm WHERE n = 0 AND sym <> '<EOS>'")
def zero_prob_transitions(spark, d):
    return _flat(ngram.zero_transitions(corpora.order_lines(spark, d)))


@query("held_out_surprisal", f"""WITH {EVENTS.replace("lines AS", "all_lines AS")}, lines AS (SELECT * FROM all_lines WHERE doc % 2 = 0), {TOK}, {PAD},
tr AS (SELECT x[i - 1] AS ctx, x[i] AS sym FROM (SELECT *, unnest(range(2, len(x) + 1)) AS i FROM pad)),
mo AS (SELECT ctx, sym, count(*) AS n FROM tr GROUP BY 1, 2), tot AS (SELECT ctx, sum(n) AS total FROM mo GROUP BY ctx), v AS (SELECT count(DISTINCT token) AS v FROM tok),
te AS (SELECT doc, list_concat(list_concat(['<BOS>'], tokens), ['<EOS>']) AS x FROM all_lines WHERE doc % 2 = 1),
atp AS (SELECT doc, x[i - 1] AS ctx, x[i] AS sym FROM (SELECT *, unnest(range(2, len(x) + 1)) AS i FROM te)),
sp AS (SELECT doc, CASE WHEN total IS NULL THEN 1 / (v + 1) ELSE (coalesce(n, 0) + 0.5) / (total + 0.5 * (v + 1)) END AS p, total IS NULL AS unseen, coalesce(n, 0) = 0 AS zero
FROM v, atp LEFT JOIN tot USING (ctx) LEFT JOIN mo USING (ctx, sym))
SELECT doc, count(*) AS positions, round(avg(-log2(p)), 6) AS mean_bits, count(*) FILTER (zero) AS zero_prob, count(*) FILTER (unseen) AS unseen_contexts FROM sp GROUP BY doc""")  # fmt: skip
def held_out_surprisal(spark, d):
    lines = corpora.event_lines(spark, d)
    at = ngram.surprisal(lines.where("doc % 2 = 1"), training=lines.where("doc % 2 = 0"))
    return rounded(ngram.surprisal_summary(at, "doc").select("doc", "positions", "mean_bits", "zero_prob", "unseen_contexts"), "mean_bits")


LOO_SQL = f"""WITH {STREAMS}, {TOK}, {BI},
u AS (SELECT token, count(*) AS n, count(DISTINCT doc) AS docs FROM tok GROUP BY token), ud AS (SELECT doc, token, count(*) AS own FROM tok GROUP BY 1, 2),
g AS (SELECT a, b, count(*) AS n FROM bi GROUP BY 1, 2), ga AS (SELECT a, sum(n) AS n FROM g GROUP BY a), gd AS (SELECT doc, a, b, count(*) AS own FROM bi GROUP BY 1, 2, 3),
gda AS (SELECT doc, a, sum(own) AS own FROM gd GROUP BY 1, 2),
f AS (SELECT doc, (SELECT sum(n) FROM u) - sum(own) AS n_fold, (SELECT count(*) FROM u) - count(*) FILTER (docs = 1) AS v_fold FROM ud JOIN u USING (token) GROUP BY doc),
c AS (SELECT (SELECT sum(n) FROM u) AS n_all, (SELECT count(*) FROM u) AS v_all),
x AS (SELECT gd.doc, gd.own AS t, -log2((g.n - gd.own + 0.01) / (ga.n - gda.own + 0.01 * v_fold)) AS loo, -log2((g.n + 0.01) / (ga.n + 0.01 * v_all)) AS ins, CASE WHEN g.n = gd.own THEN 1 ELSE 0 END AS oov
 FROM gd JOIN g USING (a, b) JOIN ga USING (a) JOIN gda USING (doc, a) JOIN f USING (doc), c
 UNION ALL SELECT l.doc, 1, -log2((u.n - ud.own + 0.01) / (n_fold + 0.01 * v_fold)), -log2((u.n + 0.01) / (n_all + 0.01 * v_all)), 0
 FROM lines l JOIN u ON u.token = l.tokens[1] JOIN ud ON ud.doc = l.doc AND ud.token = l.tokens[1] JOIN f ON f.doc = l.doc, c)
SELECT doc, CAST(sum(t) AS BIGINT) AS n_tokens, round(sum(t * loo) / sum(t), 6) AS loo_bits, round(sum(t * ins) / sum(t), 6) AS in_sample_bits, CAST(sum(t * oov) AS BIGINT) AS n_oov,
round(sum(t * loo) / sum(t) - sum(t * ins) / sum(t), 6) AS delta_bits, round(sum(t * oov) / sum(t), 6) AS frac_oov FROM x GROUP BY doc"""  # fmt: skip


@query("loo_surprisal", LOO_SQL)
def loo_surprisal(spark, d):
    return rounded(ngram.leave_one_doc_out(corpora.user_pieces(spark, d), pieces=True), "loo_bits", "in_sample_bits", "delta_bits", "frac_oov")


_FISHER = """list_sum([exp(lgamma(n_a + 1) - lgamma(k + 1) - lgamma(n_a - k + 1) + lgamma(total - n_a + 1) - lgamma(n_b - k + 1) - lgamma(total - n_a - n_b + k + 1)
 - lgamma(total + 1) + lgamma(n_b + 1) + lgamma(total - n_b + 1)) FOR k IN range(CAST(greatest(n, n_a + n_b - total) AS BIGINT), CAST(least(n_a, n_b) AS BIGINT) + 1)])"""
_SIG = f"""sig AS (SELECT a, b, n, n / n_a AS p_b_given_a, n_b / total AS p_b, (n / n_a) / (n_b / total) AS lift,
CASE WHEN (n_a - n) * (n_b - n) > 0 THEN n * (total - n_a - n_b + n) / ((n_a - n) * (n_b - n)) END AS odds_ratio, least(1.0, {_FISHER}) AS p_value FROM m WHERE n >= 3)"""


@query("fisher_significance", f"""WITH {EVENTS}, {BI}, {CNT}, {MARG}, {_SIG}
SELECT a, b, n, round(p_b_given_a, 6) AS p_b_given_a, round(p_b, 6) AS p_b, round(lift, 6) AS lift, round(odds_ratio, 6) AS odds_ratio, round(p_value, 6) AS p_value FROM sig""")  # fmt: skip
def fisher_significance(spark, d):
    return rounded(stats.significance(corpora.event_lines(spark, d)), "p_b_given_a", "p_b", "lift", "odds_ratio", "p_value")


@query("bh_qvalues", f"""WITH {TURNS}, {BI}, {CNT}, {MARG}, {_SIG},
r AS (SELECT a, b, n, round(p_value, 9) AS p_value FROM sig), k AS (SELECT *, row_number() OVER (ORDER BY p_value, a, b) AS rk, count(*) OVER () AS cm FROM r),
q AS (SELECT a, b, n, p_value, least(1.0, min(p_value * cm / rk) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) AS q FROM k)
SELECT a, b, n, round(p_value, 6) AS p_value, round(q, 6) AS q_value, q < 0.05 AS significant FROM q""")  # fmt: skip
def bh_qvalues(spark, d):
    p = stats.significance(corpora.conversation_lines(spark, d)).select("a", "b", "n", F.round("p_value", 9).alias("p_value"))
    q = stats.benjamini_hochberg(p, order=["a", "b"])
    return rounded(q.withColumn("significant", F.col("q_value") < 0.05), "p_value", "q_value")


def _ppmi(own, other):
    return f"""WITH {TURNS}, {BI}, {CNT}, {MARG}, mg AS (SELECT DISTINCT {other[-1]}, {other} AS c FROM m), z AS (SELECT sum(pow(c, 0.75)) AS z FROM mg)
SELECT a, b, round(greatest(0.0, log2((n / total) / ((({own}) / total) * (pow({other}, 0.75) / z)))), 6) AS ppmi FROM m, z"""


@query("ppmi_succ", _ppmi("n_a", "n_b"))
def ppmi_succ(spark, d):
    return rounded(stats.ppmi(corpora.conversation_lines(spark, d)), "ppmi")


@query("ppmi_pred", _ppmi("n_b", "n_a"))
def ppmi_pred(spark, d):
    return rounded(stats.ppmi(corpora.conversation_lines(spark, d), "pred"), "ppmi")


@query("h_global", f"""WITH {EVENTS}, {BI}, {CNT}, {MARG}
SELECT round(-sum(n / total * log2(n / n_a)), 6) AS h, CAST(sum(n) AS BIGINT) AS bigrams FROM m""")  # fmt: skip
def h_global(spark, d):
    return rounded(stats.h_global(corpora.bigrams_of(corpora.event_lines(spark, d))), "h")


def _cut(x: str) -> str:
    """The lower 64 bits of a product or sum of 128."""
    return f"CAST(({x}) & {(1 << 64) - 1}::UHUGEINT AS UBIGINT)"


# Number p * n + i of a splitmix64 generator seeded with s (its constants are fixed values)
_NUMBERS = f"""z0 AS (SELECT p, doc, line, token, {_cut(f"s::UHUGEINT + {0x9E3779B97F4A7C15}::UHUGEINT * (p * n + i + 1)::UHUGEINT")} AS z FROM places, range(0, 1000) AS r(p)),
z1 AS (SELECT p, doc, line, token, {_cut(f"xor(z, z >> 30)::UHUGEINT * {0xBF58476D1CE4E5B9}::UHUGEINT")} AS z FROM z0),
z2 AS (SELECT p, doc, line, token, {_cut(f"xor(z, z >> 27)::UHUGEINT * {0x94D049BB133111EB}::UHUGEINT")} AS z FROM z1)"""


@query("null_model_entropy", f"""WITH {EVENTS}, {BI}, {CNT}, {MARG}, obs AS (SELECT -sum(n / total * log2(n / n_a)) AS h_obs FROM m),
places AS (SELECT doc, line, s, n, unnest(range(0, n)) AS i, unnest(tokens) AS token FROM (SELECT *, CAST('0x' || left(md5(concat_ws('|', '42', doc, line)), 16) AS UBIGINT) AS s, len(tokens) AS n FROM lines WHERE len(tokens) >= 2)), {_NUMBERS},
tk AS (SELECT p AS perm, doc, line, token, xor(z, z >> 31) AS h FROM z2),
sh AS (SELECT perm, token AS a, lead(token) OVER (PARTITION BY perm, doc, line ORDER BY h) AS b FROM tk),
c AS (SELECT perm, a, b, count(*) AS n FROM sh WHERE b IS NOT NULL GROUP BY 1, 2, 3),
cm AS (SELECT perm, n, sum(n) OVER (PARTITION BY perm, a) AS n_a, sum(n) OVER (PARTITION BY perm) AS total FROM c),
nl AS (SELECT perm, -sum(n / total * log2(n / n_a)) AS h FROM cm GROUP BY perm)
SELECT round(max(h_obs), 6) AS h_obs, round(avg(h), 6) AS null_mean, round(stddev_samp(h), 6) AS null_sd, round(quantile_cont(h, 0.025), 6) AS null_low, round(quantile_cont(h, 0.975), 6) AS null_high,
round((count(*) FILTER (h <= h_obs) + 1) / (count(*) + 1), 6) AS p_value, round((max(h_obs) - avg(h)) / stddev_samp(h), 4) AS z, round(1 - max(h_obs) / avg(h), 6) AS relative_reduction FROM nl, obs""")  # fmt: skip
def null_model_entropy(spark, d):
    out = resample.null_model(corpora.event_lines(spark, d), 1000)
    return rounded(rounded(out, "h_obs", "null_mean", "null_sd", "null_low", "null_high", "p_value", "relative_reduction"), "z", digits=4)


_IC = """f AS (SELECT doc, token, count(*) AS f FROM tok GROUP BY 1, 2), s AS (SELECT doc, sum(f) AS n, count(*) AS types, sum(f * (f - 1)) AS s, arg_max(token, (f, token)) AS top_token, max(f) AS top FROM f GROUP BY doc)
SELECT doc, CAST(n AS BIGINT) AS n, types, round(CASE WHEN n >= 10 THEN s / (n * (n - 1)) END, 8) AS ic, round(CASE WHEN n >= 10 THEN s / (n * (n - 1)) END * types, 6) AS ic_norm, round(1 / types, 8) AS ic_uniform, top_token, round(100.0 * top / n, 6) AS top_pct FROM s"""


@query("ic_stream", f"WITH {TEXTS}, {TOK}, {_IC}")
def ic_stream(spark, d):
    out = stats.index_of_coincidence(corpora.tokens_of(corpora.document_lines(spark, d)), "doc")
    return rounded(rounded(out, "ic", "ic_uniform", digits=8), "ic_norm", "top_pct")


@query("ic_shuffled_control", f"""WITH {STREAMS}, {TOK}, f AS (SELECT doc, token, count(*) AS f FROM tok GROUP BY 1, 2)
SELECT doc, round(CASE WHEN sum(f) >= 10 THEN sum(f * (f - 1)) / (sum(f) * (sum(f) - 1)) END, 8) AS mean_ic, 0.0::DOUBLE AS sd_ic FROM f GROUP BY doc""")  # fmt: skip
def ic_shuffled_control(spark, d):
    return rounded(rounded(resample.shuffled_coincidence(corpora.user_streams(spark, d), 10), "mean_ic", digits=8), "sd_ic")


_KAS = """g AS (SELECT doc, line, i, tokens[i] || ' ' || tokens[i + 1] || ' ' || tokens[i + 2] AS gram FROM (SELECT *, unnest(range(1, len(tokens) - 1)) AS i FROM lines WHERE len(tokens) >= 3)),
dd AS (SELECT doc, line, gram, i - lag(i) OVER (PARTITION BY doc, line, gram ORDER BY i) AS d FROM g), k AS (SELECT * FROM dd WHERE d > 1)"""


@query("kasiski", f"WITH {STREAMS}, {_KAS} SELECT doc, count(*) AS repeats, list_reduce(list(DISTINCT d), lambda x, y: gcd(x, y)) AS gcd FROM k GROUP BY doc")
def kasiski(spark, d):
    return stats.common_divisor(stats.repeated_gram_distances(corpora.user_streams(spark, d)), "doc")


@query("factor_hist", f"WITH {STREAMS}, {_KAS} SELECT f AS factor, count(*) AS n FROM k, range(2, 11) AS r(f) WHERE d % f = 0 GROUP BY f")
def factor_hist(spark, d):
    return stats.factor_histogram(stats.repeated_gram_distances(corpora.user_streams(spark, d)))


RUNS = """t AS (SELECT doc, line, [CASE WHEN x = 'view' THEN 0 ELSE 1 END FOR x IN tokens] AS t FROM lines WHERE len(tokens) >= 20),
r AS (SELECT doc, line, len(t) AS n, len(t) - list_sum(t) AS n0, list_sum(t) AS n1, 1 + len([i FOR i IN range(1, len(t)) IF t[i] <> t[i + 1]]) AS runs FROM t),
w AS (SELECT *, 2.0 * n0 * n1 / n + 1 AS mu, 2.0 * n0 * n1 * (2.0 * n0 * n1 - n) / (CAST(n AS DOUBLE) * n * (n - 1)) AS va FROM r),
rz AS (SELECT *, CASE WHEN n0 > 0 AND n1 > 0 AND va > 0 THEN (runs - mu) / sqrt(va) END AS z FROM w)"""


@query("runs_test", f"""WITH {STREAMS}, {RUNS} SELECT doc, line, n, CAST(n0 AS BIGINT) AS n0, CAST(n1 AS BIGINT) AS n1, runs, round(z, 6) AS z,
CASE WHEN z IS NULL THEN 'untestable' WHEN z < -3 THEN 'clustered' WHEN z > 3 THEN 'alternating' ELSE 'random' END AS label FROM rz""")  # fmt: skip
def runs_test(spark, d):
    return rounded(stats.stream_runs_test(corpora.user_pieces(spark, d), "view"), "z")


@query("text_metrics", """WITH k AS (SELECT conv_id * 1000 + turn AS doc_id, regexp_replace(text, '\\s+', '', 'g') AS t FROM conversations),
g AS (SELECT doc_id, n, substr(t, i, n) AS g FROM (SELECT doc_id, t, n, unnest(range(1, length(t) - n + 2)) AS i FROM k, (VALUES (1), (2), (3), (5)) v(n))),
a AS (SELECT doc_id, n, count(DISTINCT g) AS d, count(*) AS w FROM g GROUP BY 1, 2),
c AS (SELECT doc_id, g, count(*) AS f FROM g WHERE n = 1 GROUP BY 1, 2), h AS (SELECT doc_id, log2(sum(f)) - sum(f * log2(f)) / sum(f) AS m8 FROM c GROUP BY 1)
SELECT doc_id, coalesce(round(max(CASE WHEN n = 1 THEN 1 / d END), 6), 0) AS m1, coalesce(round(max(CASE WHEN n = 2 THEN 1 / d END), 6), 0) AS m2, coalesce(round(max(CASE WHEN n = 3 THEN 1 / d END), 6), 0) AS m3,
coalesce(round(max(CASE WHEN n = 5 THEN 1 - d / w END), 6), 0) AS m5, coalesce(round(any_value(m8), 6), 0) AS m8 FROM k LEFT JOIN a USING (doc_id) LEFT JOIN h USING (doc_id) GROUP BY doc_id""")  # fmt: skip
def text_metrics(spark, d):
    turns = corpora.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return rounded(stats.text_metrics(turns, "doc_id", F.col("text")), "m1", "m2", "m3", "m5", "m8")


@query("zlib_ratio")
def zlib_ratio(spark, d):
    return stats.compression_ratio(corpora.table(spark, d, "documents"), "doc_id", "text")


@query("score_percentile", """SELECT round(quantile_cont(value, 0.025), 6) AS p2_5, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.6), 6) AS p60,
round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.975), 6) AS p97_5 FROM events""")  # fmt: skip
def score_percentile(spark, d):
    shares = {"p2_5": 0.025, "p50": 0.5, "p60": 0.6, "p95": 0.95, "p97_5": 0.975}
    return rounded(stats.percentiles(corpora.table(spark, d, "events"), "value", shares), *shares)


@query("metric_correlation", """WITH c AS (SELECT round(corr(l_quantity, l_extendedprice), 6) AS r1, round(corr(l_discount, l_extendedprice), 6) AS r2, round(corr(l_discount, l_quantity), 6) AS r3 FROM lineitem)
SELECT 'l_extendedprice' AS x, 'l_quantity' AS y, r1 AS r FROM c UNION ALL SELECT 'l_discount', 'l_quantity', r3 FROM c UNION ALL SELECT 'l_discount', 'l_extendedprice', r2 FROM c""")  # fmt: skip
def metric_correlation(spark, d):
    return rounded(stats.correlations(corpora.table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), "r")
