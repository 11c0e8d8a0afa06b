"""Queries on lexical features, term tables and overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from prosemill.functions import text as T
from prosemill.operators import lexical as L
from prosemill.operators import rhythm, segment
from prosemill.plans.base import SENTENCES_CTE, TOKENS_CTE, WORDS_CTE, Registry, lit, sql_count, sql_sentences, sql_tokens, table
from prosemill.plans.feature_queries import LEX, MATTR
from prosemill.plans.text_queries import STOP

R = Registry()
_stop = ", ".join(map(lit, STOP))


def docs_of(spark, d):
    return table(spark, d, "documents")


def terms_of(spark, d):
    """The 50 most frequent words, pairs and triples of the documents, stop words removed, by a rule that SQL repeats."""
    return L.frequent_terms(docs_of(spark, d), STOP)


GRAMS = f"""{TOKENS_CTE}, n0 AS (SELECT doc_id, len(a) AS n FROM (SELECT doc_id, {sql_tokens('text')} AS a FROM documents)),
 cont AS (SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM t WHERE token NOT IN ({_stop})),
 cg AS (SELECT doc_id, p, token AS g1, token || ' ' || lead(token) OVER v AS g2, token || ' ' || lead(token) OVER v || ' ' || lead(token, 2) OVER v AS g3 FROM cont WINDOW v AS (PARTITION BY doc_id ORDER BY p)),
 terms AS (SELECT * FROM (SELECT g1 AS term, 1 AS n FROM cg GROUP BY g1 ORDER BY count(*) DESC, g1 LIMIT 50) UNION ALL SELECT * FROM (SELECT g2, 2 FROM cg WHERE g2 IS NOT NULL GROUP BY g2 ORDER BY count(*) DESC, g2 LIMIT 50) UNION ALL SELECT * FROM (SELECT g3, 3 FROM cg WHERE g3 IS NOT NULL GROUP BY g3 ORDER BY count(*) DESC, g3 LIMIT 50))"""


def _dens(n: int, name: str) -> str:
    src = "(SELECT doc_id, token AS g FROM t)" if n == 1 else f"(SELECT doc_id, g{n} AS g FROM cg)"
    return f"{name} AS (SELECT n0.doc_id, 1000.0::DOUBLE * coalesce(h, 0) / greatest(n0.n, 1) AS {name} FROM n0 LEFT JOIN (SELECT doc_id, count(*) AS h FROM {src} JOIN terms ON term = g AND terms.n = {n} GROUP BY doc_id) USING (doc_id))"


DENS = ", ".join(_dens(n, x) for n, x in ((1, "slopword_density"), (2, "slopbigram_density"), (3, "sloptrigram_density")))


def _sql_out(name: str, digits: int = 9) -> str:
    return f"SELECT doc_id, round({name}, {digits}) AS {name} FROM {name}"


def _rounded(df, *cols, digits=9):
    return df.select("doc_id", *[F.round(c, digits).alias(c) for c in cols])


@R.add("l1_term_density", f"WITH {GRAMS}, {DENS} {_sql_out('slopword_density')}")
def _(spark, d):
    return _rounded(L.density(docs_of(spark, d), terms_of(spark, d), 1, STOP, "slopword_density"), "slopword_density")


@R.add("l2_phrase_density", f"WITH {GRAMS}, {DENS} SELECT doc_id, round(slopbigram_density, 9) AS slopbigram_density, round(sloptrigram_density, 9) AS sloptrigram_density FROM slopbigram_density JOIN sloptrigram_density USING (doc_id)")
def _(spark, d):
    two = L.term_densities(docs_of(spark, d), terms_of(spark, d), STOP)
    return _rounded(two, "slopbigram_density", "sloptrigram_density")


NOTX = f"not_x_but_y_rate AS (SELECT doc_id, 1000.0::DOUBLE * {sql_count('text', T.NOT_X_BUT_Y)} / greatest(len({sql_tokens('text')}), 1) AS not_x_but_y_rate FROM documents)"


@R.add("l3_pattern_rate", f"WITH {NOTX} {_sql_out('not_x_but_y_rate')}")
def _(spark, d):
    return _rounded(L.pattern_rate(docs_of(spark, d), T.NOT_X_BUT_Y, "not_x_but_y_rate"), "not_x_but_y_rate")


DIST = """ag AS (SELECT doc_id, token || ' ' || lead(token) OVER v AS g2, token || ' ' || lead(token) OVER v || ' ' || lead(token, 2) OVER v AS g3 FROM t WINDOW v AS (PARTITION BY doc_id ORDER BY pos)),
 dist AS (SELECT documents.doc_id, CASE WHEN count(g2) > 0 THEN count(DISTINCT g2) / count(g2) ELSE 0 END AS distinct2, CASE WHEN count(g3) > 0 THEN count(DISTINCT g3) / count(g3) ELSE 0 END AS distinct3 FROM documents LEFT JOIN ag USING (doc_id) GROUP BY documents.doc_id)"""


@R.add("l4_distinct_n", f"WITH {TOKENS_CTE}, {DIST} SELECT doc_id, round(distinct2, 9) AS distinct2, round(distinct3, 9) AS distinct3 FROM dist")
def _(spark, d):
    docs = docs_of(spark, d)
    return _rounded(L.distinct_n(docs, 2, "distinct2").join(L.distinct_n(docs, 3, "distinct3"), "doc_id"), "distinct2", "distinct3")


REP = "rep_topk AS (SELECT doc_id, sum(CASE WHEN r <= 10 THEN c END) / sum(c) AS rep_topk FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, token) AS r FROM (SELECT doc_id, token, count(*) AS c FROM t GROUP BY ALL)) GROUP BY doc_id)"


@R.add("l5_rep_topk", f"WITH {TOKENS_CTE}, {REP} {_sql_out('rep_topk')}")
def _(spark, d):
    return _rounded(L.rep_topk(docs_of(spark, d)), "rep_topk")


MWL = "mean_word_len AS (SELECT doc_id, avg(length(token)) AS mean_word_len FROM t GROUP BY doc_id)"


@R.add("l6_mean_word_len", f"WITH {TOKENS_CTE}, {MWL} {_sql_out('mean_word_len')}")
def _(spark, d):
    return _rounded(L.mean_word_len(docs_of(spark, d)), "mean_word_len")


SYLL = f"syll AS (SELECT doc_id, count(*) AS words, CAST(sum(coalesce(length(stress), greatest(1, {sql_count('word', '[aeiouy]+')}))) AS BIGINT) AS syllables FROM st GROUP BY doc_id)"


@R.add("l7_syllables", f"WITH {LEX}, {SYLL} SELECT * FROM syll")
def _(spark, d):
    docs = docs_of(spark, d)
    s = L.syllable_counts(docs, rhythm.rule_stress)
    return s.select("doc_id", "words", F.col("syllables").cast("long").alias("syllables"))


_sents = f"len(list_filter({sql_sentences('text')}, lambda s: regexp_matches(s, {lit(T.WORDS)})))"
FK = f"fk_grade AS (SELECT d.doc_id, 0.39::DOUBLE * (greatest(coalesce(words, 0), 1) / greatest({_sents}, 1)) + 11.8::DOUBLE * (coalesce(syllables, 0) / greatest(coalesce(words, 0), 1)) - 15.59::DOUBLE AS fk_grade FROM documents d LEFT JOIN syll USING (doc_id))"


@R.add("l8_fk_grade", f"WITH {LEX}, {SYLL}, {FK} {_sql_out('fk_grade', 7)}")
def _(spark, d):
    docs = docs_of(spark, d)
    return _rounded(L.fk_grade(docs, rhythm.rule_stress), "fk_grade", digits=7)


ROW = f"{GRAMS}, {DENS}, {NOTX}, {DIST}, {REP}, {MWL}, {LEX}, {SYLL}, {FK}, {MATTR}, lexrow AS (SELECT doc_id, " + ", ".join(f"round(coalesce({c}, 0), 7) AS {c}" for c in L.COLUMNS) + " FROM documents " + " ".join(f"LEFT JOIN {x} USING (doc_id)" for x in ("slopword_density", "slopbigram_density", "sloptrigram_density", "not_x_but_y_rate", "dist", "rep_topk", "mean_word_len", "fk_grade", "mattr")) + ")"


def row_of(spark, d):
    docs = docs_of(spark, d)
    return L.lexical_features(docs, terms_of(spark, d), STOP, rhythm.rule_stress)


@R.add("l9_lexical_row", f"WITH {ROW} SELECT * FROM lexrow")
def _(spark, d):
    return _rounded(row_of(spark, d), *L.COLUMNS, digits=7)


LABELLED_TOKENS = TOKENS_CTE.replace("FROM documents)", "FROM documents)")


@R.add("l10_mined_terms", f"WITH {TOKENS_CTE}, g AS (SELECT quality AS y, token || ' ' || lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS gram FROM t JOIN labels USING (doc_id)), c AS (SELECT gram, count(*) FILTER (WHERE y = 1) AS a, count(*) FILTER (WHERE y = 0) AS b FROM g WHERE gram IS NOT NULL GROUP BY gram) SELECT gram AS term, 2 AS n, round(ln((a + 1) / ((SELECT sum(a) FROM c) + 1)) - ln((b + 1) / ((SELECT sum(b) FROM c) + 1)), 9) AS log_odds FROM c WHERE a + b >= 5 ORDER BY log_odds DESC, term LIMIT 100")
def _(spark, d):
    return L.mined_terms(docs_of(spark, d).join(table(spark, d, "labels"), "doc_id"), "quality", 2, 100)


@R.add("l11_log_frequency", f"WITH {WORDS_CTE} SELECT word, round(log10(1e9::DOUBLE * c / sum(c) OVER ()), 7) AS zipf FROM (SELECT lower(word) AS word, count(*) AS c FROM w GROUP BY lower(word))")
def _(spark, d):
    return L.logfreq(segment.words(docs_of(spark, d))).select("word", F.round("zipf", 7).alias("zipf"))


@R.add("l12_surprisal", f"WITH {TOKENS_CTE}, p AS (SELECT doc_id, token, lag(token) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM t), c2 AS (SELECT prev, token, count(*) AS c2 FROM p WHERE prev IS NOT NULL GROUP BY ALL), c1 AS (SELECT prev, sum(c2) AS c1 FROM c2 GROUP BY prev), v AS (SELECT count(DISTINCT token) AS v FROM t) SELECT doc_id, count(*) AS n, round(avg(-log2((c2 + 0.1::DOUBLE) / (c1 + 0.1::DOUBLE * v))), 6) AS surprisal FROM p JOIN c2 USING (prev, token) JOIN c1 USING (prev) CROSS JOIN v GROUP BY doc_id")
def _(spark, d):
    s = L.surprisal(docs_of(spark, d))
    return s.groupBy("doc_id").agg(F.count("token").alias("n"), F.round(F.avg("surprisal"), 6).alias("surprisal"))


def _shingles(frm: str, key: str, name: str) -> str:
    toks = f"SELECT {key}, {sql_tokens('text')} AS a FROM {frm}"
    return f"{name} AS (SELECT DISTINCT {key}, array_to_string(a[i:i + 4], ' ') AS g FROM (SELECT {key}, a, unnest(range(1, len(a) - 3)) AS i FROM ({toks}) WHERE len(a) >= 5))"


@R.add("m2_near_duplicates", f"WITH first AS (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text), {_shingles('first', 'doc_id', 's')}, n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL) SELECT a, b, round(c / (na.n + nb.n - c), 9) AS jaccard FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE c / (na.n + nb.n - c) >= 0.8")
def _(spark, d):
    return L.near_duplicates(docs_of(spark, d), 0.8).withColumn("jaccard", F.round("jaccard", 9))


@R.add("m2_leakage", f"WITH {_shingles('documents', 'doc_id', 's')}, {_shingles('benchmark', 'item_id', 'b')}, ns AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), nb AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id), o AS (SELECT item_id, doc_id, c / (ns.n + nb.n - c) AS jaccard FROM (SELECT item_id, doc_id, count(*) AS c FROM s JOIN b USING (g) GROUP BY ALL) JOIN ns USING (doc_id) JOIN nb USING (item_id)) SELECT item_id, arg_max(doc_id, (jaccard, -doc_id)) AS doc_id, round(max(jaccard), 9) AS jaccard FROM o GROUP BY item_id")
def _(spark, d):
    return L.leakage(docs_of(spark, d), table(spark, d, "benchmark"), "doc_id", "item_id").withColumn("jaccard", F.round("jaccard", 9))


_ = SENTENCES_CTE
