"""Queries on cleaning, segmenting and chunking documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from prosemill.functions import text as T
from prosemill.operators import segment
from prosemill.plans.base import SENTENCES_CTE, TOKENS_CTE, WORDS_CTE, Registry, lit, sql_count, sql_md5_int, sql_rules, sql_sentences, sql_squeeze, sql_strip, sql_tokens, sql_unescape, sql_upper, table
from prosemill.sources import staged

R = Registry()


def digest(out):
    """Cleaned text as its hash and length."""
    return [F.md5(out).alias("digest"), F.length(out).cast("long").alias("chars")]


def sql_digest(x: str, frm: str = "documents", key: str = "doc_id", src: str | None = None) -> str:
    return f"SELECT {key}, md5(x) AS digest, CAST(length(x) AS BIGINT) AS chars FROM (SELECT {key}, {x} AS x FROM {src or frm})"


_BREAK = r"\n"
_paras = f"list_filter(list_transform(regexp_split_to_array(text, {lit(_BREAK)}), lambda p: {sql_strip('p')}), lambda p: p <> '')"
_book = f"""SELECT doc_id, replace(array_to_string(list_filter(list_slice(p, CAST(floor(len(p) * 0.12::DOUBLE) AS INT) + 1, CAST(floor(len(p) * 0.95::DOUBLE) AS INT)),
 lambda q: NOT {sql_upper('q')} AND NOT regexp_matches(q, {lit(T.HEADING)})), ' '), '_', '') AS x FROM (SELECT doc_id, {_paras} AS p FROM documents)"""


@R.add("c1_clean_book", f"SELECT doc_id, md5(x) AS digest, CAST(length(x) AS BIGINT) AS chars FROM ({_book})")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", *digest(T.clean_book(F.col("text"), _BREAK)))


@R.add("c2_clean_forum", sql_digest(sql_squeeze(sql_rules(sql_unescape("text"), T.FORUM))))
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", *digest(T.clean_forum(F.col("text"))))


_line = r"regexp_extract(text, '^\s*([^\n]*)', 1)"


@R.add("c3_drop_headline", sql_digest(rf"CASE WHEN {sql_upper(_line)} THEN regexp_replace(text, '^\s*[^\n]*\n?', '') ELSE text END"))
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", *digest(T.drop_headline(F.col("text"))))


@R.add("c4_clean_essay", sql_digest(sql_squeeze(sql_rules("text", T.ESSAY))))
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", *digest(T.clean_essay(F.col("text"))))


# DuckDB has the canonical form only; it equals the compatibility form on these texts.
_typo = f"trim({sql_rules('nfc_normalize(text)', T.TYPOGRAPHY)})"


@R.add("c5_normalize_typography", sql_digest(_typo))
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", *digest(T.normalize_typography(T.nfkc("text"))))


@R.add("c6_renormalize", f"SELECT count(*) AS total, count(*) FILTER (WHERE x <> text) AS changed, CAST(sum(length(x)) AS BIGINT) AS chars FROM (SELECT text, {_typo} AS x FROM documents)")
def _(spark, d):
    new = T.normalize_typography(T.nfkc("text"))
    return table(spark, d, "documents").select("text", new.alias("x")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("x") != F.col("text")).alias("changed"), F.sum(F.length("x")).cast("long").alias("chars"))


@R.add("c7_typography_features", "SELECT doc_id, " + ", ".join(f"round(1000.0::DOUBLE * {sql_count('text', p)} / greatest(length(text), 1), 9) AS {n}" for n, p in T.GLYPHS) + " FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", *[F.round(c, 9).alias(n) for n, c in T.glyph_rates(F.col("text")).items()])


@R.add("c8_detokenize", sql_digest(f"trim({sql_rules('text', T.DETOKENIZE)})"))
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", *digest(T.detokenize(F.col("text"))))


@R.add("c9_page_text", sql_digest(sql_squeeze(sql_unescape(sql_rules("html", T.PAGE))), "pages", "page_id"))
def _(spark, d):
    return table(spark, d, "pages").select("page_id", *digest(T.page_text(F.col("html"))))


@R.add("t1_tokens", f"WITH {TOKENS_CTE} SELECT doc_id, count(*) AS n, count(DISTINCT token) AS n_distinct, CAST(sum(length(token)) AS BIGINT) AS chars, min(token) AS first_token FROM t GROUP BY doc_id")
def _(spark, d):
    t = segment.tokens(table(spark, d, "documents"))
    return t.groupBy("doc_id").agg(F.count("token").alias("n"), F.countDistinct("token").alias("n_distinct"), F.sum(F.length("token")).cast("long").alias("chars"), F.min("token").alias("first_token"))


@R.add("t2_words", f"WITH {WORDS_CTE} SELECT doc_id, count(*) AS n, CAST(sum(pos * length(word)) AS BIGINT) AS placed FROM w GROUP BY doc_id")
def _(spark, d):
    w = segment.words(table(spark, d, "documents"))
    return w.groupBy("doc_id").agg(F.count("word").alias("n"), F.sum(F.col("pos") * F.length("word")).cast("long").alias("placed"))


@R.add("t3_sentences", f"WITH {SENTENCES_CTE} SELECT doc_id, CAST(sent AS BIGINT) AS sent, md5(sentence) AS digest, CAST({sql_count('sentence', T.WORDS)} AS BIGINT) AS words FROM s")
def _(spark, d):
    s = segment.sentences(table(spark, d, "documents"))
    return s.select("doc_id", F.col("sent").cast("long").alias("sent"), F.md5("sentence").alias("digest"), F.regexp_count("sentence", F.lit(T.WORDS)).cast("long").alias("words"))


#: Documents, some of which name a doctor and a number first.
_titled = "p AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Dr. Wolf ran 3.5 km. ' || text ELSE text END AS text FROM documents)"
_learned = rf"""WITH {_titled}, w AS (SELECT unnest(regexp_extract_all(lower(text), '\p{{L}}+\.?')) AS w FROM p), c AS (SELECT regexp_replace(w, '\.$', '') AS word, count(*) AS n, count(*) FILTER (WHERE ends_with(w, '.')) AS dots FROM w GROUP BY 1),
 t AS (SELECT sum(dots) / sum(n) AS p FROM c), ll AS (SELECT word, n, dots, 2 * (CASE WHEN dots > 0 THEN dots * ln(dots / n / p) ELSE 0 END + CASE WHEN n > dots THEN (n - dots) * ln((1 - dots / n) / (1 - p)) ELSE 0 END) AS ll, p FROM c, t WHERE dots >= 5 AND dots >= 0.9::DOUBLE * n AND regexp_matches(word, '^[a-z]{{1,5}}$')),
 a AS (SELECT word, n, dots, ll FROM ll WHERE ll >= 10.83 AND dots > p * n)"""


@R.add("t3_abbreviations", f"{_learned} SELECT word, n, dots, round(ll, 6) AS ll FROM a")
def _(spark, d):
    return segment.abbreviations(titled(spark, d)).withColumn("ll", F.round("ll", 6))


_held = r"regexp_replace(text, '(\d)\.(\d)', '\1․\2', 'g')"
_held = _held.replace("(text,", f"({_held},", 1)  # twice, as neighbours share a digit
_kept = rf"regexp_replace({_held}, '(?i)(^|[^\p{{L}}])(' || (SELECT string_agg(word, '|' ORDER BY word) FROM a) || ')\.', '\1\2․', 'g')"


@R.add("t3_learned_sentences", f"{_learned}, k AS (SELECT doc_id, {sql_sentences(_kept)} AS s FROM p) SELECT doc_id, CAST(len(s) AS BIGINT) AS n, md5(replace(array_to_string(s, '|'), '․', '.')) AS digest FROM k WHERE len(s) > 0")
def _(spark, d):
    docs = staged(titled(spark, d))
    known = [r["word"] for r in segment.abbreviations(docs).orderBy(F.desc("ll"), "word").limit(10_000).collect()]  # short words: a bounded list
    s = segment.learned_sentences(docs, known)
    return s.groupBy("doc_id").agg(F.count("sent").alias("n"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent", "sentence"))), lambda x: x["sentence"]), "|")).alias("digest"))


def titled(spark, d):
    first = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Dr. Wolf ran 3.5 km. "), "text")).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", first.alias("text"))


@R.add("t5_lengths", f"SELECT doc_id, CAST({sql_count('text', chr(92) + 'S+')} AS BIGINT) AS words, CAST(length(text) AS BIGINT) AS chars FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).cast("long").alias("words"), F.length("text").cast("long").alias("chars"))


STOP = ["the", "of", "and", "a", "in", "to", "is", "that", "it", "for"]
_stop = ", ".join(map(lit, STOP))


@R.add("t6_ngrams", f"""WITH {TOKENS_CTE}, c AS (SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM t WHERE token NOT IN ({_stop})),
 g AS (SELECT doc_id, token || ' ' || lead(token) OVER (PARTITION BY doc_id ORDER BY p) AS gram FROM c)
 SELECT gram, count(*) AS n, count(DISTINCT doc_id) AS docs FROM g WHERE gram IS NOT NULL GROUP BY gram""")
def _(spark, d):
    g = segment.ngrams(table(spark, d, "documents"), 2, stop=STOP)
    return g.groupBy("gram").agg(F.count("gram").alias("n"), F.countDistinct("doc_id").alias("docs"))


def chunk_sql(lo: int, hi: int, cap: int | None, tail: int, span: int, frm: str = "documents", key: str = "doc_id", body: str = "text") -> str:
    """A recursive walk over each document's sentences."""
    target = f"{lo} + {sql_md5_int(str(0), 'f.d', 'f.k')} % {span}"
    fits = (lambda n, low: f"({n} BETWEEN {low} AND {cap})") if cap is not None else (lambda n, low: f"({n} >= {low})")
    skip = f"(f.n = 0 AND s.n > {hi})" if cap is not None else "FALSE"
    full = f"(f.n + s.n >= {target}" + (f" OR f.n + s.n >= {hi})" if cap is not None else ")")
    emit = fits("f.n + s.n", 0 if cap is None else lo)
    return f"""WITH RECURSIVE s0 AS (SELECT {key} AS d, {sql_sentences(sql_squeeze(body))} AS a FROM {frm}),
 s AS (SELECT d, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS s, {sql_count('unnest(a)', chr(92) + 'S+')} AS n FROM s0),
 f AS (SELECT d, CAST(0 AS BIGINT) AS i, CAST('' AS VARCHAR) AS buf, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS made, CAST(0 AS BIGINT) AS words FROM s0
  UNION ALL SELECT f.d, s.i,
   CASE WHEN {skip} THEN f.buf WHEN {full} THEN '' WHEN f.n = 0 THEN s.s ELSE f.buf || ' ' || s.s END,
   CASE WHEN {skip} THEN f.n WHEN {full} THEN 0 ELSE f.n + s.n END,
   CASE WHEN {skip} THEN f.k WHEN {full} THEN f.k + 1 ELSE f.k END,
   CASE WHEN {skip} THEN NULL WHEN {full} AND {emit} THEN CASE WHEN f.n = 0 THEN s.s ELSE f.buf || ' ' || s.s END END,
   CASE WHEN {skip} THEN 0 WHEN {full} THEN f.n + s.n ELSE 0 END
  FROM f JOIN s ON s.d = f.d AND s.i = f.i + 1),
 l AS (SELECT d, max(i) AS i FROM f GROUP BY d),
 m AS (SELECT d, i, made AS text, words FROM f WHERE made IS NOT NULL
  UNION ALL SELECT f.d, f.i + 1, f.buf, f.n FROM f JOIN l ON l.d = f.d AND l.i = f.i WHERE f.n > 0 AND {fits('f.n', tail)}),
 c AS (SELECT d AS {key}, row_number() OVER (PARTITION BY d ORDER BY i) - 1 AS chunk, text, words FROM m)"""


_chunk_cols = "SELECT doc_id, CAST(chunk AS BIGINT) AS chunk, md5(text) AS digest, CAST(words AS BIGINT) AS words FROM c"


def chunk_digest(c):
    return c.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.md5("text").alias("digest"), F.col("words").cast("long").alias("words"))


@R.add("t7_chunks", f"{chunk_sql(150, 400, 400, 150, 251)} {_chunk_cols}")
def _(spark, d):
    return chunk_digest(segment.chunk_sentences(table(spark, d, "documents")))


@R.add("t8_essay_chunks", f"{chunk_sql(220, 320, None, 150, 100)} {_chunk_cols}")
def _(spark, d):
    return chunk_digest(segment.chunk_sentences(table(spark, d, "documents"), lo=220, hi=320, cap=None, tail_min=150, span=100))


@R.add("t9_first_chunks", f"{chunk_sql(150, 400, 400, 150, 251)} {_chunk_cols} WHERE chunk < 3")
def _(spark, d):
    return chunk_digest(segment.first_k(segment.chunk_sentences(table(spark, d, "documents")), "doc_id", "chunk", 3))


_total = f"list_sum(list_transform(a, lambda s: {sql_count('s', chr(92) + 'S+')}))"


@R.add("t10_parts", f"""WITH p AS (SELECT doc_id, {sql_sentences('text')} AS a FROM documents), h AS (SELECT doc_id, a, len(a) // 2 AS h, {_total} AS n FROM p WHERE len(a) > 0),
 x AS (SELECT doc_id, 0 AS part, array_to_string(CASE WHEN n <= 300 THEN a ELSE a[1:h] END, ' ') AS text FROM h UNION ALL SELECT doc_id, 1, array_to_string(a[h + 1:], ' ') FROM h WHERE n > 300)
 SELECT doc_id, count(*) AS parts, md5(string_agg(text, ' ' ORDER BY part)) AS digest FROM x GROUP BY doc_id""")
def _(spark, d):
    parts = segment.split_parts(table(spark, d, "documents"))
    n = parts.groupBy("doc_id").agg(F.count("part").alias("parts"))
    return segment.join_parts(parts).join(n, "doc_id").select("doc_id", "parts", F.md5("text").alias("digest"))
