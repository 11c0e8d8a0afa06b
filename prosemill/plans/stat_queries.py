"""Queries on bootstrap, permutation, regression and verdicts."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from prosemill.functions import text as T
from prosemill.operators import gates, models, segment, stats
from prosemill.operators.residuals import Residualizer, ResidualizerModel
from prosemill.plans.base import SENTENCES_CTE, Registry, lit, sql_md5_int, sql_sentences, table
from prosemill.plans.table_queries import fold_sql, grouped, sql_folds
from prosemill.plans.text_queries import STOP, sql_tokens
from prosemill.sources import shared_path, staged

R = Registry()

#: Predictions derived from the tables: by length, by a hash, by the other label, and three noisy rewrites.
PREDS = f"""preds AS (SELECT doc_id, source AS grp, quality AS y, CAST(n_chars > 1500 AS INT) AS pa, CAST({sql_md5_int('1', 'doc_id')} % 2 AS INT) AS pb, 1 - toxic AS pc,
 CAST({sql_md5_int('2', 'doc_id')} % 3 > 0 AS INT) AS pd, CAST({sql_md5_int('3', 'doc_id')} % 4 > 0 AS INT) AS pe FROM documents JOIN labels USING (doc_id))"""


def preds(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    h = lambda s: T.md5_int(F.lit(s), F.col("doc_id"))
    return j.select("doc_id", F.col("source").alias("grp"), F.col("quality").alias("y"), (F.col("n_chars") > 1500).cast("int").alias("pa"), (h(1) % 2).cast("int").alias("pb"), (1 - F.col("toxic")).alias("pc"), (h(2) % 3 > 0).cast("int").alias("pd"), (h(3) % 4 > 0).cast("int").alias("pe"))


def sql_cells(p: str) -> str:
    return ", ".join(f"count(*) FILTER (WHERE y = {a} AND {p} = {b}) AS {p}{a}{b}" for a in (0, 1) for b in (0, 1))


def sql_ba(p: str) -> str:
    return f"CASE WHEN {p}00 + {p}01 > 0 AND {p}10 + {p}11 > 0 THEN ({p}00 / ({p}00 + {p}01) + {p}11 / ({p}10 + {p}11)) / 2 END"


def sql_draws(ps: list[str], reps: int, seed: int) -> str:
    """CTEs up to draws (replicate, <p>...)."""
    sums = ", ".join(f"sum({p}{a}{b}) AS {p}{a}{b}" for p in ps for a in (0, 1) for b in (0, 1))
    return f"""gc AS (SELECT grp, {', '.join(map(sql_cells, ps))} FROM preds GROUP BY grp), gi AS (SELECT *, row_number() OVER (ORDER BY grp) - 1 AS i FROM gc),
 slots AS (SELECT r.r AS replicate, {sql_md5_int(str(seed), 'r.r', 's.s')} % (SELECT count(*) FROM gc) AS i FROM range({reps}) r(r), (SELECT unnest(range(0, (SELECT count(*) FROM gc))) AS s) s),
 sm AS (SELECT replicate, {sums} FROM slots JOIN gi USING (i) GROUP BY replicate), draws AS (SELECT replicate, {', '.join(f'{sql_ba(p)} AS {p}' for p in ps)} FROM sm)"""


def sql_interval(x: str, frm: str = "draws") -> str:
    return f"SELECT round(quantile_cont(v, 0.025), 9) AS lo, round(quantile_cont(v, 0.975), 9) AS hi, round(avg(v), 9) AS mean, count(v) AS draws FROM (SELECT {x} AS v FROM {frm}) WHERE v IS NOT NULL"


def interval(df):
    return df.select(*[F.round(c, 9).alias(c) for c in ("lo", "hi", "mean")], "draws")


_f1 = lambda tp, fp, fn: f"CASE WHEN 2 * {tp} + {fp} + {fn} > 0 THEN 2 * {tp} / (2 * {tp} + {fp} + {fn}) ELSE 0 END"


@R.add("u1_balanced_accuracy", f"WITH {PREDS}, c AS (SELECT grp, {sql_cells('pa')}, count(*) AS n FROM preds GROUP BY grp) SELECT grp, round({sql_ba('pa')}, 9) AS balanced_accuracy, round(({_f1('pa00', 'pa10', 'pa01')} + {_f1('pa11', 'pa01', 'pa10')}) / 2, 9) AS macro_f1, n FROM c")
def _(spark, d):
    b = stats.balanced_accuracy(preds(spark, d), "y", "pa", by=["grp"])
    return b.select("grp", F.round("balanced_accuracy", 9).alias("balanced_accuracy"), F.round("macro_f1", 9).alias("macro_f1"), "n")


@R.add("u2_row_bootstrap")
def _(spark, d):
    return stats.row_bootstrap_ci(preds(spark, d), 2000, 0, "y", "pa")


@R.add("u3_group_bootstrap", f"WITH {PREDS}, {sql_draws(['pa'], 500, 0)} {sql_interval('pa')}")
def _(spark, d):
    return interval(stats.group_bootstrap_ci(preds(spark, d), "grp", 500, 0, "y", "pa"))


_poisson, _total, _at = [], 0.0, math.exp(-1)
for _k in range(10):
    _total += _at
    _poisson.append(f"CAST(u >= {_total!r}::DOUBLE AS INT)")
    _at /= _k + 1


@R.add("u3_poisson_bootstrap", f"""WITH {PREDS}, c AS (SELECT doc_id, {sql_cells('pa')} FROM preds GROUP BY doc_id), w AS (SELECT r, c.*, {' + '.join(_poisson)} AS w FROM (SELECT r, c.*, {sql_md5_int('0', 'r', 'doc_id')} / 4294967296.0::DOUBLE AS u FROM c, range(200) t(r)) c),
 s AS (SELECT r, {', '.join(f'sum(pa{x} * w) AS pa{x}' for x in ('00', '01', '10', '11'))} FROM w GROUP BY r), draws AS (SELECT {sql_ba('pa')} AS pa FROM s) {sql_interval('pa')}""")
def _(spark, d):
    return interval(stats.poisson_bootstrap_ci(preds(spark, d), "doc_id", 200, 0, "y", "pa"))


@R.add("u4_bootstrap_increment", f"WITH {PREDS}, {sql_draws(['pa', 'pc'], 500, 0)} {sql_interval('pc - pa')}")
def _(spark, d):
    return interval(stats.group_bootstrap_increment(preds(spark, d), "grp", "pa", "pc", 500, 0))


@R.add("u5_diff_in_drops", f"WITH {PREDS}, {sql_draws(['pa', 'pb', 'pc', 'pd'], 500, 0)} {sql_interval('(pc - pd) - (pa - pb)')}")
def _(spark, d):
    return interval(stats.bootstrap_diff_in_drops(preds(spark, d), "grp", ("pa", "pb"), ("pc", "pd"), 500, 0))


@R.add("u6_diff_over_realizations", f"WITH {PREDS}, {sql_draws(['pa', 'pb', 'pd', 'pc', 'pe'], 500, 0)} {sql_interval('(pc - (pb + pe) / 2) - (pa - (pb + pd) / 2)')}")
def _(spark, d):
    return interval(stats.bootstrap_diff_over_realizations(preds(spark, d), "grp", ("pa", ["pb", "pd"]), ("pc", ["pb", "pe"]), 500, 0))


def sql_permuted(groups: str, reps: int, seed: int = 0) -> str:
    """A query for (grp, replicate, label) over groups (grp, y): 0 is the truth; in the others the least hashes have label 1, as many as in truth."""
    ranks = f"SELECT grp, r, row_number() OVER (PARTITION BY r ORDER BY {sql_md5_int(str(seed), 'r', 'grp')}, grp) AS i FROM {groups}, range({reps}) t(r)"
    return f"SELECT grp, 0 AS replicate, y AS label FROM {groups} UNION ALL SELECT grp, CAST(r AS INT) + 1, CAST(i <= (SELECT count(*) FILTER (WHERE y = 1) FROM {groups}) AS INT) FROM ({ranks})"


_perm = f"""WITH {PREDS}, g AS (SELECT grp || '#' || y AS grp, min(y) AS y, count(*) FILTER (WHERE pc = 1) AS n1, count(*) FILTER (WHERE pc = 0) AS n0 FROM preds GROUP BY grp, preds.y), l AS ({sql_permuted('g', 300)}),
 s AS (SELECT replicate, sum(CASE WHEN label = 0 THEN n0 ELSE 0 END) AS pc00, sum(CASE WHEN label = 0 THEN n1 ELSE 0 END) AS pc01, sum(CASE WHEN label = 1 THEN n0 ELSE 0 END) AS pc10, sum(CASE WHEN label = 1 THEN n1 ELSE 0 END) AS pc11 FROM l JOIN g USING (grp) GROUP BY replicate),
 dr AS (SELECT replicate, {sql_ba('pc')} AS d FROM s), re AS (SELECT d AS ba FROM dr WHERE replicate = 0)
 SELECT round(ba, 9) AS ba, round((count(*) FILTER (WHERE d >= ba - 1e-12) + 1) / (count(d) + 1), 9) AS p_value, count(d) AS draws FROM dr, re WHERE replicate > 0 AND d IS NOT NULL GROUP BY ba"""


@R.add("u7_threshold_permutation", _perm)
def _(spark, d):
    p = preds(spark, d).withColumn("grp", F.concat_ws("#", "grp", F.col("y").cast("string")))
    t = stats.threshold_permutation_test(p, "grp", 300, 0, "y", "pc")
    return t.select(F.round("ba", 9).alias("ba"), F.round("p_value", 9).alias("p_value"), "draws")


FEATS = ["words", "sents", "ttr", "mean_len"]
_len = "array_to_string(t, '')"
#: The CTE f: features() in SQL.
FEATURES = f"""{fold_sql()}, f AS (SELECT doc_id, lang, source AS grp, grp AS perm_group, y, fold, CAST(len(t) AS DOUBLE) AS words, CAST(sents AS DOUBLE) AS sents, len(list_distinct(t)) / greatest(len(t), 1) AS ttr, length({_len}) / greatest(len(t), 1) AS mean_len
 FROM (SELECT doc_id, lang, source, {sql_tokens('text')} AS t, len({sql_sentences('text')}) AS sents FROM documents) JOIN folded USING (doc_id))"""


def features(spark, d):
    """A few features of the labelled documents, with groups and folds."""
    toks = T.tokens(F.col("text"))
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("t", toks)
    n = F.greatest(F.size("t"), F.lit(1))
    f = j.select(
        "doc_id", "lang", F.col("source").alias("grp"), F.concat_ws("#", "source", F.col("quality").cast("string")).alias("perm_group"), F.col("quality").alias("y"),
        F.size("t").cast("double").alias("words"), F.size(T.sentences(F.col("text"))).cast("double").alias("sents"),
        (F.size(F.array_distinct("t")) / n).alias("ttr"), (F.length(F.array_join("t", "")) / n).alias("mean_len"),
    )
    return models.with_folds(f, "perm_group")


def _solve(cols: str, d: int, body: str) -> str:
    """x0.. of the symmetric equations a x = g in the columns a<i>_<j> (j >= i) and g<i>; the columns cols stay."""
    n = range(d)
    for s in n:
        keep = [f"a{i}_{j} - a{s}_{i} / a{s}_{s} * a{s}_{j} AS a{i}_{j}" for i in n if i > s for j in n if j >= i] + [f"g{i} - a{s}_{i} / a{s}_{s} * g{s} AS g{i}" for i in n if i > s]
        old = [f"a{i}_{j}" for i in n if i <= s for j in n if j >= i] + [f"g{i}" for i in n if i <= s]
        body = f"SELECT {', '.join([*([cols] if cols else []), *old, *keep])} FROM ({body})"
    for i in reversed(n):
        body = f"SELECT *, (g{i}{''.join(f' - a{i}_{j} * x{j}' for j in n if j > i)}) / a{i}_{i} AS x{i} FROM ({body})"
    return body


def sql_logreg(src: str, cols: list[str], name: str, held: str = "SELECT DISTINCT fold AS k FROM {}", alt: str | None = None, out: str = "p", steps: int = 12, on: str = "fold <> k", mine: str = "k IN (f.fold, -1)") -> str:
    """CTEs up to <name>: rows of alt, or src, of fold k with the prediction of the model of the other folds, for each held k; -1 holds none back.

    on and mine say which rows teach model k and which it predicts. The loss is
    the logistic loss with half the squared weights added, on columns less
    their mean over their sample deviation, solved by Newton's steps; each
    solves its equations by elimination.
    """
    d = range(len(cols) + 1)
    n = f"{name}_"
    ctes = [
        f"{n}k AS MATERIALIZED ({held.format(src)})",
        f"{n}st AS MATERIALIZED (SELECT k, {', '.join(f'avg({c}) AS m{i}, stddev_samp({c}) AS s{i}' for i, c in enumerate(cols, 1))} FROM {src} JOIN {n}k ON {on} GROUP BY k)",
        f"{n}z AS MATERIALIZED (SELECT k, y, 1.0::DOUBLE AS z0, {', '.join(f'({c} - m{i}) / s{i} AS z{i}' for i, c in enumerate(cols, 1))} FROM {src} JOIN {n}st ON {on})",
        f"{n}b0 AS MATERIALIZED (SELECT k, {', '.join(f'0.0::DOUBLE AS b{i}' for i in d)} FROM {n}k)",
    ]
    for t in range(steps):
        eta = " + ".join(f"b{i} * z{i}" for i in d)
        sums = [f"sum(z{i} * z{j} * p * (1 - p)){' + 1' if i == j and i else ''} AS a{i}_{j}" for i in d for j in d if j >= i] + [f"sum((y - p) * z{i}){f' - any_value(b{i})' if i else ''} AS g{i}" for i in d] + [f"any_value(b{i}) AS b{i}" for i in d]
        body = f"SELECT k, {', '.join(sums)} FROM (SELECT *, 1 / (1 + exp(-({eta}))) AS p FROM {n}z JOIN {n}b{t} USING (k)) GROUP BY k"
        for s in d:
            keep = [f"a{i}_{j} - a{s}_{i} / a{s}_{s} * a{s}_{j} AS a{i}_{j}" for i in d if i > s for j in d if j >= i] + [f"g{i} - a{s}_{i} / a{s}_{s} * g{s} AS g{i}" for i in d if i > s]
            old = [f"a{i}_{j}" for i in d if i <= s for j in d if j >= i] + [f"g{i}" for i in d if i <= s] + [f"b{i}" for i in d]
            body = f"SELECT k, {', '.join(old + keep)} FROM ({body})"
        back = []
        for i in reversed(d):
            back.append(f"(g{i}{''.join(f' - a{i}_{j} * x{j}' for j in d if j > i)}) / a{i}_{i} AS x{i}")
            body = f"SELECT *, {back[-1]} FROM ({body})"
        ctes.append(f"{n}b{t + 1} AS MATERIALIZED (SELECT k, {', '.join(f'b{i} + x{i} AS b{i}' for i in d)} FROM ({body}))")
    score = "b0 + " + " + ".join(f"b{i} * ({c} - m{i}) / s{i}" for i, c in enumerate(cols, 1))
    ctes.append(f"{name} AS MATERIALIZED (SELECT f.*, {score} AS {out}_z, CAST({score} > 0 AS INT) AS {out} FROM {alt or src} f JOIN {n}b{steps} ON {mine} JOIN {n}st USING (k))")
    return ", ".join(ctes)


def metrics_sql(frm: str, by: str = "") -> str:
    """balanced_accuracy() of the column p of frm."""
    k = f"{by}, " if by else ""
    f1 = f"({_f1('p00', 'p10', 'p01')} + {_f1('p11', 'p01', 'p10')}) / 2"
    return f"SELECT {k}round({sql_ba('p')}, 9) AS balanced_accuracy, round({f1}, 9) AS macro_f1, p00 + p01 + p10 + p11 AS n FROM (SELECT {k}{sql_cells('p')} FROM {frm} {f'GROUP BY {by}' if by else ''})"


def rounded_metrics(df, *by):
    return df.select(*by, F.round("balanced_accuracy", 9).alias("balanced_accuracy"), F.round("macro_f1", 9).alias("macro_f1"), "n")


ALL_ROWS = "SELECT -1 AS k"


def sql_permutation_test(src: str, cols: list[str], reps: int, more: str = "") -> str:
    """CTEs up to pt (ba, p_value, draws): stats.group_permutation_test of src (doc_id, perm_group, y, fold, cols); more: the column of src whose value is the fold that the columns are made for, if they are."""
    own = f"AND {more} = k % 100" if more else ""
    fits = sql_logreg("pf", cols, "pm", "SELECT DISTINCT replicate * 100 + fold AS k FROM {}", on=f"replicate = k // 100 AND fold <> k % 100 {own}", mine=f"f.replicate = k // 100 AND f.fold = k % 100 {own}")
    return f"""pg AS (SELECT perm_group AS grp, min(y) AS y FROM {src} GROUP BY perm_group), pl AS ({sql_permuted('pg', reps)}),
 pf AS (SELECT s.* REPLACE (label AS y), replicate FROM {src} s JOIN pl ON pl.grp = s.perm_group), {fits},
 pc AS (SELECT replicate, fold, count(*) FILTER (WHERE y = 0 AND p = 0) / nullif(count(*) FILTER (WHERE y = 0), 0) AS r0, count(*) FILTER (WHERE y = 1 AND p = 1) / nullif(count(*) FILTER (WHERE y = 1), 0) AS r1 FROM pm GROUP BY ALL),
 pb AS (SELECT replicate, avg((coalesce(r0, r1) + coalesce(r1, r0)) / 2) AS d FROM pc GROUP BY replicate),
 pt AS (SELECT round(x.d, 9) AS ba, round((count(*) FILTER (WHERE pb.d >= x.d - 1e-12) + 1) / (count(*) + 1), 9) AS p_value, count(*) AS draws FROM pb, (SELECT d FROM pb WHERE replicate = 0) x WHERE replicate > 0 GROUP BY x.d)"""


@R.add("u7_group_permutation", f"WITH {FEATURES}, {sql_permutation_test('f', FEATS, 30)} SELECT * FROM pt")
def _(spark, d):
    t = stats.group_permutation_test(features(spark, d), FEATS, "perm_group", "y", replicates=30)
    return t.select(F.round("ba", 9).alias("ba"), F.round("p_value", 9).alias("p_value"), "draws")


def _shuffled_sql(repeats: int, seed: int = 0) -> str:
    rank = lambda s: f"row_number() OVER (PARTITION BY r ORDER BY {sql_md5_int(str(s), 'r', 'doc_id')}, doc_id)"
    moved = " UNION ALL ".join(f"SELECT '{c}' AS feature, a.r, a.y, CAST(a.p_z + s.b{i} / s.s{i} * (o.{c} - a.{c}) > 0 AS INT) AS p FROM a JOIN o USING (r, i) CROSS JOIN s" for i, c in enumerate(FEATS, 1))
    return f"e AS (SELECT * FROM m, range({repeats}) t(r)), a AS (SELECT *, {rank(seed)} AS i FROM e), o AS (SELECT *, {rank(seed + 1)} AS i FROM e), s AS (SELECT * FROM m_b12 JOIN m_st USING (k)), v AS ({moved})"


@R.add("u8_permutation_importance", f"WITH {FEATURES}, {sql_logreg('f', FEATS, 'm', ALL_ROWS)}, {_shuffled_sql(10)}, w AS ({metrics_sql('v', 'feature, r')}), x AS ({metrics_sql('m')}) SELECT feature, round((SELECT balanced_accuracy FROM x) - avg(balanced_accuracy), 7) + 0 AS importance FROM w GROUP BY feature")
def _(spark, d):
    f = staged(features(spark, d))
    i = models.permutation_importance(models.fit_logreg(f, FEATS), f, FEATS, "doc_id", repeats=10)
    return i.select("feature", (F.round("importance", 7) + 0).alias("importance"))


@R.add("u9_logistic_regression", f"WITH {FEATURES}, {sql_logreg('f', FEATS, 'm', ALL_ROWS)} SELECT y, p, count(*) AS count FROM m GROUP BY y, p")
def _(spark, d):
    f = staged(features(spark, d))
    return models.predict(models.fit_logreg(f, FEATS), f).groupBy("y", "p").count()


@R.add("u10_decision_tree")
def _(spark, d):
    f = staged(features(spark, d))
    m = models.fit_tree(f, FEATS)
    return models.tree_predict(m, f).groupBy("y", "p").agg(F.count(F.lit(1)).alias("n"), F.lit(models.tree_text(m, FEATS)).alias("tree"))


@R.add("u11_out_of_fold", f"WITH {FEATURES}, {sql_logreg('f', FEATS, 'm')} {metrics_sql('m')}")
def _(spark, d):
    f = staged(features(spark, d))
    return rounded_metrics(stats.balanced_accuracy(models.oof_predict(f, FEATS)))


_alt = "alt AS (SELECT * REPLACE (ttr * 0.9::DOUBLE AS ttr, words * 1.1::DOUBLE AS words) FROM f)"


@R.add("u12_paired_out_of_fold", f"WITH {FEATURES}, {_alt}, {sql_logreg('f', FEATS, 'm')}, {sql_logreg('f', FEATS, 'x', alt='alt')} SELECT m.y, m.p AS p_orig, x.p AS p_alt, count(*) AS count FROM m JOIN x USING (doc_id) GROUP BY ALL")
def _(spark, d):
    f = staged(features(spark, d))
    alt = f.withColumn("ttr", F.col("ttr") * 0.9).withColumn("words", F.col("words") * 1.1)
    return models.paired_oof(f, alt, FEATS, "doc_id").groupBy("y", "p_orig", "p_alt").count()


_fold_words = f"f AS (SELECT doc_id, folded.fold, CAST(len({sql_tokens('text')}) AS DOUBLE) AS words, CAST(n_chars AS DOUBLE) AS chars FROM documents JOIN folded USING (doc_id))"


@R.add("u13_residuals", f"WITH {fold_sql()}, {_fold_words}, k AS (SELECT a.fold, regr_slope(b.words, b.chars) AS s, regr_intercept(b.words, b.chars) AS i FROM (SELECT DISTINCT fold FROM f) a JOIN f b ON a.fold <> b.fold GROUP BY a.fold) SELECT doc_id, round(words - (i + s * chars), 4) + 0 AS words FROM f JOIN k USING (fold)")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).cast("double").alias("words"), F.col("n_chars").cast("double").alias("chars"))
    from prosemill.operators import sampling

    f = staged(docs.join(sampling.with_folds(grouped(spark, d), "grp", "y").select("doc_id", "fold"), "doc_id"))
    return stats.residualize(f, ["words"], ["chars"]).select("doc_id", (F.round("words", 4) + 0).alias("words"))


def sql_residuals(src: str, feats: list[str], covs: list[str], name: str, keys: str = "SELECT DISTINCT fold AS k FROM {}", on: str = "fold <> k") -> str:
    """CTEs up to <name>: the rows of src once for each k, as kk, with feats less their least-squares fit on covs by the rows of src that on holds for."""
    z = ["1.0::DOUBLE", *covs]
    d, n = range(len(z)), f"{name}_"
    out = [f"{n}k AS ({keys.format(src)})"]
    for f in feats:
        sums = [f"sum({z[i]} * {z[j]}) AS a{i}_{j}" for i in d for j in d if j >= i] + [f"sum({z[i]} * {f}) AS g{i}" for i in d]
        out.append(f"{n}{f} AS MATERIALIZED (SELECT k, {', '.join(f'x{i}' for i in d)} FROM ({_solve('k', len(z), f'SELECT k, {chr(44).join(sums)} FROM {src} JOIN {n}k ON {on} GROUP BY k')}))")
    left = ", ".join(f"{f} - ({' + '.join(f'{n}{f}.x{i} * {z[i]}' for i in d)}) AS {f}" for f in feats)
    out.append(f"{name} AS MATERIALIZED (SELECT s.* REPLACE ({left}), {n}k.k AS kk FROM {src} s CROSS JOIN {n}k {' '.join(f'JOIN {n}{f} ON {n}{f}.k = {n}k.k' for f in feats)})")
    return ", ".join(out)


_rf, _rc = ["ttr", "mean_len"], ["words", "sents"]
_u14 = f"""WITH {FEATURES}, {sql_residuals('f', _rf, _rc, 'rk')}, {sql_logreg('rk', _rf, 'm', 'SELECT DISTINCT kk AS k FROM {}', on='kk = k AND fold <> k', mine='f.kk = k AND f.fold = k')}, preds AS (SELECT grp, y, p AS pa FROM m), {sql_draws(['pa'], 200, 0)}, i AS ({sql_interval('pa')}), b AS ({metrics_sql('m')}),
 {sql_permutation_test('rk', _rf, 20, 'kk')} SELECT balanced_accuracy AS ba, lo AS ci_low, hi AS ci_high, p_value AS perm_p FROM b, i, pt"""


_on_dev = sql_residuals("f", _rf, _rc, "r", "SELECT 0 AS k", "fold <> k")


@R.add("u13_residualizer", f"WITH {FEATURES}, {_on_dev} SELECT doc_id, round(ttr, 7) + 0 AS ttr, round(mean_len, 6) + 0 AS mean_len FROM r WHERE fold = 0")
def _(spark, d):
    f = staged(features(spark, d))
    path = shared_path(spark)
    Residualizer(featureCols=_rf, covariateCols=_rc).fit(f.where("fold <> 0")).write().save(path)
    held = ResidualizerModel.load(path).transform(f.where("fold = 0"))
    return held.select("doc_id", (F.round("ttr", 7) + 0).alias("ttr"), (F.round("mean_len", 6) + 0).alias("mean_len"))


@R.add("u14_residual_contrast", _u14)
def _(spark, d):
    r = models.residual_contrast(staged(features(spark, d)), _rf, _rc, "grp", permutations=20)
    return spark.createDataFrame([tuple(round(float(v), 9) for v in r.values())], ", ".join(f"{k} double" for k in r))


SETS = {"length_set": ["words", "sents"], "lexical_set": ["ttr", "mean_len"]}


def contrast_sql(where: str = "TRUE", reps: int = 200) -> str:
    names = {**SETS, "all_sets": FEATS}
    fits = ", ".join(sql_logreg("g", cols, f"c_{n}", out=n) for n, cols in names.items())
    joined = " ".join(f"JOIN c_{n} USING (doc_id)" for n in SETS)
    both = f"preds AS (SELECT c_all_sets.grp, c_all_sets.y, {', '.join(f'c_{n}.{n}' for n in names)} FROM c_all_sets {joined})"
    rows = " UNION ALL ".join(
        f"SELECT '{n}' AS name, (SELECT round({sql_ba(n)}, 9) FROM (SELECT {sql_cells(n)} FROM preds)) AS ba, round(quantile_cont({n}, 0.025), 9) AS lo, round(quantile_cont({n}, 0.975), 9) AS hi, round(avg(all_sets - {n}), 9) + 0 AS increment, round(quantile_cont(all_sets - {n}, 0.025), 9) AS inc_lo, round(quantile_cont(all_sets - {n}, 0.975), 9) AS inc_hi FROM draws"
        for n in names
    )
    return f"WITH {FEATURES}, g AS (SELECT * FROM f WHERE {where}), {fits}, {both}, {sql_draws(list(names), reps, 0)} {rows}"


def rounded_contrast(df):
    return df.select("name", *[(F.round(c, 9) + 0).alias(c) for c in df.columns[1:]])


@R.add("u15_contrast", contrast_sql())
def _(spark, d):
    return rounded_contrast(models.contrast(features(spark, d), SETS, "doc_id", "grp"))


@R.add("u16_contrast_excluding", contrast_sql("NOT regexp_matches(grp, '(?i)^src1$')"))
def _(spark, d):
    return rounded_contrast(models.contrast(features(spark, d), SETS, "doc_id", "grp", exclude="^src1$"))


_single = {"all": FEATS, "words": ["words"], "ttr": ["ttr"]}
_one_sql = lambda n: f"SELECT '{n}' AS name, balanced_accuracy AS ba FROM ({metrics_sql('m_' + n)})"


@R.add("u17_baseline_margin", f"WITH {FEATURES}, {', '.join(sql_logreg('f', c, f'm_{n}') for n, c in _single.items())}, b AS ({' UNION ALL '.join(map(_one_sql, _single))}), w AS (SELECT max(ba) FILTER (WHERE name = 'all') AS a, max(ba) FILTER (WHERE name <> 'all') AS best FROM b) SELECT name, ba, round(CASE WHEN name = 'all' THEN a - best ELSE a - ba END, 7) + 0 AS margin FROM b, w")
def _(spark, d):
    m = models.baseline_margin(staged(features(spark, d)), FEATS, ["words", "ttr"])
    return m.select("name", F.round("ba", 9).alias("ba"), (F.round("margin", 7) + 0).alias("margin"))


@R.add("u18_score_heldout", f"WITH {FEATURES}, {sql_logreg('f', FEATS, 'm', 'SELECT 0 AS k')}, preds AS (SELECT grp, y, p AS pa FROM m), {sql_draws(['pa'], 500, 0)}, i AS ({sql_interval('pa')}), b AS ({metrics_sql('m')}) SELECT balanced_accuracy, n, lo, hi, draws FROM i, b")
def _(spark, d):
    f = staged(features(spark, d).withColumn("split", F.when(F.col("fold") == 0, "held_out").otherwise("dev")))
    p = staged(models.score_heldout(f, FEATS))
    ci = interval(stats.group_bootstrap_ci(p, "grp", 500)).drop("mean")
    return rounded_metrics(stats.balanced_accuracy(p)).drop("macro_f1").crossJoin(ci)


_era = f"""e0 AS (SELECT f.* REPLACE (CASE WHEN lang = 'es' THEN 1 ELSE y END AS y, CASE WHEN lang = 'es' AND grp = 'src1' THEN 'src1_' || (row_number() OVER (PARTITION BY lang = 'es' AND grp = 'src1' ORDER BY doc_id) - 1) % 5 ELSE grp END AS grp), lang = 'es' AS band FROM f),
 e1 AS (SELECT doc_id, lang, band, e0.grp AS source, e0.grp || '#' || y AS grp, y, words, sents, ttr, mean_len FROM e0), {sql_folds('e1', name='efolds', n='e')},
 e AS (SELECT e1.*, efolds.fold FROM e1 JOIN efolds USING (grp))"""


@R.add("u19_balanced_rerun", f"WITH {FEATURES}, {_era}, {sql_logreg('e', FEATS, 'm')}, b AS ({metrics_sql('m')}), o AS (SELECT doc_id, y AS old_y, fold AS old_fold FROM f) SELECT fold, y, band, count(*) AS n, count(DISTINCT grp) AS n_groups, count(*) FILTER (WHERE y <> old_y) AS relabelled, count(*) FILTER (WHERE fold <> old_fold) AS moved, count(*) FILTER (WHERE p = y) AS hits, any_value(balanced_accuracy) AS balanced_accuracy FROM m JOIN o USING (doc_id), b GROUP BY fold, y, band")
def _(spark, d):
    f = staged(features(spark, d))
    e = staged(models.merged_band(f, F.col("lang") == "es", 1, "grp", "src1", "doc_id"))
    p = staged(models.oof_predict(e, FEATS).join(f.select("doc_id", F.col("y").alias("old_y"), F.col("fold").alias("old_fold")), "doc_id"))
    b = rounded_metrics(stats.balanced_accuracy(p)).select("balanced_accuracy")
    n = lambda c: F.count_if(c)
    by = p.groupBy("fold", "y", "band").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("perm_group").alias("n_groups"), n(F.col("y") != F.col("old_y")).alias("relabelled"), n(F.col("fold") != F.col("old_fold")).alias("moved"), n(F.col("p") == F.col("y")).alias("hits"))
    return by.crossJoin(b)


_m = sql_md5_int("source")
METRICS = f"""m AS (SELECT source, avg(quality) AS ba, avg(quality) - 0.2::DOUBLE AS ci_low, {_m} % 100 / 1000.0::DOUBLE AS perm_p, {_m} % 2 = 0 AS rhythm_in_top3, avg(toxic) AS margin, avg(quality) - 0.25::DOUBLE AS resid_ci_low, avg(quality) AS era_ba,
 0.5::DOUBLE AS best_baseline, {_m} % 7 / 100.0::DOUBLE AS resid_p, avg(toxic) - 0.1::DOUBLE AS lift_low, avg(toxic) - 0.05::DOUBLE AS shuffled_low, avg(toxic) AS increment_low, avg(quality) AS ba_judge, avg(toxic) - 0.12::DOUBLE AS inc_low, avg(toxic) - 0.08::DOUBLE AS inc_high,
 avg(toxic) AS lexical_drop, 1.0::DOUBLE + avg(toxic) * 4 AS length_ratio, count(*) * 10 AS n, avg(toxic) - 0.1::DOUBLE AS diff_low FROM labels JOIN documents USING (doc_id) GROUP BY source)"""


def metrics(spark, d):
    """One row of metrics for each source, from its labels."""
    h = T.md5_int(F.col("source"))
    q, t = F.avg("quality"), F.avg("toxic")
    g = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").groupBy("source").agg(q.alias("ba"), t.alias("t"), (F.count(F.lit(1)) * 10).alias("n"))
    b, t = F.col("ba"), F.col("t")
    return g.select("source", "ba", (b - 0.2).alias("ci_low"), (h % 100 / 1000.0).alias("perm_p"), (h % 2 == 0).alias("rhythm_in_top3"), t.alias("margin"), (b - 0.25).alias("resid_ci_low"), b.alias("era_ba"), F.lit(0.5).alias("best_baseline"), (h % 7 / 100.0).alias("resid_p"), (t - 0.1).alias("lift_low"), (t - 0.05).alias("shuffled_low"), t.alias("increment_low"), b.alias("ba_judge"), (t - 0.12).alias("inc_low"), (t - 0.08).alias("inc_high"), t.alias("lexical_drop"), (1.0 + t * 4).alias("length_ratio"), "n", (t - 0.1).alias("diff_low"))


_kill = ["ba <= 0.55 OR ci_low <= 0.5", "perm_p >= 0.05", "resid_ci_low <= 0.5", "best_baseline >= ba"]
_go = ["ba >= 0.65 AND ci_low > 0.5", "perm_p < 0.01", "rhythm_in_top3", "margin >= 0.05", "resid_ci_low > 0.5", "era_ba >= 0.6"]
_count = lambda cs: " + ".join(f"CAST(({x}) AS INT)" for x in cs)


@R.add("u20_first_gate", f"WITH {METRICS} SELECT source, {_count(_go)} AS proceed_met, {_count(_kill)} AS kill_met, CASE WHEN {' OR '.join(f'({x})' for x in _kill)} THEN 'KILL' WHEN {' AND '.join(f'({x})' for x in _go)} THEN 'PROCEED' WHEN ba > 0.55 AND ba < 0.65 THEN 'DANGER' ELSE 'NO-GO' END AS verdict FROM m")
def _(spark, d):
    return gates.first_gate(metrics(spark, d)).select("source", "proceed_met", "kill_met", "verdict")


@R.add("u21_second_gate", f"WITH {METRICS} SELECT source, CASE WHEN resid_ci_low <= 0.5 OR resid_p >= 0.05 OR ba <= 0.55 OR ci_low <= 0.5 OR perm_p >= 0.05 THEN 'KILL' WHEN resid_ci_low > 0.5 AND resid_p < 0.01 AND ba >= 0.65 AND ci_low > 0.5 AND perm_p < 0.01 THEN 'PROCEED' ELSE 'NO-GO' END AS verdict FROM m")
def _(spark, d):
    return gates.second_gate(metrics(spark, d)).select("source", "verdict")


@R.add("u22_order_gate", f"WITH {METRICS} SELECT source, lift_low > 0 AS primary_1, shuffled_low > 0 AS primary_2, resid_p < 0.01 AND increment_low > 0.1 AS primary_3, CASE WHEN lift_low > 0 AND shuffled_low > 0 AND resid_p < 0.01 AND increment_low > 0.1 THEN 'PASS' ELSE 'KILL' END AS verdict FROM m")
def _(spark, d):
    return gates.order_gate(metrics(spark, d), 0.1).select("source", "primary_1", "primary_2", "primary_3", "verdict")


@R.add("u23_judge_status", f"WITH {METRICS}, s AS (SELECT source, CASE WHEN ba_judge < 0.6 THEN 'VOID' WHEN inc_low > 0 THEN 'ADDS' WHEN inc_high < 0.05 THEN 'REDUNDANT' ELSE 'INCONCLUSIVE' END AS status FROM m) SELECT source, status, CASE WHEN status = 'ADDS' AND (SELECT status FROM s WHERE source = 'src0') <> 'ADDS' THEN 'adds quality' WHEN status = 'ADDS' THEN 'confounded' ELSE 'no clean signal' END AS claim FROM s")
def _(spark, d):
    s = gates.judge_status(metrics(spark, d)).select("source", "status")
    control = s.where("source = 'src0'").select(F.col("status").alias("control"))
    return s.crossJoin(control).select("source", "status", gates.quality_claim(F.col("status"), F.col("control")).alias("claim"))


@R.add("u24_robustness", f"WITH {METRICS} SELECT source, lexical_drop > 0.03 AS degraded, length_ratio BETWEEN 0.6 AND 1.6 AS length_ok, n >= 140 AS covered, CASE WHEN NOT (lexical_drop > 0.03 AND length_ratio BETWEEN 0.6 AND 1.6 AND n >= 140) THEN 'INVALID' WHEN diff_low > 0 THEN 'SUPPORTED' ELSE 'NOT-SUPPORTED' END AS verdict FROM m")
def _(spark, d):
    return gates.robustness(metrics(spark, d)).select("source", "degraded", "length_ok", "covered", "verdict")


_e = "e AS (SELECT value AS y, CAST(json_extract(props, '$.k') AS DOUBLE) AS x, user_id AS c FROM events WHERE value IS NOT NULL)"
_ols = f"""WITH {_e}, s AS (SELECT count(*) AS n, avg(x) AS mx, sum(x) AS sx, sum(x * x) AS sxx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(DISTINCT c) AS g FROM e),
 u AS (SELECT c, sum(y - a - b * x) AS u0, sum(x * (y - a - b * x)) AS u1 FROM e, s GROUP BY c),
 m AS (SELECT sum(u0 * u0) AS m00, sum(u0 * u1) AS m01, sum(u1 * u1) AS m11 FROM u),
 i AS (SELECT sxx / d AS i00, -sx / d AS i01, n / d AS i11, b, a, n, g, (g / (g - 1)) * ((n - 1) / (n - 2)) AS k FROM (SELECT *, n * sxx - sx * sx AS d FROM s)),
 v AS (SELECT a, b, n, g, sqrt(k * (i01 * i01 * m00 + 2 * i01 * i11 * m01 + i11 * i11 * m11)) AS se FROM i, m)
 SELECT 'k' AS term, round(b, 8) AS coef, round(se, 8) AS se, round((b / se) ** 2, 5) AS block_chi2, n, g AS clusters FROM v"""


@R.add("u27_ols_cluster", _ols)
def _(spark, d):
    e = table(spark, d, "events").select("value", F.get_json_object("props", "$.k").cast("double").alias("k"), "user_id")
    o = stats.ols_cluster(e, "value", ["k"], ["k"], "user_id").where("term = 'k'")
    return o.select("term", F.round("coef", 8).alias("coef"), F.round("se", 8).alias("se"), F.round("block_chi2", 5).alias("block_chi2"), "n", "clusters")


def reading(spark, d):
    """Events as measures: fixated if above the median value, predictors from the other columns."""
    from prosemill.operators import tables

    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("value").alias("trt"), F.get_json_object("props", "$.k").cast("double").alias("k"), F.length("event_type").cast("double").alias("wlen"))
    z = tables.zscore(e, ["k", "wlen"])
    return z.withColumn("fixated", (F.col("trt") > 5).cast("int")).withColumn("log_trt", F.log(F.greatest("trt", F.lit(1.0))))


_X = ["wlen_z", "k_z"]
READING = """r0 AS (SELECT user_id AS c, value AS trt, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, CAST(length(event_type) AS DOUBLE) AS wlen FROM events),
 rs AS (SELECT avg(k) AS mk, stddev_samp(k) AS sk, avg(wlen) AS mw, stddev_samp(wlen) AS sw FROM r0),
 r AS (SELECT c, trt, CASE WHEN sk > 0 THEN (k - mk) / sk ELSE k * 0 END AS k_z, CASE WHEN sw > 0 THEN (wlen - mw) / sw ELSE wlen * 0 END AS wlen_z, CAST(trt > 5 AS INT) AS fixated, ln(greatest(trt, 1.0::DOUBLE)) AS log_trt FROM r0, rs)"""


def cluster_sql(name: str, y: str, kind: str, where: str = "TRUE", steps: int = 12, xs: list[str] = _X, block: list[str] = ("k_z",)) -> str:
    """CTEs up to <name> (term, coef, se, n, clusters, block_chi2) of a least squares or logit model of y on xs over r, clustered by c."""
    k_ = len(xs) + 1
    d, n = range(k_), f"{name}_"
    z = ", ".join(f"CAST({x} AS DOUBLE) AS z{i}" for i, x in enumerate(xs, 1))
    out = [f"{n}d AS MATERIALIZED (SELECT c, CAST({y} AS DOUBLE) AS y, 1.0::DOUBLE AS z0, {z} FROM r WHERE {where} AND {y} IS NOT NULL AND {' AND '.join(f'{x} IS NOT NULL' for x in xs)} AND c IS NOT NULL)"]
    out.append(f"{n}b0 AS MATERIALIZED (SELECT {', '.join(f'0.0::DOUBLE AS b{i}' for i in d)})")
    weight = "p * (1 - p)" if kind == "logit" else "1"
    of = "1 / (1 + exp(-eta))" if kind == "logit" else "eta"
    with_p = lambda t: f"(SELECT *, {of} AS p FROM (SELECT *, {' + '.join(f'b{i} * z{i}' for i in d)} AS eta FROM {n}d, {n}b{t}))"
    last = steps if kind == "logit" else 1
    olds = ", ".join(f"b{i}" for i in d)
    for t in range(last):
        sums = [f"sum(z{i} * z{j} * {weight}) AS a{i}_{j}" for i in d for j in d if j >= i] + [f"sum((y - p) * z{i}) AS g{i}" for i in d] + [f"any_value(b{i}) AS b{i}" for i in d]
        out.append(f"{n}b{t + 1} AS MATERIALIZED (SELECT {', '.join(f'b{i} + x{i} AS b{i}' for i in d)} FROM ({_solve(olds, k_, f'SELECT {chr(44).join(sums)} FROM {with_p(last and t)}')}))")
    # The bread's columns are solutions for unit vectors, at the weights of the last step but one for the logit, as its errors are taken there.
    at = last - 1 if kind == "logit" else last
    out.append(f"{n}a AS MATERIALIZED (SELECT {', '.join(f'sum(z{i} * z{j} * {weight}) AS a{i}_{j}' for i in d for j in d if j >= i)} FROM {with_p(at)})")
    for k in d:
        unit = ", ".join(f"{1.0 if i == k else 0.0}::DOUBLE AS g{i}" for i in d)
        out.append(f"{n}i{k} AS MATERIALIZED (SELECT {', '.join(f'x{i} AS v{k}_{i}' for i in d)} FROM ({_solve('', k_, f'SELECT *, {unit} FROM {n}a')}))")
    out.append(f"{n}u AS MATERIALIZED (SELECT c, {', '.join(f'sum(z{i} * (y - p)) AS u{i}' for i in d)} FROM {with_p(last)} GROUP BY c)")
    out.append(f"{n}m AS MATERIALIZED (SELECT {', '.join(f'sum(u{i} * u{j}) AS m{i}_{j}' for i in d for j in d)}, count(*) AS g, (SELECT count(*) FROM {n}d) AS n FROM {n}u)")
    scale = f"(g / (g - 1)) * ((n - 1) / (n - {k_}))"
    cov = lambda a, b: f"{scale} * ({' + '.join(f'v{a}_{i} * m{i}_{j} * v{b}_{j}' for i in d for j in d)})"
    from_ = f"{n}b{last}, {', '.join(f'{n}i{k}' for k in d)}, {n}m"
    at_ = [xs.index(b) + 1 for b in block]
    part = ", ".join([f"{cov(p, q)} AS a{i}_{j}" for i, p in enumerate(at_) for j, q in enumerate(at_) if j >= i] + [f"b{p} AS g{i}" for i, p in enumerate(at_)] + [f"b{p} AS w{i}" for i, p in enumerate(at_)])
    keep = ", ".join(f"w{i}" for i in range(len(at_)))
    out.append(f"{n}w AS MATERIALIZED (SELECT {' + '.join(f'w{i} * x{i}' for i in range(len(at_)))} AS block_chi2 FROM ({_solve(keep, len(at_), f'SELECT {part} FROM {from_}')}))")
    rows = " UNION ALL ".join(f"SELECT '{t}' AS term, b{k} AS coef, sqrt({cov(k, k)}) AS se, n, g AS clusters, block_chi2 FROM {from_}, {n}w" for k, t in enumerate(["const", *xs]))
    out.append(f"{name} AS ({rows})")
    return ", ".join(out)


def report_sql(name: str, more: str = "") -> str:
    """The report of one model."""
    return f"SELECT {more}term, round(coef, 6) + 0 AS coef, round(se, 6) AS se, round(block_chi2, 4) AS block_chi2, n, clusters FROM {name}"


def report(df, *more):
    return df.select(*more, "term", (F.round("coef", 6) + 0).alias("coef"), F.round("se", 6).alias("se"), F.round("block_chi2", 4).alias("block_chi2"), "n", "clusters")


@R.add("u28_logit_cluster", f"WITH {READING}, {cluster_sql('l', 'fixated', 'logit')} {report_sql('l')}")
def _(spark, d):
    return report(stats.logit_cluster(reading(spark, d), "fixated", _X, ["k_z"], "user_id"))


_models = {"skip": ("fixated", "logit", "TRUE"), "reading_time": ("log_trt", "ols", "fixated = 1"), "measure": ("trt", "ols", "fixated = 1")}
MODELS = f"{READING}, {', '.join(cluster_sql(k, y, kind, where) for k, (y, kind, where) in _models.items())}"


def reading_models(spark, d):
    r = staged(reading(spark, d))
    skip = stats.logit_cluster(r, "fixated", _X, ["k_z"], "user_id").withColumn("model", F.lit("skip"))
    time = stats.ols_cluster(r.where("fixated = 1"), "log_trt", _X, ["k_z"], "user_id").withColumn("model", F.lit("reading_time"))
    other = stats.ols_cluster(r.where("fixated = 1"), "trt", _X, ["k_z"], "user_id").withColumn("model", F.lit("measure"))
    return skip.unionByName(time).unionByName(other)


@R.add("u29_reading_models", f"WITH {MODELS} " + " UNION ALL ".join(report_sql(k, f"'{k}' AS model, ") for k in _models))
def _(spark, d):
    return report(reading_models(spark, d), "model")


_core = r"regexp_replace(word, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')"
_wp = f"""WITH {SENTENCES_CTE}, x AS (SELECT doc_id, sent, unnest(range(1, len(a) + 1)) AS pos, unnest(a) AS word FROM (SELECT doc_id, sent, regexp_extract_all(sentence, '\\S+') AS a FROM s)),
 y AS (SELECT *, {_core} AS core, pos - 1 AS i, count(*) OVER (PARTITION BY doc_id, sent) AS n FROM x)
 SELECT doc_id, count(*) AS words, CAST(sum(greatest(1, len(regexp_extract_all(lower(core), '[aeiouy]+')))) AS BIGINT) AS nsyl, CAST(sum(CASE WHEN lower(core) NOT IN ({', '.join(map(lit, STOP))}) THEN 1 ELSE 0 END) AS BIGINT) AS content,
 CAST(sum(CASE WHEN regexp_matches(word, '[.,;:!?()—–-]$') OR i = n - 1 THEN 1 ELSE 0 END) AS BIGINT) AS boundaries, round(avg(i / greatest(1, n - 1)), 11) AS word_pos, CAST(sum(CASE WHEN i = n - 1 THEN 1 ELSE 0 END) AS BIGINT) AS finals, CAST(sum(length(core)) AS BIGINT) AS wlen FROM y WHERE core <> '' GROUP BY doc_id"""


@R.add("u30_word_predictors", _wp)
def _(spark, d):
    s = segment.sentences(table(spark, d, "documents"))
    w = s.select("doc_id", "sent", F.posexplode(F.regexp_extract_all("sentence", F.lit(r"\S+"), F.lit(0))).alias("pos", "word"))
    p = stats.word_predictors(w, ["doc_id", "sent"], "word", "pos", STOP)
    total = lambda c, n: F.sum(c).cast("long").alias(n)
    return p.groupBy("doc_id").agg(F.count("word").alias("words"), total("nsyl", "nsyl"), total("is_content", "content"), total("is_boundary", "boundaries"), F.round(F.avg("word_pos"), 11).alias("word_pos"), total("is_sent_final", "finals"), total("wlen", "wlen"))


@R.add("u31_parse_scores", "SELECT event_id, CAST(json_extract(regexp_extract('Scores: ' || props || ' done', '(?s)(\\{.*\\})', 1), '$.k') AS DOUBLE) AS k, coalesce(CAST(json_extract(props, '$.k') AS DOUBLE) BETWEEN 1 AND 100, FALSE) AS ok FROM events")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("Scores: "), "props", F.lit(" done")).alias("raw"))
    return stats.parse_scores(e, "raw", ["k"]).drop("raw")


@R.add("u32_auc", "SELECT round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 9) AS auc, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives FROM (SELECT p, n, sum(n) OVER (ORDER BY s) - n AS below FROM (SELECT n_chars AS s, count(*) FILTER (WHERE quality = 1) AS p, count(*) FILTER (WHERE quality = 0) AS n FROM documents JOIN labels USING (doc_id) GROUP BY n_chars))")
def _(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return stats.auc(j, "n_chars", "quality").withColumn("auc", F.round("auc", 9))


@R.add("u34_embedding_spread", "WITH v AS (SELECT label, vec_id, unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), n AS (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM v GROUP BY vec_id HAVING sum(x * x) > 0), s AS (SELECT label, i, sum(x / norm) AS s, count(*) AS n FROM v JOIN n USING (vec_id) GROUP BY ALL) SELECT label, max(n) AS n, round((sum(s * s) - max(n)) / (max(n) * (max(n) - 1)), 7) AS mean_cosine FROM s GROUP BY label")
def _(spark, d):
    return stats.embedding_spread(table(spark, d, "embeddings"), "label", "embedding").withColumn("mean_cosine", F.round("mean_cosine", 7))

