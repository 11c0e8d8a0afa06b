"""Statistics that respect groups: bootstrap, permutation, residuals, regressions with clustered errors.

Data is scanned once into counts or sums for each group, fold or cluster;
replicates work on those. Every draw is a hash of a seed, a replicate and a slot.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.functions import text as T
from prosemill.operators import tables
from prosemill.operators.fits import Fit, confusions, fit_all
from prosemill.sources import dropped, staged

CELLS = ("n00", "n01", "n10", "n11")


def confusion_counts(preds: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Counts of truth and prediction, both 0 or 1, for each value of keys."""
    cell = lambda a, b: F.count_if((F.col(y) == a) & (F.col(p) == b))
    out = [cell(a, b).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)]
    return preds.groupBy(*keys).agg(*out) if keys else preds.agg(*out)


def ba_of(prefix: str = "") -> Column:
    """Balanced accuracy of the four cells; null unless both classes are there."""
    n = {c: F.col(prefix + c) for c in CELLS}
    a, b = n["n00"] + n["n01"], n["n10"] + n["n11"]
    return F.when((a > 0) & (b > 0), (n["n00"] / a + n["n11"] / b) / 2)


def f1_of() -> Column:
    """Macro F1; a class without any case or prediction counts 0."""
    one = lambda tp, fp, fn: F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    n00, n01, n10, n11 = (F.col(c) for c in CELLS)
    return (one(n00, n10, n01) + one(n11, n01, n10)) / 2


def balanced_accuracy(preds: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None) -> DataFrame:
    c = confusion_counts(preds, by or [], y, p)
    return c.select(*(by or []), ba_of().alias("balanced_accuracy"), f1_of().alias("macro_f1"), sum(F.col(x) for x in CELLS).alias("n"))


def row_bootstrap_ci(preds: DataFrame, replicates: int = 2000, seed: int = 0, y: str = "y", p: str = "p") -> DataFrame:
    """(lo, hi, mean, draws): rows are alike within a cell, so a draw is a multinomial over the four cells."""
    counts = [int(x) for x in confusion_counts(preds, [], y, p).first()]
    spark = preds.sparkSession

    def draw(frames):
        for f in frames:
            out = []
            for r in f["id"]:
                n = np.random.default_rng([seed, int(r)]).multinomial(sum(counts), np.array(counts) / max(1, sum(counts)))
                a, b = n[0] + n[1], n[2] + n[3]
                out.append((n[0] / a + n[3] / b) / 2 if a and b else None)
            yield pd.DataFrame({"ba": pd.array(out, dtype="Float64")})

    return interval(spark.range(replicates).mapInPandas(draw, "ba double"), "ba")


def interval(draws: DataFrame, value: str) -> DataFrame:
    q = lambda p: F.percentile(value, F.lit(p))
    return draws.where(F.col(value).isNotNull()).agg(q(0.025).alias("lo"), q(0.975).alias("hi"), F.avg(value).alias("mean"), F.count(value).alias("draws"))


def drawn_groups(counts: DataFrame, group: str, replicates: int, seed: int) -> DataFrame:
    """counts once for each time that a replicate draws its group: as many draws as groups, with replacement.

    counts has one row for each group; only these few columns are repeated.
    """
    n = counts.count()
    numbered = tables.numbered(counts, [], [group], "__i").withColumn("__i", F.col("__i") - 1)
    slots = counts.sparkSession.range(replicates * n).select(F.floor(F.col("id") / n).alias("replicate"), F.pmod("id", F.lit(n)).alias("slot"))
    picks = slots.select("replicate", F.pmod(T.md5_int(F.lit(seed), F.col("replicate"), F.col("slot")), F.lit(n)).alias("__i"))
    return picks.join(numbered, "__i").drop("__i")


def group_bootstrap(preds: DataFrame, group: str, columns: list[str], replicates: int, seed: int, y: str = "y") -> DataFrame:
    """(replicate, <column>...): balanced accuracy of each prediction column on the same draws of whole groups."""
    columns = list(dict.fromkeys(columns))
    cells = [F.count_if((F.col(y) == a) & (F.col(c) == b)).alias(f"{c}__n{a}{b}") for c in columns for a in (0, 1) for b in (0, 1)]
    counts = preds.groupBy(group).agg(*cells)
    summed = drawn_groups(counts, group, replicates, seed).groupBy("replicate").agg(*[F.sum(f"{c}__{x}").alias(f"{c}__{x}") for c in columns for x in CELLS])
    return summed.select("replicate", *[ba_of(f"{c}__").alias(c) for c in columns])


def group_bootstrap_by(preds: DataFrame, by: str, group: str, columns: list[str], replicates: int, seed: int, y: str = "y") -> DataFrame:
    """(by, replicate, <column>...): group_bootstrap() of the rows of each value of by, all in one job. There are few values."""
    columns = list(dict.fromkeys(columns))
    cells = [F.count_if((F.col(y) == a) & (F.col(c) == b)).alias(f"{c}__n{a}{b}") for c in columns for a in (0, 1) for b in (0, 1)]
    counts = tables.numbered(preds.groupBy(by, group).agg(*cells), [by], [group], "__i").withColumn("__i", F.col("__i") - 1)
    sizes = counts.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(by).collect()
    slots = [preds.sparkSession.range(replicates * r["n"]).select(F.lit(r[by]).alias(by), F.floor(F.col("id") / r["n"]).alias("replicate"), F.pmod("id", F.lit(r["n"])).alias("slot"), F.lit(r["n"]).alias("__n")) for r in sizes]
    if not slots:
        return counts.select(by, F.lit(0).cast("long").alias("replicate"), *[F.lit(None).cast("double").alias(c) for c in columns])
    picks = reduce(DataFrame.unionByName, slots).select(by, "replicate", F.pmod(T.md5_int(F.lit(seed), F.col("replicate"), F.col("slot")), F.col("__n")).alias("__i"))
    summed = picks.join(counts, [by, "__i"]).groupBy(by, "replicate").agg(*[F.sum(f"{c}__{x}").alias(f"{c}__{x}") for c in columns for x in CELLS])
    return summed.select(by, "replicate", *[ba_of(f"{c}__").alias(c) for c in columns])


def group_bootstrap_ci(preds: DataFrame, group: str, replicates: int = 2000, seed: int = 0, y: str = "y", p: str = "p") -> DataFrame:
    return interval(group_bootstrap(preds, group, [p], replicates, seed, y), p)


def poisson_bootstrap_ci(preds: DataFrame, group: str, replicates: int = 200, seed: int = 0, y: str = "y", p: str = "p") -> DataFrame:
    """The same for very many groups: a group's weight in a draw is Poisson of mean 1, so draws are summed where the groups are."""
    counts = confusion_counts(preds, [group], y, p)
    u = T.md5_int(F.lit(seed), F.col("replicate"), F.col(group)) / float(1 << 32)
    at, total, weight = math.exp(-1), 0.0, F.lit(0)
    for k in range(10):
        total += at
        weight, at = weight + (u >= total).cast("int"), at / (k + 1)
    each = counts.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("w", weight)
    summed = each.groupBy("replicate").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in CELLS])
    return interval(summed.select(ba_of().alias("ba")), "ba")


def group_bootstrap_increment(preds: DataFrame, group: str, a: str, b: str, replicates: int = 2000, seed: int = 0, y: str = "y") -> DataFrame:
    """Interval of the gain of prediction b over a on the same draws."""
    d = group_bootstrap(preds, group, [a, b], replicates, seed, y)
    return interval(d.select((F.col(b) - F.col(a)).alias("increment")), "increment")


def bootstrap_diff_in_drops(preds: DataFrame, group: str, first: tuple[str, str], second: tuple[str, str], replicates: int = 2000, seed: int = 0, y: str = "y") -> DataFrame:
    """Interval of (drop of the second detector) - (drop of the first), each (original, rewritten)."""
    d = group_bootstrap(preds, group, [*first, *second], replicates, seed, y)
    drop = lambda x: F.col(x[0]) - F.col(x[1])
    return interval(d.select((drop(second) - drop(first)).alias("difference")), "difference")


def bootstrap_diff_over_realizations(preds: DataFrame, group: str, first: tuple[str, list[str]], second: tuple[str, list[str]], replicates: int = 2000, seed: int = 0, y: str = "y") -> DataFrame:
    """The same with the rewritten accuracy averaged over realizations within each draw."""
    d = group_bootstrap(preds, group, [first[0], *first[1], second[0], *second[1]], replicates, seed, y)
    drop = lambda x: F.col(x[0]) - sum(F.col(c) for c in x[1]) / len(x[1])
    return interval(d.select((drop(second) - drop(first)).alias("difference")), "difference")


def permuted_labels(groups: DataFrame, group: str, y: str, replicates: int, seed: int) -> DataFrame:
    """groups with labels array<int>: the label of each, and its label in every permutation. groups: one row for each; y: 0 or 1.

    A permutation gives label 1 to as many groups as have it, those of the
    least hashes. The last of these is found by counts of blocks of the hashes'
    range, so only one block is ordered; from then on a label is a comparison
    within the group's own row.
    """
    spark = groups.sparkSession
    ones = groups.agg(F.count_if(F.col(y) == 1)).first()[0]
    hashed = lambda r: T.md5_int(F.lit(seed), r, F.col(group))
    each = groups.select(group, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")).withColumn("h", hashed(F.col("replicate"))).withColumn("block", F.shiftright("h", 20))
    per = each.groupBy("replicate", "block").agg(F.count(F.lit(1)).alias("n"))  # 4,096 blocks of each
    before = F.sum("n").over(Window.partitionBy("replicate").orderBy("block")) - F.col("n")
    edge = per.withColumn("before", before).where((F.col("before") < ones) & (F.col("before") + F.col("n") >= ones)).select("replicate", "block", "before")
    at = F.row_number().over(Window.partitionBy("replicate").orderBy("h", group))
    last = each.join(F.broadcast(edge), ["replicate", "block"]).withColumn("i", at).where(F.col("i") == ones - F.col("before"))
    bounds = [(r["replicate"], r["h"], r["g"]) for r in last.select("replicate", "h", F.col(group).alias("g")).orderBy("replicate").collect()]
    if not bounds:
        return groups.withColumn("labels", F.array_repeat(F.lit(0), replicates + 1))
    kind = groups.schema[group].dataType.simpleString()
    one = spark.createDataFrame([(bounds,)], f"__bounds array<struct<r:int,h:bigint,g:{kind}>>")
    drawn = F.transform("__bounds", lambda b: (F.struct(hashed(b["r"]).alias("h"), F.col(group).alias("g")) <= F.struct(b["h"].alias("h"), b["g"].alias("g"))).cast("int"))
    return groups.crossJoin(F.broadcast(one)).withColumn("labels", F.concat(F.array(F.col(y).cast("int")), drawn)).drop("__bounds")


def threshold_permutation_test(preds: DataFrame, group: str, replicates: int = 1000, seed: int = 0, y: str = "y", p: str = "p") -> DataFrame:
    """(ba, p_value, draws) of fixed predictions when the labels of whole groups are permuted; a group's label is its least."""
    counts = preds.groupBy(group).agg(F.min(y).alias("y"), F.count_if(F.col(p) == 1).alias("n1"), F.count_if(F.col(p) == 0).alias("n0"))
    each = permuted_labels(counts, group, "y", replicates, seed).select("n0", "n1", F.posexplode("labels").alias("replicate", "label"))
    part = lambda v, n: F.sum(F.when(F.col("label") == v, F.col(n)).otherwise(0))
    ba = each.groupBy("replicate").agg(part(0, "n0").alias("n00"), part(0, "n1").alias("n01"), part(1, "n0").alias("n10"), part(1, "n1").alias("n11")).select("replicate", ba_of().alias("d"))
    draws, real = ba.where("replicate > 0 AND d IS NOT NULL"), ba.where("replicate = 0").select(F.col("d").alias("ba"))
    ge = F.count_if(F.col("d") >= F.col("ba") - 1e-12)
    return draws.crossJoin(real).groupBy("ba").agg(((ge + 1) / (F.count("d") + 1)).alias("p_value"), F.count("d").alias("draws"))


def group_permutation_test(df: DataFrame, cols: list[str], group: str, y: str, fold: str = "fold", replicates: int = 1000, seed: int = 0, covs: list[str] = ()) -> DataFrame:
    """(ba, p_value, draws): mean accuracy over the folds of a logistic regression, fitted anew under every permutation of the groups' labels.

    A group's label is its least. All replicates and folds are fitted together,
    a scan of the rows for each of Newton's steps, and one more counts what
    they get right. The accuracy of a fold with rows of one class is the recall
    of that; a replicate without both classes in some fold's other rows isn't
    counted. Folds stay as they are. covs are taken out of the columns first, by
    fits on the same rows as the models.
    """
    labels = permuted_labels(df.groupBy(group).agg(F.min(y).alias("__y")), group, "__y", replicates, seed).select(group, F.col("labels").alias("__labels"))
    fitted = fit_all(df.join(labels, group), [Fit("all", tuple(cols), "__labels", tuple(covs))], fold, keep=True)
    n = confusions(fitted, "all")
    dropped(fitted.rows)
    a, b = n[:, :, 0] + n[:, :, 1], n[:, :, 2] + n[:, :, 3]
    with np.errstate(divide="ignore", invalid="ignore"):
        recalls = np.stack([np.where(a > 0, n[:, :, 0] / a, np.nan), np.where(b > 0, n[:, :, 3] / b, np.nan)])
    there = ~np.isnan(recalls)
    of_fold = np.where(there, recalls, 0).sum(axis=0) / np.maximum(1, there.sum(axis=0))
    ba = of_fold.mean(axis=1)
    ba[np.isnan(n).any(axis=(1, 2))] = np.nan
    draws = ba[1:][~np.isnan(ba[1:])]
    p = (int((draws >= ba[0] - 1e-12).sum()) + 1) / (len(draws) + 1)
    return df.sparkSession.createDataFrame([(float(ba[0]), float(p), len(draws))], "ba double, p_value double, draws long")


def residualize(df: DataFrame, feats: list[str], covs: list[str], fold: str = "fold") -> DataFrame:
    """df with each feature less its least-squares fit on the covariates, fitted on the other folds.

    One scan sums products by fold; a fold's training sums are the total less its own.
    """
    z = [F.lit(1.0), *[F.col(c).cast("double") for c in covs]]
    k = len(z)
    sums = [F.sum(z[i] * z[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(k)] + [F.sum(z[i] * F.col(f)).alias(f"b{i}_{f}") for i in range(k) for f in feats]
    by = df.groupBy(fold).agg(*sums).toPandas().set_index(fold)
    total = by.sum()
    out = {f: F.lit(None).cast("double") for f in feats}
    for v, own in by.iterrows():
        left = total - own
        a = np.array([[left[f"a{i}_{j}"] for j in range(k)] for i in range(k)])
        for f in feats:
            beta = np.linalg.lstsq(a, np.array([left[f"b{i}_{f}"] for i in range(k)]), rcond=None)[0]
            fit = sum((F.lit(float(beta[i])) * z[i] for i in range(1, k)), F.lit(float(beta[0])))
            out[f] = F.when(F.col(fold) == F.lit(v), F.col(f) - fit).otherwise(out[f])
    return df.withColumns(out)


def _sums(df: DataFrame, exprs: dict[str, Column]) -> pd.Series:
    return pd.Series(df.agg(*[F.sum(e).alias(n) for n, e in exprs.items()]).first().asDict(), dtype=float)


def chi2_tail(x: float, k: int) -> float:
    """P(chi-square with k degrees of freedom > x), by the recurrence over k."""
    if x <= 0:
        return 1.0
    if k % 2:
        out, term, start = math.erfc(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2), 1
    else:
        out, term, start = math.exp(-x / 2), x / 2 * math.exp(-x / 2), 2
    for m in range(start, k, 2):
        out, term = out + term, term * x / (m + 2)
    return out


def _sandwich(df: DataFrame, xs: list[Column], resid: Column, bread: np.ndarray, cluster: str) -> tuple[np.ndarray, int]:
    k = len(xs)
    rows = df.select(cluster, *[x.alias(f"x{i}") for i, x in enumerate(xs)], resid.alias("r"))
    per = rows.groupBy(cluster).agg(*[F.sum(F.col(f"x{i}") * F.col("r")).alias(f"s{i}") for i in range(k)])
    s = _sums(per, {f"m{i}_{j}": F.col(f"s{i}") * F.col(f"s{j}") for i in range(k) for j in range(i, k)} | {"g": F.lit(1)})
    meat = np.array([[s[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    return bread @ meat @ bread, int(s["g"])


def _report(spark, names, beta, v, block, n, groups):
    at = [names.index(b) for b in block]
    wald = float(beta[at] @ np.linalg.solve(v[np.ix_(at, at)], beta[at]))
    se = np.sqrt(np.diag(v))
    rows = [(c, float(b), float(e), chi2_tail(float((b / e) ** 2), 1) if e else 1.0, wald, chi2_tail(wald, len(at)), n, groups) for c, b, e in zip(names, beta, se, strict=True)]
    return spark.createDataFrame(rows, "term string, coef double, se double, p_value double, block_chi2 double, block_p double, n long, clusters long")


def _alike(d: DataFrame, y: str, x: list[str], repeated: bool) -> DataFrame:
    """d as columns x0 to xk, n and y, sums of rows: those that agree in x are one row if many do, and then it is a table of its own."""
    xs = [F.lit(1.0).alias("x0"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(x, 1)]]
    rows = d.select(*xs, F.lit(1).cast("long").alias("n"), F.col(y).cast("double").alias("y"))
    if not repeated:
        return rows
    return staged(rows.groupBy(*[f"x{i}" for i in range(len(xs))]).agg(F.sum("n").alias("n"), F.sum("y").alias("y")))


def ols_cluster(df: DataFrame, y: str, x: list[str], block: list[str], cluster: str, repeated: bool = False) -> DataFrame:
    """(term, coef, se, p_value, block_chi2, block_p, n, clusters): least squares with errors clustered, and a Wald test of the block.

    Two scans: sums of products, then score sums by cluster. repeated: many rows
    agree in x, and are one in the sums of products.
    """
    d = df.dropna(subset=[y, *x, cluster])
    xs = [F.lit(1.0), *[F.col(c).cast("double") for c in x]]
    k, z = len(xs), [F.col(f"x{i}") for i in range(len(xs))]
    s = _sums(_alike(d, y, x, repeated), {f"a{i}_{j}": z[i] * z[j] * F.col("n") for i in range(k) for j in range(i, k)} | {f"b{i}": z[i] * F.col("y") for i in range(k)})
    a = np.array([[s[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    beta = np.linalg.solve(a, np.array([s[f"b{i}"] for i in range(k)]))
    resid = F.col(y) - sum((F.lit(float(b)) * c for b, c in zip(beta, xs, strict=True)), F.lit(0.0))
    v, g = _sandwich(d, xs, resid, np.linalg.inv(a), cluster)
    n = int(a[0, 0])
    return _report(df.sparkSession, ["const", *x], beta, v * (g / (g - 1)) * ((n - 1) / (n - k)), block, n, g)


def logit_cluster(df: DataFrame, y: str, x: list[str], block: list[str], cluster: str, rounds: int = 25, repeated: bool = False) -> DataFrame:
    """The same for a logit, by Newton steps of one aggregate each."""
    d = df.dropna(subset=[y, *x, cluster])
    xs = [F.lit(1.0), *[F.col(c).cast("double") for c in x]]
    k, z = len(xs), [F.col(f"x{i}") for i in range(len(xs))]
    rows, beta = _alike(d, y, x, repeated), np.zeros(len(xs))
    for _ in range(rounds):
        eta = sum((F.lit(float(b)) * c for b, c in zip(beta, z, strict=True)), F.lit(0.0))
        p = F.col("p")
        w = p * (1 - p) * F.col("n")
        at = rows.withColumn("p", 1 / (1 + F.exp(-eta)))
        s = _sums(at, {f"a{i}_{j}": z[i] * z[j] * w for i in range(k) for j in range(i, k)} | {f"b{i}": z[i] * (F.col("y") - F.col("n") * p) for i in range(k)} | {"n": F.col("n")})
        a = np.array([[s[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        step = np.linalg.lstsq(a, np.array([s[f"b{i}"] for i in range(k)]), rcond=None)[0]
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    eta = sum((F.lit(float(b)) * c for b, c in zip(beta, xs, strict=True)), F.lit(0.0))
    v, g = _sandwich(d, xs, F.col(y) - 1 / (1 + F.exp(-eta)), np.linalg.inv(a), cluster)
    n = int(s["n"])
    return _report(df.sparkSession, ["const", *x], beta, v * (g / (g - 1)) * ((n - 1) / (n - k)), block, n, g)


#: Columns of word_alone().
ALONE = ("nsyl", "is_content", "marked", "wlen")


def word_alone(word: Column, stop: list[str]) -> list[Column]:
    """The predictors that hang on the word alone: syllables, whether it has content, whether a mark follows it, and length; 0 without a letter or digit."""
    core = F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return [T.syllables(core).alias("nsyl"), (~F.lower(core).isin(stop)).cast("int").alias("is_content"), word.rlike(r"[.,;:!?()—–-]$").alias("marked"), F.length(core).alias("wlen")]


def word_predictors(words: DataFrame, key: list[str], word: str, pos: str, stop: list[str]) -> DataFrame:
    """words with syllables, content and boundary flags, length, relative position and whether it ends its sentence.

    Words without a letter or digit are dropped.
    """
    w = Window.partitionBy(*key)
    i, n = F.row_number().over(w.orderBy(pos)) - 1, F.count(F.lit(1)).over(w)
    t = words.withColumn("i", i).withColumn("n", n).select("*", *word_alone(F.col(word), stop)).where("wlen > 0")
    last = F.col("i") == F.col("n") - 1
    return t.select(
        *key, pos, word, "nsyl", "is_content",
        (F.col("marked") | last).cast("int").alias("is_boundary"),
        "wlen",
        (F.col("i") / F.greatest(F.lit(1), F.col("n") - 1)).alias("word_pos"),
        last.cast("int").alias("is_sent_final"),
    )


def auc(df: DataFrame, score: str, y: str, buckets: int = 1024) -> DataFrame:
    """Area under the ROC curve, ties counting half.

    Equal scores are one row. The scores are cut into ranges whose counts give
    each range's offset, so that no task orders all of them.
    """
    by = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("n"))
    ends = by.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    cut = by.crossJoin(ends).withColumn("b", F.when(F.col("hi") > F.col("lo"), F.floor((F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (buckets - 1))).otherwise(F.lit(0)))
    sums = cut.groupBy("b").agg(F.sum("n").alias("bn"))
    before = sums.select("b", (F.sum("bn").over(Window.orderBy("b")) - F.col("bn")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("b").orderBy("s")) - F.col("n")
    each = cut.withColumn("below", inside).join(before, "b")
    wins = F.sum(F.col("p") * (F.col("below") + F.col("before") + F.col("n") / 2))
    return each.agg((wins / (F.sum("p") * F.sum("n"))).alias("auc"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))


def embedding_spread(df: DataFrame, group: str, vec: str) -> DataFrame:
    """(group, n, mean_cosine): mean cosine of all pairs, from the sum of the unit vectors alone."""
    v = F.col(vec).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    long = df.select(group, norm.alias("norm"), F.posexplode(v).alias("i", "x")).where("norm > 0")
    sums = long.groupBy(group, "i").agg(F.sum(F.col("x") / F.col("norm")).alias("s"), F.count("x").alias("n"))
    total = sums.groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("t"), F.max("n").alias("n"))
    return total.select(group, "n", F.when(F.col("n") > 1, (F.col("t") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("mean_cosine"))


def parse_scores(df: DataFrame, raw: str, dims: list[str], lo: float = 1, hi: float = 100) -> DataFrame:
    """df with the numbers of the JSON object within a free text, and ok: all there and within the range."""
    body = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    got = df.withColumn("__j", F.from_json(body, ", ".join(f"`{d}` double" for d in dims)))
    ok = [F.coalesce(F.col(f"__j.{d}").between(lo, hi), F.lit(False)) for d in dims]
    out = got.select(*df.columns, *[F.col(f"__j.{d}").alias(d) for d in dims], F.array_min(F.array(*ok)).alias("ok"))
    return out


def judge_means(draws: DataFrame, key: str, dims: list[str]) -> DataFrame:
    """(key, k, <dim> means, <first>_std): of several draws for each key, with the population deviation of the first."""
    return draws.groupBy(key).agg(F.count(F.lit(1)).alias("k"), *[F.avg(d).alias(d) for d in dims], F.stddev_pop(dims[0]).alias(f"{dims[0]}_std"))
