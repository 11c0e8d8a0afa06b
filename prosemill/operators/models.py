"""Classifiers on standardised features, out-of-fold predictions and contrasts.

The regressions are fits.fit_all: one call fits all sets of columns and folds that a report needs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosemill.functions import text as T
from prosemill.operators import sampling, stats
from prosemill.operators.fits import Fit, Fitted, fit_all
from prosemill.sources import dropped, staged


def fit_logreg(df: DataFrame, cols: list[str], y: str = "y", c: float = 1.0) -> Fitted:
    """Logistic regression of all rows, with an L2 penalty of 1 / (2 C), on standardised features."""
    return fit_all(df, [Fit("all", tuple(cols), y)], c=c)


def predict(model: Fitted, df: DataFrame, name: str = "p") -> DataFrame:
    """The rows without a null feature, with the predicted class."""
    return model.predicted(df, {next(iter(model.fits)): name})


def fit_tree(df: DataFrame, cols: list[str], depth: int = 3, y: str = "y") -> PipelineModel:
    return Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="x"), DecisionTreeClassifier(featuresCol="x", labelCol=y, maxDepth=depth, seed=0)]).fit(df)


def tree_predict(model: PipelineModel, df: DataFrame, name: str = "p") -> DataFrame:
    return model.transform(df).select(*df.columns, F.col("prediction").cast("int").alias(name))


def tree_text(model: PipelineModel, cols: list[str]) -> str:
    """The tree with its features' names."""
    return reduce(lambda s, i: s.replace(f"feature {i} ", f"{cols[i]} "), range(len(cols) - 1, -1, -1), model.stages[-1].toDebugString)


def oof_predict(df: DataFrame, cols: list[str], y: str = "y", fold: str = "fold", name: str = "p", alt: DataFrame | None = None, covs: list[str] = ()) -> DataFrame:
    """Rows of alt, or df, each predicted by the model of the other folds of df; covs are taken out of the columns first, by a fit on those folds too."""
    return fit_all(df, [Fit("oof", tuple(cols), y, tuple(covs))], fold).predicted(alt if alt is not None else df, {"oof": name})


def oof_predict_sets(df: DataFrame, sets: dict[str, list[str]], y: str = "y", fold: str = "fold") -> DataFrame:
    """df with p__<name> for each set of columns, all fitted together."""
    return fit_all(df, [Fit(n, tuple(c), y) for n, c in sets.items()], fold).predicted(df, {n: f"p__{n}" for n in sets})


def paired_oof(orig: DataFrame, alt: DataFrame, cols: list[str], key: str, y: str = "y", fold: str = "fold") -> DataFrame:
    """(key, y, p_orig, p_alt): the same models on the original and the rewritten row of each held-out key."""
    return paired_oof_sets(orig, [alt], {"p": cols}, key, y, fold).withColumnsRenamed({"p__p": "p_orig", "p__p__0": "p_alt"})


def paired_oof_sets(orig: DataFrame, alts: list[DataFrame], sets: dict[str, list[str]], key: str, y: str = "y", fold: str = "fold") -> DataFrame:
    """(key, y, p__<set>, p__<set>__<i>): each set's models, fitted once on the originals, on these and on every rewrite of the held-out keys."""
    models = fit_all(orig, [Fit(n, tuple(c), y) for n, c in sets.items()], fold)
    out = models.predicted(orig, {n: f"p__{n}" for n in sets}).select(key, y, *[f"p__{n}" for n in sets])
    for i, alt in enumerate(alts):
        folded = alt.drop(fold, y).join(orig.select(key, fold, y), key)
        out = out.join(models.predicted(folded, {n: f"p__{n}__{i}" for n in sets}).select(key, *[f"p__{n}__{i}" for n in sets]), key)
    return out


def oof_accuracy(df: DataFrame, cols: list[str], y: str = "y", fold: str = "fold") -> float:
    return stats.balanced_accuracy(oof_predict(df, cols, y, fold), y).first()["balanced_accuracy"]


def oof_recall(df: DataFrame, cols: list[str], label: str, fold: str = "fold") -> float:
    """Mean recall of all labels at once, each row predicted by the multinomial model of the other folds."""
    labels = sorted(r[0] for r in df.where(F.col(label).isNotNull()).select(label).distinct().collect())
    d = staged(df.where(F.col(label).isNotNull()).withColumn("__label", (F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label)) - 1).cast("int")))
    p = fit_all(d, [Fit("all", tuple(cols), "__label", classes=len(labels))], fold).predicted(d, {"all": "__p"})
    out = p.groupBy("__label").agg(F.avg((F.col("__p") == F.col("__label")).cast("double")).alias("r")).agg(F.avg("r")).first()[0]
    dropped(d)
    return out


def residual_contrast(df: DataFrame, feats: list[str], covs: list[str], group: str, y: str = "y", replicates: int = 200, permutations: int = 100) -> dict[str, float]:
    """Accuracy of the features less what the covariates explain of them, with interval and p.

    For each fold the covariates are fitted on the other folds, and so are the
    models; the permutations of the groups' labels refit both.
    """
    p = staged(oof_predict(df, feats, y, covs=covs).select(group, y, "p"))
    ci = stats.group_bootstrap_ci(p, group, replicates, y=y).first()
    perm = stats.group_permutation_test(df, feats, "perm_group", y, covs=covs, replicates=permutations).first() if "perm_group" in df.columns else None
    out = {"ba": stats.balanced_accuracy(p, y).first()["balanced_accuracy"], "ci_low": ci["lo"], "ci_high": ci["hi"], "perm_p": perm["p_value"] if perm else float("nan")}
    dropped(p)
    return out


def contrast(df: DataFrame, sets: dict[str, list[str]], key: str, group: str, y: str = "y", replicates: int = 200, exclude: str | None = None) -> DataFrame:
    """(name, ba, lo, hi, increment, inc_lo, inc_hi): each set of columns, and what all of them gain over it.

    exclude: a pattern of groups to leave out, without regard to case. All sets
    are fitted together and drawn on the same groups.
    """
    d = df.where(~F.col(group).rlike(f"(?i){exclude}")) if exclude else df
    d = staged(d)
    names = [*sets, "all_sets"]
    every = sorted({c for s in sets.values() for c in s})
    # Predictions have names of their own: a set may be named as a column is.
    preds = staged(oof_predict_sets(d, {**sets, "all_sets": every}, y).select(key, group, y, *[f"p__{n}" for n in names]))
    draws = stats.group_bootstrap(preds, group, [f"p__{n}" for n in names], replicates, 0, y)
    gain = lambda n: F.col("p__all_sets") - F.col(f"p__{n}")
    long = draws.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"p__{n}").alias("v"), gain(n).alias("g")) for n in names])).alias("x")).select("x.*")
    q = lambda c, p: F.percentile(c, F.lit(p))
    ci = long.groupBy("name").agg(q("v", 0.025).alias("lo"), q("v", 0.975).alias("hi"), F.avg("g").alias("increment"), q("g", 0.025).alias("inc_lo"), q("g", 0.975).alias("inc_hi"))
    each = preds.select(y, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"p__{n}").alias("p")) for n in names])).alias("x")).select(y, "x.*")
    ba = stats.balanced_accuracy(each, y, "p", by=["name"]).select("name", F.col("balanced_accuracy").alias("ba"))
    return ba.join(ci, "name").select("name", "ba", "lo", "hi", "increment", "inc_lo", "inc_hi")


def pair_labels(df: DataFrame, pairs: dict[str, tuple], label: str) -> DataFrame:
    """df with y__<name> for each pair of classes: 0 for the first, 1 for the second, null for all others."""
    return df.withColumns({f"y__{n}": F.when(F.col(label) == a, 0).when(F.col(label) == b, 1) for n, (a, b) in pairs.items()})


def fit_pairs(df: DataFrame, pairs: dict[str, tuple], label: str, sets: dict[str, list[str]], covs: dict[str, list[str]] | None = None, fold: str | None = "fold") -> Fitted:
    """The models <pair>__<set> of every pair of classes and every set of columns, fitted together. covs: by set, what is taken out of its columns first."""
    return fit_all(pair_labels(df, pairs, label), [Fit(f"{n}__{s}", tuple(c), f"y__{n}", tuple((covs or {}).get(s, ()))) for n in pairs for s, c in sets.items()], fold)


def pair_predictions(df: DataFrame, pairs: dict[str, tuple], label: str, sets: dict[str, list[str]], key: str, group: str, covs: dict[str, list[str]] | None = None, fold: str | None = "fold", on: DataFrame | None = None, made: Fitted | None = None) -> DataFrame:
    """(pair, key, group, y, p__<set>...): predictions of every set for the rows of every pair of classes; all pairs, sets and folds are fitted together.

    covs: by set, what is taken out of its columns first. Without fold the
    models of all rows of df predict the rows of `on`. made: those of
    fit_pairs(), if they are fitted.
    """
    made = made or fit_pairs(df, pairs, label, sets, covs, fold)
    scored = made.scored(pair_labels(df if on is None else on, pairs, label))
    z = lambda n, s: F.col(f"z__{n}__{s}")
    each = [F.struct(F.lit(n).alias("pair"), F.col(f"y__{n}").alias("y"), *[F.when(z(n, s).isNotNull(), (z(n, s) > 0).cast("int")).alias(f"p__{s}") for s in sets]) for n in pairs]
    out = scored.select(key, group, F.explode(F.array(*each)).alias("x")).select("x.pair", key, group, "x.y", *[f"x.p__{s}" for s in sets])
    for s in sets:
        out = out.where(F.col(f"p__{s}").isNotNull())
    return out.where(F.col("y").isNotNull())


def baseline_margin(df: DataFrame, cols: list[str], baselines: list[str], y: str = "y") -> DataFrame:
    """(name, ba, margin): all columns, and each single baseline column; the margin over the best of these."""
    sets = {"all": cols, **{f"one_{b}": [b] for b in baselines}}
    p = oof_predict_sets(df, sets, y)
    each = p.select(y, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"p__{n}").alias("p")) for n in sets])).alias("x")).select(y, "x.*")
    ba = {r["name"]: r["balanced_accuracy"] for r in stats.balanced_accuracy(each, y, "p", by=["name"]).collect()}
    full, found = ba["all"], {b: ba[f"one_{b}"] for b in baselines}
    rows = [("all", full, full - max(found.values())), *[(b, v, full - v) for b, v in sorted(found.items())]]
    return df.sparkSession.createDataFrame(rows, "name string, ba double, margin double")


def score_heldout(df: DataFrame, cols: list[str], split: str = "split", y: str = "y", name: str = "p") -> DataFrame:
    """Held-out rows predicted once by the model of the dev rows."""
    return predict(fit_logreg(df.where(F.col(split) == "dev"), cols, y), df.where(F.col(split) == "held_out"), name)


def relabel(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column) == old, new).otherwise(F.col(column)))


def merged_band(df: DataFrame, band, y_new: int, group: str, spread: str | None, order: str, y: str = "y", parts: int = 5, k: int = 5) -> DataFrame:
    """df with a band's rows merged into a class, regrouped and folded anew: y, group, perm_group, fold and band change.

    The band's rows get the label y_new; those of the group `spread`, which is
    all one source, are dealt to `parts` made-up groups in turn, as one group
    could stand in one fold only.
    """
    d = df.withColumn("band", F.coalesce(band, F.lit(False)))
    whole = d.where("band").withColumn(y, F.lit(y_new).cast(df.schema[y].dataType))
    whole = sampling.spread_groups(whole, group, spread, order, parts) if spread is not None else whole
    rows = d.where("NOT band").unionByName(whole)
    rows = rows.withColumn("perm_group", F.concat_ws("#", group, F.col(y).cast("string"))).drop("fold")
    return sampling.with_folds(rows, "perm_group", y, k)


def permutation_importance(model: Fitted, df: DataFrame, cols: list[str], key: str, y: str = "y", repeats: int = 20, seed: int = 0) -> DataFrame:
    """(feature, importance): mean loss of balanced accuracy when one feature is shuffled. model: one fit of all rows."""
    return permutation_importances(model, df, {next(iter(model.fits)): y}, cols, key, repeats, seed).select("feature", "importance")


def permutation_importances(model: Fitted, df: DataFrame, labels: dict[str, str], cols: list[str], key: str, repeats: int = 20, seed: int = 0) -> DataFrame:
    """(name, feature, importance) of several fits of all rows at once. labels: the column of 0 and 1 of each; its null rows take no part.

    The score is linear, so a shuffled feature moves it by its weight times the
    difference. The shuffle is a join of the rows' ranks under two hashes, each
    ranked in blocks. Only numbers of rows are ranked; a row's columns cross the
    network once for each time that another row takes them.
    """
    names = list(labels)
    weights = [[float(dict(zip(model.cols, model.weights[n, None][0][1:], strict=True))[c]) for c in cols] for n in names]
    x, y = F.array(*[F.col(c).cast("double") for c in cols]), F.array(*[F.col(c).cast("int") for c in labels.values()])
    scored = model.scored(df.select(*{key: 0, **dict.fromkeys(cols), **dict.fromkeys(labels.values())}), names)
    base = staged(scored.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), x.alias("x"), y.alias("y"), F.array(*[f"z__{n}" for n in names]).alias("z")))
    each = base.select("key", "row", F.posexplode("y").alias("m", "of")).where("of IS NOT NULL").drop("of").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    ranked = lambda s, row: _hash_ranks(each, ["m", "r"], "key", s, ["r"]).select("m", "r", "i", F.col("row").alias(row))
    taken = ranked(seed, "row").join(ranked(seed + 1, "other"), ["m", "r", "i"]).drop("i")
    moved = taken.join(base.select(F.col("row").alias("other"), F.col("x").alias("s")), "other").drop("other").join(base.drop("key"), "row")
    told = F.get(F.array(*[F.array(*map(F.lit, w)) for w in weights]), F.col("m"))
    moved = moved.select("m", "r", F.get("y", F.col("m")).alias("y"), F.get("z", F.col("m")).alias("z"), "x", "s", told.alias("w"))
    hit = lambda i: F.col("z") + F.get("w", F.lit(i)) * (F.get("s", F.lit(i)) - F.get("x", F.lit(i))) > 0
    counts = moved.groupBy("m", "r", "y").agg(*[F.count_if(h).alias(f"{p}_{i}") for i in range(len(cols)) for p, h in (("one", hit(i)), ("none", ~hit(i)))])
    counts = counts.select("m", "r", "y", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"none_{i}").alias("n0"), F.col(f"one_{i}").alias("n1")) for i, c in enumerate(cols)])).alias("x")).select("m", "r", "y", "x.*")
    cells = [F.sum(F.when(F.col("y") == a, F.col(f"n{b}")).otherwise(0)).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)]
    ba = counts.groupBy("m", "feature", "r").agg(*cells).select("m", "feature", stats.ba_of().alias("ba"))
    preds = base.select(F.posexplode(F.arrays_zip("y", "z")).alias("m", "x")).select("m", "x.y", (F.col("x.z") > 0).cast("int").alias("p"))
    real = stats.balanced_accuracy(preds, by=["m"]).select("m", F.col("balanced_accuracy").alias("real"))
    name = F.get(F.array(*map(F.lit, names)), F.col("m"))
    return ba.groupBy("m", "feature").agg(F.avg("ba").alias("ba")).join(real, "m").select(name.alias("name"), "feature", (F.col("real") - F.col("ba")).alias("importance"))


def _hash_ranks(df: DataFrame, by: list[str], key: str, seed: int, hashed: list[str] | None = None) -> DataFrame:
    """df with i: the rank of each row of by under a hash of seed, hashed (by unless given) and key.

    Rows are ranked within blocks of the hash's range and moved by the rows of
    the blocks before, 1,024 for each value of by, so no task ranks them all.
    """
    h = df.withColumn("h", T.md5_int(F.lit(seed), *[F.col(c) for c in hashed or by], F.col(key))).withColumn("block", F.floor(F.col("h") / (1 << 22)))
    per = h.groupBy(*by, "block").agg(F.count(F.lit(1)).alias("n"))
    per = per.select(*by, "block", (F.sum("n").over(Window.partitionBy(*by).orderBy("block")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*by, "block").orderBy("h", key))
    return h.withColumn("i", inside).join(per, [*by, "block"]).withColumn("i", F.col("i") + F.col("before")).drop("h", "block", "before")


def with_folds(df: DataFrame, group: str, y: str = "y", k: int = 5) -> DataFrame:
    return sampling.with_folds(df, group, y, k)
