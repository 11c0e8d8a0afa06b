"""Whole jobs: piles of passages from raw documents, and evaluations, as compositions of the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.functions import text as T
from prosemill.operators import gates, models, sampling, segment, stats, tables
from prosemill.sources import dropped, last_turn, staged

#: Fixed value: the 0.01 point of chi-square with two degrees of freedom.
CHI2_01 = 9.21034037197618


def pile(chunks: DataFrame, label: str, source: str, n: int = 80, cap: int = 10, bins: int = 5, seed: int = 0) -> DataFrame:
    """A length-balanced sample of chunks, numbered: (passage_id, doc_id, chunk, words, bin)."""
    x = chunks.withColumn("key", F.concat_ws(":", "doc_id", "chunk")).withColumn("class", F.lit(label)).withColumn("bin", sampling.length_bin(F.col("words"), 150, 400, bins))
    s = sampling.stratified_sample(x, n, cap, bins, seed, "key", "class", source, "bin")
    return sampling.number_passages(s, "class", "key", F.col("class")).select("passage_id", "doc_id", "chunk", "words", "bin")


def _cleaned(docs: DataFrame, clean: Column) -> DataFrame:
    return docs.withColumn("text", clean)


def books(docs: DataFrame) -> DataFrame:
    """Long texts, cut and cleaned as books, up to 60 chunks of each."""
    c = _cleaned(docs, T.clean_book(F.col("text"), r"\n")).where(T.word_count(F.col("text")) >= 1000)
    return pile(segment.chunk_sentences(c).where("chunk < 60"), "book", "doc_id")


def forum(docs: DataFrame) -> DataFrame:
    """Stories, up to three chunks of each."""
    c = _cleaned(docs, T.clean_forum(T.detokenize(F.col("text"))))
    return pile(segment.chunk_sentences(c).where("chunk < 3"), "forum", "doc_id")


def newswire(docs: DataFrame, category: str = "source") -> DataFrame:
    """Reports without their headline, up to 25 chunks of each category."""
    c = _cleaned(docs, T.drop_headline(F.col("text")))
    chunks = segment.chunk_sentences(c).join(docs.select("doc_id", category), "doc_id")
    return pile(sampling.top_per_group(chunks, category, ["doc_id", "chunk"], 25), "news", category)


def worst(docs: DataFrame, group: str = "source", score: str = "n_chars") -> DataFrame:
    """The first chunk of the lowest quarter of each group, worst first, up to 25. A null text counts in the quarter; null is a group."""
    d = sampling.dedup_exact(docs.where("lang = 'en'"))
    tail = sampling.tail_of_groups(d, group, score, 0.25)
    first = segment.chunk_sentences(tail).where("chunk = 0").join(tail.select("doc_id", group, score), "doc_id")
    return pile(sampling.top_per_group(first, group, [score, "doc_id"], 25), "worst", group)


def era(docs: DataFrame) -> DataFrame:
    """One chunk of each text."""
    c = _cleaned(docs, T.detokenize(F.col("text")))
    return pile(segment.chunk_sentences(c).where("chunk = 0"), "era", "doc_id", cap=60)


def assistant(turns: DataFrame) -> DataFrame:
    """One chunk of the last answer of each conversation."""
    last = last_turn(turns, "conv_id", "turn", "role", ("assistant", "gpt")).select(F.col("conv_id").alias("doc_id"), T.normalize_typography(F.col("text")).alias("text"))
    c = segment.chunk_sentences(last, lo=60, hi=400, cap=400).where("chunk = 0")
    return sampling.number_passages(c.withColumn("class", F.lit("assistant")), "class", "doc_id", F.col("class")).select("passage_id", "doc_id", "words")


# --- evaluations; df has doc_id, grp, perm_group, y, fold and the feature columns


def essays(docs: DataFrame, features, sets: dict[str, list[str]]) -> DataFrame:
    """Essays cut and cleaned, and how well each set tells each of the largest sources from the rest: (source, name, ba, lo, hi, ..., margin, perm_p, mean_words).

    docs: doc_id, text and grp. margin is that of all columns over length alone, perm_p that of all columns.
    """
    chunks = segment.chunk_sentences(_cleaned(docs, T.clean_essay(F.col("text"))), lo=220, hi=320, cap=None, span=100)
    cut = chunks.withColumn("essay", F.col("doc_id")).withColumn("doc_id", F.col("doc_id") * 10_000 + F.col("chunk"))
    rows = features(cut.join(docs.select(F.col("doc_id").alias("essay"), "grp"), "essay").select("doc_id", "text", "grp", F.col("words").cast("double").alias("words")))
    largest = [r["grp"] for r in rows.groupBy("grp").count().orderBy(F.desc("count"), "grp").limit(4).collect()]
    out = None
    for source in largest:
        d = rows.withColumn("y", (F.col("grp") == source).cast("int"))
        # One source is one group, so its essays are dealt to groups of their own.
        d = staged(models.with_folds(d.withColumn("part", F.concat_ws("#", "grp", (T.md5_int(F.col("doc_id")) % 10).cast("string"))), "part"))
        margin = models.baseline_margin(d, sorted({c for s in sets.values() for c in s}), ["words"]).where("name = 'all'").select("margin")
        c = models.contrast(d, sets, "doc_id", "part", replicates=100).crossJoin(margin).crossJoin(d.where("y = 1").agg(F.avg("words").alias("mean_words")))
        p = stats.group_permutation_test(d, sorted({c for s in sets.values() for c in s}), "part", "y", replicates=100).select(F.col("p_value").alias("perm_p"))
        c = c.crossJoin(p).withColumn("source", F.lit(source))
        out = c if out is None else out.unionByName(c)
    return out


def phase_one(df: DataFrame, sets: dict[str, list[str]], rhythm: list[str], lexical: list[str], pattern: str) -> DataFrame:
    """Contrast of the sets with and without some groups, the residual contrast, and the verdict."""
    both = models.contrast(df, sets, "doc_id", "grp").withColumn("groups", F.lit("all"))
    some = models.contrast(df, sets, "doc_id", "grp", exclude=pattern).withColumn("groups", F.lit("some"))
    r = models.residual_contrast(df, rhythm, lexical, "grp")
    plain = stats.group_permutation_test(df, sorted({c for s in sets.values() for c in s}), "perm_group", "y", replicates=100).first()
    best = both.where("name = 'all_sets'").select("ba", F.col("lo").alias("ci_low"))
    verdict = gates.second_gate(best.select("*", F.lit(plain["p_value"]).alias("perm_p"), F.lit(r["ci_low"]).alias("resid_ci_low"), F.lit(r["perm_p"]).alias("resid_p"))).select("verdict")
    return both.unionByName(some).crossJoin(verdict)


def phase_zero(df: DataFrame, cols: list[str], baselines: list[str], groups: dict[str, str], label: str, era: DataFrame) -> DataFrame:
    """One row: accuracy with interval and p, margin over single columns, residual, all labels at once, the re-run with a band merged in, a tree, the top feature groups, the verdict.

    era: the rows of the re-run, with a further band relabelled into a class.
    """
    p = models.oof_predict(df, cols)
    ba = stats.balanced_accuracy(p).first()
    ci = stats.row_bootstrap_ci(p, 500).first()
    perm = stats.group_permutation_test(df, cols, "perm_group", "y", replicates=100).first()
    margin = models.baseline_margin(df, cols, baselines)
    m = margin.where("name = 'all'").first()
    rest = [c for c in cols if c not in baselines]
    resid = models.residual_contrast(df, rest, baselines, "grp")
    imp = models.permutation_importance(models.fit_logreg(df, cols), df, cols, "doc_id", repeats=5)
    lookup = df.sparkSession.createDataFrame(sorted(groups.items()), "feature string, feature_group string")
    top = [r["feature_group"] for r in imp.join(lookup, "feature").groupBy("feature_group").agg(F.round(F.sum("importance"), 12).alias("i")).orderBy(F.desc("i"), "feature_group").limit(3).collect()]
    every = models.oof_recall(df, cols, label)
    again = models.oof_accuracy(era, cols)
    tree = models.tree_text(models.fit_tree(df, cols), cols)
    row = (ba["balanced_accuracy"], ci["lo"], perm["p_value"], "rhythm" in top, m["margin"], m["ba"] - m["margin"], resid["ci_low"], again, every, tree, ",".join(top))
    t = df.sparkSession.createDataFrame([row], "ba double, ci_low double, perm_p double, rhythm_in_top3 boolean, margin double, best_baseline double, resid_ci_low double, era_ba double, all_labels_ba double, tree string, top_groups string")
    return gates.first_gate(t)


def _intervals(preds: DataFrame, group: str, names: list[str], full: str, replicates: int) -> DataFrame:
    """(name, ba, lo, hi, increment, inc_lo, inc_hi) of predictions p__<name>, and the gain of p__<full> over each, on the same draws of groups."""
    draws = stats.group_bootstrap(preds, group, [f"p__{n}" for n in names], replicates, 0)
    q = lambda c, p: F.percentile(c, F.lit(p))
    long = draws.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"p__{n}").alias("v"), (F.col(f"p__{full}") - F.col(f"p__{n}")).alias("g")) for n in names])).alias("x")).select("x.*")
    ci = long.groupBy("name").agg(q("v", 0.025).alias("lo"), q("v", 0.975).alias("hi"), F.avg("g").alias("increment"), q("g", 0.025).alias("inc_lo"), q("g", 0.975).alias("inc_hi"))
    each = preds.select("y", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"p__{n}").alias("p")) for n in names])).alias("x")).select("y", "x.*")
    ba = stats.balanced_accuracy(each, "y", "p", by=["name"]).select("name", F.col("balanced_accuracy").alias("ba"))
    return ba.join(ci, "name").select("name", "ba", "lo", "hi", "increment", "inc_lo", "inc_hi")


def four_way(df: DataFrame, sets: dict[str, list[str]], label: str, pairs: list[tuple[str, str]], replicates: int = 100) -> DataFrame:
    """The sets, and all of them together, compared on each pair of labels; all are fitted together."""
    every = {**sets, "all_sets": sorted({c for s in sets.values() for c in s})}
    named = {f"{a}_{b}": (a, b) for a, b in pairs}
    preds = staged(models.pair_predictions(df, named, label, every, "doc_id", "grp"))
    rows = [_intervals(preds.where(F.col("pair") == n), "grp", list(every), "all_sets", replicates).withColumn("pair", F.lit(n)) for n in named]
    return reduce(DataFrame.unionByName, rows)


def beyond_judge(df: DataFrame, scores: DataFrame, judge: list[str], feats: list[str], label: str, contrasts: dict[str, tuple], split: str = "split", replicates: int = 200, permutations: int = 50) -> DataFrame:
    """What features add to a judge's scores on each pair of labels, and what follows.

    One row for each contrast and part, dev and held_out: (contrast, part, n,
    groups_a, groups_b, ba_judge, ba_features, ba_both, increment, inc_low,
    inc_high, resid_ba, resid_p, status, claim, reported). The first contrast is
    the primary, the last the control; the claim rests on dev rows only.
    Held-out rows are all scored, in folds of their own groups, as they may be
    one of df's folds. reported is true for dev, and for held_out only of the
    primary if that adds on dev: a reader who keeps the others unseen leaves
    them out. scores: doc_id and the judge's columns; a row of df without its
    scores is an error.
    """
    spark = df.sparkSession
    d = staged(tables.guarded(df.join(scores, "doc_id", "left"), {f"no score in {c}": F.col(c).isNull() for c in judge}, "doc_id"))

    def run(rows: DataFrame, pairs: dict[str, tuple], part: str) -> DataFrame:
        sets, covs = {"judge": judge, "features": feats, "both": [*judge, *feats], "resid": feats}, {"resid": judge}
        preds = staged(models.pair_predictions(rows, pairs, label, sets, "doc_id", "grp", covs))
        made = []
        for n, (a, b) in pairs.items():
            mine = preds.where(F.col("pair") == n)
            x = _intervals(mine, "grp", list(sets), "both", replicates)
            of = lambda s, c: F.max(F.when(F.col("name") == s, F.col(c)))
            row = x.agg(of("judge", "ba").alias("ba_judge"), of("features", "ba").alias("ba_features"), of("both", "ba").alias("ba_both"), of("judge", "increment").alias("increment"), of("judge", "inc_lo").alias("inc_low"), of("judge", "inc_hi").alias("inc_high"), of("resid", "ba").alias("resid_ba"))
            count = mine.agg(F.count("y").alias("n"), F.countDistinct(F.when(F.col("y") == 0, F.col("grp"))).alias("groups_a"), F.countDistinct(F.when(F.col("y") == 1, F.col("grp"))).alias("groups_b"))
            both = rows.where(F.col(label).isin(a, b)).withColumn("y", (F.col(label) == b).cast("int")).withColumn("__unit", F.concat_ws("#", "grp", "y"))
            perm = stats.group_permutation_test(both, feats, "__unit", "y", replicates=permutations, covs=judge).select(F.col("p_value").alias("resid_p"))
            made.append(count.crossJoin(row).crossJoin(perm).select(F.lit(n).alias("contrast"), F.lit(part).alias("part"), "*"))
        return staged(gates.judge_status(reduce(DataFrame.unionByName, made)))

    dev = run(d.where(F.col(split) == "dev"), contrasts, "dev")
    held = staged(models.with_folds(d.where(F.col(split) == "held_out").drop("fold"), "grp", label))
    status = {r["contrast"]: r["status"] for r in dev.collect()}
    primary, control = list(contrasts)[0], list(contrasts)[-1]
    claim = spark.createDataFrame([(status[primary], status[control])], "p string, c string").select(gates.quality_claim(F.col("p"), F.col("c")).alias("claim"))
    reported = (F.col("part") == "dev") | ((F.col("contrast") == primary) & F.lit(status[primary] == "ADDS"))
    return dev.unionByName(run(held, contrasts, "held_out")).crossJoin(claim).withColumn("reported", reported)


def rewrite_robustness(orig: DataFrame, rewrites: list[DataFrame], rhythm: list[str], lexical: list[str], length: str, least_n: int = 140) -> DataFrame:
    """Whether rhythm loses less than word choice when texts are rewritten, over one or several rewrites; of texts that all forms have."""
    aligned = tables.align(orig, *rewrites, on="doc_id")
    orig, rewrites = staged(aligned[0]), aligned[1:]
    cols = {"r": rhythm, "l": lexical}
    preds = models.paired_oof_sets(orig, [alt.withColumn("fold", F.lit(0)) for alt in rewrites], cols, "doc_id")
    preds = preds.withColumnsRenamed({f"p__{n}": f"{n}_orig" for n in cols} | {f"p__{n}__{k}": f"{n}_{k}" for n in cols for k in range(len(rewrites))})
    preds = staged(preds.join(orig.select("doc_id", "grp"), "doc_id"))
    alts = {n: [f"{n}_{k}" for k in range(len(rewrites))] for n in cols}
    if len(rewrites) == 1:
        diff = stats.bootstrap_diff_in_drops(preds, "grp", ("r_orig", "r_0"), ("l_orig", "l_0"), 200).first()
    else:
        diff = stats.bootstrap_diff_over_realizations(preds, "grp", ("r_orig", alts["r"]), ("l_orig", alts["l"]), 200).first()
    ba = lambda c: stats.balanced_accuracy(preds, p=c).first()["balanced_accuracy"]
    drop = ba("l_orig") - sum(map(ba, alts["l"])) / len(rewrites)
    ratio = rewrites[0].select("doc_id", F.col(length).alias("new")).join(orig.select("doc_id", length), "doc_id").agg(F.avg(F.col("new") / F.col(length))).first()[0]
    row = [(drop, ratio, preds.count(), diff["lo"], diff["hi"], diff["mean"])]
    t = orig.sparkSession.createDataFrame(row, "lexical_drop double, length_ratio double, n long, diff_low double, diff_high double, diff_mean double")
    return gates.robustness(t, least_n=least_n)


def heldout_report(df: DataFrame, feats: list[str], covs: list[str], groups: dict[str, str], label: str, repeats: int = 20, replicates: int = 300) -> DataFrame:
    """Every pair of labels, fitted on dev and scored once on held_out: (pair, kind, ba, lo, hi, n, top_groups, tree).

    kind is plain, of all columns, or residual, of feats less what covs explain
    of them by a fit on dev. Intervals draw whole groups. top_groups are the
    three groups of columns that matter most, each the sum of its columns'
    importance on dev rows; tree is of dev rows. A pair without both labels on
    either side has no row.
    """
    cols = [*feats, *covs]
    labels = sorted(r[0] for r in df.where(F.col(label).isNotNull()).select(label).distinct().collect())
    pairs = {f"{a}_{b}": (a, b) for i, a in enumerate(labels) for b in labels[i + 1 :]}
    dev, held = staged(df.where("split = 'dev'")), staged(df.where("split = 'held_out'"))
    sides = {(r[label], s) for s, d in (("dev", dev), ("held_out", held)) for r in d.select(label).distinct().collect()}
    pairs = {n: ab for n, ab in pairs.items() if all((x, s) in sides for x in ab for s in ("dev", "held_out"))}
    sets, left = {"plain": cols, "residual": feats}, {"residual": covs}
    made = models.fit_pairs(dev, pairs, label, sets, left, fold=None)
    preds = staged(models.pair_predictions(dev, pairs, label, sets, "doc_id", "grp", on=held, made=made))
    imp = models.permutation_importances(made, models.pair_labels(dev, pairs, label), {f"{n}__plain": f"y__{n}" for n in pairs}, cols, "doc_id", repeats)
    lookup = df.sparkSession.createDataFrame(sorted(groups.items()), "feature string, feature_group string")
    tops: dict[str, list] = {f"{n}__plain": [] for n in pairs}
    for r in imp.join(lookup, "feature").groupBy("name", "feature_group").agg(F.round(F.sum("importance"), 12).alias("i")).orderBy("name", F.desc("i"), "feature_group").collect():
        tops[r["name"]].append(r["feature_group"])
    draws = stats.group_bootstrap_by(preds, "pair", "grp", [f"p__{k}" for k in sets], replicates, 0)
    q = lambda c, p: F.percentile(c, F.lit(p))
    ci = {r["pair"]: r for r in draws.groupBy("pair").agg(*[q(f"p__{k}", p).alias(f"{k}_{e}") for k in sets for e, p in (("lo", 0.025), ("hi", 0.975))]).collect()}
    each = preds.select("pair", "y", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"p__{k}").alias("p")) for k in sets])).alias("x")).select("pair", "y", "x.*")
    m = {(r["pair"], r["kind"]): r for r in stats.balanced_accuracy(each, by=["pair", "kind"]).collect()}
    rows = []
    for n, (a, b) in pairs.items():
        mine = dev.where(F.col(label).isin(a, b)).withColumn("y", (F.col(label) == b).cast("int"))
        tree = models.tree_text(models.fit_tree(mine, cols), cols)
        rows += [(n, k, m[n, k]["balanced_accuracy"], ci[n][f"{k}_lo"], ci[n][f"{k}_hi"], m[n, k]["n"], ",".join(tops[f"{n}__plain"][:3]), tree) for k in sets]
    return df.sparkSession.createDataFrame(rows, "pair string, kind string, ba double, lo double, hi double, n long, top_groups string, tree string")


#: A word with more than this share of all read words is told to the tasks; there are at most as many as its inverse.
TOLD = 1 / 50_000


def reading_features(words: DataFrame, stop: list[str], key: list[str]) -> DataFrame:
    """A row for each read word with its predictors, standardised: length, log frequency, syllables, boundary; and fixated, log_trt.

    What hangs on the word alone is worked out once for each distinct word.
    Frequent words are told to the tasks, so only rows of rare ones cross the
    network to meet their predictors; then a sentence's rows meet once.
    """
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    low = counted.groupBy(F.lower("word").alias("low")).agg(F.sum("n").alias("low_n"))
    total = counted.agg(F.sum("n").alias("total"))
    p = counted.join(low, F.lower("word") == F.col("low")).crossJoin(total).withColumn("logfreq", F.log10((F.col("low_n") + 1) / F.col("total")))
    p = staged(p.select("*", *stats.word_alone(F.col("word"), stop)).select("word", "logfreq", *stats.ALONE, (F.col("n") > F.col("total") * TOLD).alias("often")))
    x = words.select(*key, "word_idx", "word", "nFix", "TRT").join(F.broadcast(p.where("often")), "word", "left")
    rare = x.where("often IS NULL").select(*key, "word_idx", "word", "nFix", "TRT").join(p, "word")
    every = x.where("often").unionByName(rare, allowMissingColumns=True)
    last = F.col("word_idx") == F.max("word_idx").over(Window.partitionBy(*key))
    seen = F.col("nFix") > 0
    time = F.when(seen & (F.col("TRT") > 0), F.log(F.greatest("TRT", F.lit(1.0))))
    d = every.withColumn("is_boundary", (F.col("marked") | last).cast("int")).where("wlen > 0")
    d = staged(d.select(*key, "wlen", "logfreq", "nsyl", "is_boundary", seen.cast("int").alias("fixated"), time.alias("log_trt")))
    return tables.zscore(d, ["wlen", "logfreq", "nsyl", "is_boundary"])


def reading_report(d: DataFrame, subject: str, cluster: str) -> DataFrame:
    """(model, term, coef, se, p_value, block_chi2, block_p, n, clusters): whether syllables and boundaries explain skipping and reading time beyond length, frequency and the reader.

    Read words that agree in their predictors are one row of the fits.
    """
    coded = tables.dummies(d, subject, [r[0] for r in d.select(subject).distinct().collect()])
    who = sorted(c for c in coded.columns if c.startswith(f"{subject}_"))
    block, x = ["nsyl_z", "is_boundary_z"], ["wlen_z", "logfreq_z"]
    skip = stats.logit_cluster(coded, "fixated", [*x, *who, *block], block, cluster, repeated=True).withColumn("model", F.lit("skip"))
    time = stats.ols_cluster(coded.where("fixated = 1"), "log_trt", [*x, *who, *block], block, cluster, repeated=True).withColumn("model", F.lit("reading_time"))
    return skip.unionByName(time)


def reading_verdict(report: DataFrame, boundary: str = "is_boundary_z") -> DataFrame:
    """One row: the block statistics of both models, the boundary's coefficient in the reading time model, and the verdict: RELATED if that model's block is beyond chance at 0.01, or its boundary is and slows."""
    of = lambda m, c, t=None: F.max(F.when((F.col("model") == m) & ((F.col("term") == t) if t else F.lit(True)), F.col(c)))
    t = report.agg(of("skip", "block_chi2").alias("skip_chi2"), of("reading_time", "block_chi2").alias("time_chi2"), of("reading_time", "block_p").alias("p"), of("reading_time", "coef", boundary).alias("boundary"), of("reading_time", "p_value", boundary).alias("bp"))
    return t.withColumn("verdict", F.when((F.col("p") < 0.01) | ((F.col("bp") < 0.01) & (F.col("boundary") > 0)), "RELATED").otherwise("NOT-RELATED")).select("skip_chi2", "time_chi2", "boundary", "verdict")
