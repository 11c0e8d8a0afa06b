"""Order-aware features of a series (doc, pos, value). Each is 0 where it is undefined."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.functions import text as T
from prosemill.operators import rhythm

#: The ten columns of the order row: (column, series, feature).
ORDER = (("sl_ac1", "sl", "ac1"), ("sl_mk", "sl", "mk"), ("sl_bvr", "sl", "bvr"), ("sl_lre", "sl", "lre"), ("sl_turning", "sl", "turning"), ("spw_ac1", "spw", "ac1"), ("syms_ac1", "syms", "ac1"), ("syms_runz", "syms", "runz"), ("phg_ac1", "phg", "ac1"), ("phg_lre", "phg", "lre"))


def _keys(key: list[str]) -> tuple[Window, Window]:
    return Window.partitionBy(*key), Window.partitionBy(*key).orderBy("pos")


def _zero(cond: Column, c: Column) -> Column:
    return F.coalesce(F.when(cond, c), F.lit(0.0))


def ac1(s: DataFrame, key: list[str]) -> DataFrame:
    """Autocorrelation at lag 1; 0 below three values or if constant."""
    all_, w = _keys(key)
    x = s.withColumn("c", F.col("value") - F.avg("value").over(all_)).withColumn("l", F.lag("c").over(w))
    ss = F.sum(F.col("c") * F.col("c"))
    return x.groupBy(*key).agg(_zero((F.count("c") >= 3) & (F.max("value") > F.min("value")), F.sum(F.col("c") * F.col("l")) / ss).alias("ac1"))


def mk(s: DataFrame, key: list[str]) -> DataFrame:
    """Mann-Kendall S over all pairs; 0 below four values.

    No pair is formed. Values become ranks, and two ranks first differ in one
    bit: for each bit, each value counts those before it that agree with it
    above that bit and differ in it. So a series costs its length times the
    bits of its number of distinct values.
    """
    all_, _ = _keys(key)
    ranked = s.withColumn("__r", F.dense_rank().over(Window.partitionBy(*key).orderBy("value")) - 1).withColumn("__m", F.max("__r").over(all_))
    bits = ranked.withColumn("__k", F.explode(F.sequence(F.lit(0), F.length(F.bin("__m")) - 1)))
    bit = F.expr("shiftright(__r, __k) & 1")
    w = Window.partitionBy(*key, "__k", "__above").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    x = bits.withColumns({"__bit": bit, "__above": F.expr("shiftright(__r, __k + 1)")})
    ones, before = F.coalesce(F.sum("__bit").over(w), F.lit(0)), F.count("__bit").over(w)
    x = x.withColumn("__t", F.when(F.col("__bit") == 1, before - ones).otherwise(-ones))
    t = x.groupBy(*key).agg(F.sum("__t").alias("t"), F.count_if(F.col("__k") == 0).alias("n"))
    return t.select(*key, _zero(F.col("n") >= 4, F.col("t") / (F.col("n") * (F.col("n") - 1) / 2.0)).alias("mk"))


def bvr(s: DataFrame, key: list[str]) -> DataFrame:
    """Variance of the means of thirds, by their sizes, over the mean variance within them; 0 below six values."""
    _, w = _keys(key)
    thirds = s.withColumn("third", F.ntile(3).over(w)).groupBy(*key, "third").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"), F.count("value").alias("c"))
    whole = F.sum(F.col("m") * F.col("c")).over(Window.partitionBy(*key)) / F.sum("c").over(Window.partitionBy(*key))
    thirds = thirds.withColumn("d", F.col("c") * (F.col("m") - whole) ** 2)
    return thirds.groupBy(*key).agg(_zero((F.sum("c") >= 6) & (F.avg("v") > 0), F.sum("d") / F.sum("c") / F.avg("v")).alias("bvr"))


def lre(s: DataFrame, key: list[str]) -> DataFrame:
    """Variance of the moving mean of three over the variance; 0 below six values or if constant."""
    all_, w = _keys(key)
    x = s.withColumn("n", F.count("value").over(all_)).withColumn("i", F.row_number().over(w)).withColumn("m", F.avg("value").over(w.rowsBetween(-1, 1)))
    inner = F.when((F.col("i") > 1) & (F.col("i") < F.col("n")), F.col("m"))
    return x.groupBy(*key).agg(_zero((F.count("value") >= 6) & (F.max("value") > F.min("value")), F.var_pop(inner) / F.var_pop("value")).alias("lre"))


def turning(s: DataFrame, key: list[str]) -> DataFrame:
    """Strict local extremes over the inner values; 0 below three."""
    _, w = _keys(key)
    x = s.withColumn("a", F.lag("value").over(w)).withColumn("b", F.lead("value").over(w))
    v = F.col("value")
    turn = ((v > F.col("a")) & (v > F.col("b"))) | ((v < F.col("a")) & (v < F.col("b")))
    n = F.count("value")
    return x.groupBy(*key).agg(_zero(n >= 3, F.sum(F.coalesce(turn, F.lit(False)).cast("double")) / (n - 2)).alias("turning"))


def runz(s: DataFrame, key: list[str]) -> DataFrame:
    """z of the number of runs of a 0/1 series, within -6 and 6; 0 below six values."""
    _, w = _keys(key)
    x = s.withColumn("ch", F.coalesce((F.col("value") != F.lag("value").over(w)).cast("double"), F.lit(0.0)))
    g = x.groupBy(*key).agg(F.count("value").cast("double").alias("n"), F.sum((F.col("value") == 1).cast("double")).alias("n1"), F.sum((F.col("value") == 0).cast("double")).alias("n0"), (F.sum("ch") + 1).alias("runs"))
    a = 2.0 * F.col("n1") * F.col("n0")
    n = F.col("n")
    var = a * (a - n) / (n * n * (n - 1))
    z = (F.col("runs") - (1.0 + a / n)) / F.sqrt(var)
    return g.select(*key, _zero((n >= 6) & (F.col("n1") > 0) & (F.col("n0") > 0) & (var > 0), F.least(F.lit(6.0), F.greatest(F.lit(-6.0), z))).alias("runz"))


FEATURES = {"ac1": ac1, "mk": mk, "bvr": bvr, "lre": lre, "turning": turning, "runz": runz}


def sensitivity(real: DataFrame, control: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(feature, sensitivity): mean absolute difference of the real and the shuffled features, over documents and draws."""
    cols = [c for c, _, _ in ORDER]
    both = real.join(control.select(doc, *[F.col(c).alias(f"{c}_shuf") for c in cols]), doc)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.abs(F.col(c) - F.col(f"{c}_shuf")).alias("d")) for c in cols])).alias("x")
    return both.select(pairs).groupBy("x.feature").agg(F.avg("x.d").alias("sensitivity"))


def null_percentile(real: DataFrame, draws: DataFrame, cols: list[str], doc: str = "doc_id") -> DataFrame:
    """Where the real value of each feature falls among the draws: the mean share of draws below it."""
    both = draws.join(real.select(doc, *[F.col(c).alias(f"{c}_real") for c in cols]), doc)
    return both.groupBy(doc).agg(*[F.avg((F.col(c) < F.col(f"{c}_real")).cast("double")).alias(c) for c in cols])


def level_features(s: DataFrame, threshold: float = 1.0, lo: float = 0.0, hi: float = 2.0, bins: int = 5, doc: str = "doc_id") -> DataFrame:
    """Eight statistics of a score along a text: moments, runs and gaps above the threshold, entropy of its histogram, ac1. All 0 below three values."""
    key = [doc]
    high = s.select(doc, "pos", (F.col("value") > threshold).cast("int").alias("value"))
    m = s.groupBy(doc).agg(F.count("value").alias("n"), F.avg("value").alias("level_mean"), F.var_pop("value").alias("level_var"), rhythm.cv(F.avg("value"), F.stddev_pop("value")).alias("level_cv"))
    inside = s.where((F.col("value") >= lo) & (F.col("value") <= hi))
    binned = inside.withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("value") - lo) / ((hi - lo) / bins))))
    high_pos = high.withColumn("i", F.row_number().over(Window.partitionBy(doc).orderBy("pos"))).select(doc, F.col("i").alias("pos"), "value")
    g = rhythm.moments(rhythm.gaps(high_pos, doc), "level_gap", doc, "gap").drop("level_gap_cv")
    runs = rhythm.run_lengths(high, doc).groupBy(doc).agg(F.var_pop("length").alias("level_runlen_var"))
    parts = [runs, rhythm.entropy(binned, "bin", "level_entropy", doc), g, ac1(s, key).withColumnRenamed("ac1", "level_ac1")]
    out = reduce(lambda a, b: a.join(b, doc, "left"), parts, m)
    cols = ["level_mean", "level_var", "level_cv", "level_runlen_var", "level_entropy", "level_gap_mean", "level_gap_var", "level_ac1"]
    return out.select(doc, *[F.when(F.col("n") >= 3, F.coalesce(c, F.lit(0.0))).otherwise(0.0).alias(c) for c in cols])
