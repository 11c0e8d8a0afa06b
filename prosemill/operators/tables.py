"""Checks, joins by key and small aggregates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from prosemill.sources import staged


def bad_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows where any of cols is null, NaN or infinite."""
    bad = [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")) for c in cols]
    return df.where(reduce(lambda a, b: a | b, bad))


def out_of_range(df: DataFrame, cols: list[str], lo: float, hi: float) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() | ~F.col(c).between(lo, hi) for c in cols]))


def not_finite(c: str) -> Column:
    """A check for guarded() and write_checked(): null, NaN or infinite."""
    v = F.col(c).cast("double")
    return v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))


def outside(c: str, lo: float, hi: float) -> Column:
    """A check: null or not within the range."""
    return F.col(c).isNull() | ~F.col(c).between(lo, hi)


def guarded(df: DataFrame, checks: dict[str, Column], key: str) -> DataFrame:
    """df, whose rows fail whatever job reads them if a check holds, with the check and the row's key in the error.

    The check is part of the plan: no further scan, and it stays where key is read.
    """
    out = F.col(key)
    for name, bad in checks.items():
        error = F.raise_error(F.concat(F.lit(f"{name}: {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
        out = F.when(F.coalesce(bad, F.lit(True)), error.cast(df.schema[key].dataType)).otherwise(out)
    return df.withColumn(key, out)


def write_checked(df: DataFrame, path: str, checks: dict[str, Column], key: str, fail: bool = True) -> dict[str, dict]:
    """Write df to path and check all rows in the same scan: for each check the rows for which it holds, and the least and greatest of their keys.

    If there are any, the table is deleted again and an error names them; fail
    False leaves it and only reports.
    """
    seen = Observation()
    of = {}
    for i, bad in enumerate(checks.values()):
        hit = F.coalesce(bad, F.lit(True))
        of |= {f"n{i}": F.count_if(hit), f"lo{i}": F.min(F.when(hit, F.col(key))), f"hi{i}": F.max(F.when(hit, F.col(key)))}
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *[e.alias(k) for k, e in of.items()]).write.parquet(path)
    got = seen.get
    report = {name: {"rows": got["rows"], "bad": got[f"n{i}"], "first": got[f"lo{i}"], "last": got[f"hi{i}"]} for i, name in enumerate(checks)}
    wrong = {k: v for k, v in report.items() if v["bad"]}
    if wrong and fail:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
        raise ValueError("; ".join(f"{k}: {v['bad']} of {v['rows']} rows, {key} from {v['first']} to {v['last']}" for k, v in wrong.items()))
    return report


def covered(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows of df with those of ids that it lacks as rows of nulls and __lacks true: a check on __lacks finds them in the scan that writes."""
    return df.withColumn("__there", F.lit(True)).join(ids.select(on).distinct(), on, "right").withColumn("__lacks", F.col("__there").isNull()).drop("__there")


def missing(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Those of ids that df lacks."""
    return ids.join(df, on, "left_anti")


def align(*dfs: DataFrame, on: str) -> list[DataFrame]:
    """Each table cut to the keys that all have."""
    common = reduce(lambda a, b: a.join(b, on, "left_semi"), [d.select(on).distinct() for d in dfs])
    return [d.join(common, on, "left_semi") for d in dfs]


def refresh(df: DataFrame, updates: DataFrame, on: str, col: str) -> DataFrame:
    """df with col from updates where they have the key."""
    new = updates.select(on, F.col(col).alias("__new"))
    return df.join(new, on, "left").withColumn(col, F.coalesce("__new", col)).drop("__new")


def null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join where nulls equal nulls; keeps the left side's keys."""
    r = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    return left.join(r, [left[c].eqNullSafe(r[f"__r_{c}"]) for c in on], how).drop(*[f"__r_{c}" for c in on])


def compute_distinct(df: DataFrame, keys: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with what compute makes of each distinct key, worked out once. Hashes stand for the keys in grouping and in the join, and null keys match."""
    hashed = F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)
    made = compute(df.select(*keys, hashed.alias("__key")).dropDuplicates(["__key"]).drop("__key"))
    new = [c for c in made.columns if c not in keys]
    return df.withColumn("__key", hashed).join(made.select(hashed.alias("__key"), *new), "__key").drop("__key")


def quantiles(df: DataFrame, group: list[str], value: str, qs: list[float], pieces: int = 64) -> DataFrame:
    """(group..., q, v): exact quantiles of each group, interpolated between neighbours; nulls don't count.

    No task holds or orders all values of a group: equal values are one row,
    approximate quantiles cut each group into pieces, and only the pieces that
    hold a wanted rank are ordered. The approximate ones differ from run to
    run, so they are worked out once, into a table.
    """
    v = F.col("__v")
    x = df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("__v"))
    cuts = x.groupBy(*group).agg(F.percentile_approx("__v", [i / pieces for i in range(1, pieces)], 1000).alias("cuts"), F.count(F.lit(1)).alias("total"))
    cuts = staged(cuts)
    n = null_safe(x.groupBy(*group, "__v").agg(F.count(F.lit(1)).alias("n")), cuts, group).withColumn("piece", F.size(F.filter("cuts", lambda c: c < v))).drop("cuts")
    sums = n.groupBy(*group, "piece", "total").agg(F.sum("n").alias("held"))
    sums = sums.withColumn("before", F.sum("held").over(Window.partitionBy(*group).orderBy("piece")) - F.col("held"))
    wanted = F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q")
    asked = sums.select(*group, "piece", "total", "before", "held", wanted).withColumn("rank", F.col("q") * (F.col("total") - 1))
    lo, hi = F.floor("rank"), F.ceil("rank")
    asked = asked.where((lo < F.col("before") + F.col("held")) & (hi >= F.col("before"))).select(*group, "piece", "before", "q", "rank")
    at = [*group, "piece"]
    inside = null_safe(n.drop("total"), asked.select(*at, "before").distinct(), at)
    inside = inside.withColumn("below", F.col("before") + F.sum("n").over(Window.partitionBy(*at).orderBy(v)) - F.col("n")).drop("before")
    hit = null_safe(inside, asked.drop("before"), at)
    of = lambda k: F.max(F.when((k >= F.col("below")) & (k < F.col("below") + F.col("n")), v))
    out = hit.groupBy(*group, "q").agg(of(lo).alias("a"), of(hi).alias("b"), F.max("rank").alias("rank"))
    return out.select(*group, "q", (F.col("a") + (F.col("rank") - F.floor("rank")) * (F.col("b") - F.col("a"))).alias("v"))


def numbered(df: DataFrame, group: list[str], order: list[str], name: str = "nth") -> DataFrame:
    """df with the position of each row within its group in order, from 1.

    Rows are dealt by range over group and order, numbered within a part and
    moved by the rows of the group in the parts before: a group is many tasks.
    """
    dealt = staged(df.repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id()))
    per = dealt.groupBy("__part", *group).agg(F.count(F.lit(1)).alias("__n"))
    per = per.withColumn("__before", F.sum("__n").over(Window.partitionBy(*group).orderBy("__part")) - F.col("__n")).drop("__n")
    inside = dealt.withColumn(name, F.row_number().over(Window.partitionBy("__part", *group).orderBy(*order)).cast("long"))
    return null_safe(inside, per, ["__part", *group]).withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before")


def source_concentration(df: DataFrame, group: str, source: str, k: int) -> DataFrame:
    """(group, source, n, rank, share): the k largest sources of each group and their share of it."""
    n = df.groupBy(group, source).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(group))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), source))
    return n.withColumn("share", share).withColumn("rank", rank).where(F.col("rank") <= k)


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, n, mean, std, min, p25, p50, p75, max) of numeric columns."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x")).select("x.*")
    q = quantiles(long, ["column"], "v", [0.25, 0.5, 0.75]).groupBy("column").agg(*[F.max(F.when(F.col("q") == p, F.col("v"))).alias(n) for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
    m = long.groupBy("column").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    return m.join(q, "column", "left").select("column", "n", "mean", "std", "min", "p25", "p50", "p75", "max")


def zscore(df: DataFrame, cols: list[str]) -> DataFrame:
    """df with c_z for each c, by the sample deviation; 0 if constant."""
    stats = df.agg(*[f(c).alias(f"__{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    both = df.crossJoin(stats)  # one row
    z = lambda c: F.when(F.col(f"__s_{c}") > 0, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).otherwise(F.col(c) * 0.0)
    return both.select(*df.columns, *[z(c).alias(f"{c}_z") for c in cols])


def dummies(df: DataFrame, col: str, levels: list[str]) -> DataFrame:
    """df with a 0/1 column for each level but the first."""
    return df.select("*", *[(F.col(col) == v).cast("int").alias(f"{col}_{v}") for v in sorted(levels)[1:]])


def distinct_sketches(df: DataFrame, by: list[str], col: str, lg_k: int = 14) -> DataFrame:
    """(by, sketch): a mergeable sketch of the distinct values of col, of 2**lg_k registers at most.

    Its estimate is off by about 1.04 / sqrt(2**lg_k) of the count, 0.8 % at 14,
    whatever the rows; nulls don't count.
    """
    return df.groupBy(*by).agg(F.hll_sketch_agg(col, F.lit(lg_k)).alias("sketch"))


def merged_distinct(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by, distinct): the distinct values that any of the merged sketches has seen."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))
