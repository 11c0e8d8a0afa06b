"""Deduplication, stratified samples, folds, splits and numbering. Every draw is a hash, so results repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.functions import text as T
from prosemill.operators import tables
from prosemill.sources import staged


def top_per_group(df: DataFrame, group: str | list[str], order: list[Column | str], k: int) -> DataFrame:
    """The first k rows of each group in order; a partial limit runs before the shuffle."""
    keys = [group] if isinstance(group, str) else group
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= k).drop("__r")


def dedup_exact(df: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """The first row of each distinct text; its hash, not the text, is the key."""
    return top_per_group(df.withColumn("__h", F.sha2(text, 256)), "__h", [order], 1).drop("__h")


def tail_of_groups(df: DataFrame, group: str, score: str, q: float) -> DataFrame:
    """The rows of each group at or below its q-quantile; null is a group."""
    cut = tables.quantiles(df, [group], score, [q]).select(group, F.col("v").alias("cut"))
    return tables.null_safe(df, cut, [group]).where(F.col(score) <= F.col("cut"))


def tail_by_group(df: DataFrame, group: str, score: str, q: float, k: int, tie: str) -> DataFrame:
    """The k worst rows of each group at or below its q-quantile, worst first, with rank."""
    tail = tail_of_groups(df, group, score, q)
    return tail.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(score, tie))).where(F.col("rank") <= k)


def length_bin(n: Column, lo: float, hi: float, bins: int) -> Column:
    """Equal-width bin from 0, values outside clamped."""
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((n - lo) / ((hi - lo) / bins)))).cast("int")


def stratified_sample(df: DataFrame, n: int, cap: int, bins: int, seed: int, key: str, group: str, source: str, bin_: str) -> DataFrame:
    """Up to n rows of each group, at most cap from a source, filled from the bins evenly first.

    Rows are ranked within (group, source) by a hash and cut at cap; the first
    n / bins of each (group, bin) are the quota, the rest fills up to n. No bin
    gives more than its first n, so no later rank sees more of it.
    """
    h = T.md5_int(F.lit(seed), F.col(key))
    capped = df.withColumn("__h", h).withColumn("__s", F.row_number().over(Window.partitionBy(group, source).orderBy("__h", key))).where(F.col("__s") <= cap)
    binned = capped.withColumn("__b", F.row_number().over(Window.partitionBy(group, bin_).orderBy("__h", key))).where(F.col("__b") <= n)
    late = (F.col("__b") > n // bins).cast("int")
    return top_per_group(binned.withColumn("__late", late), group, ["__late", "__h", key], n).drop("__h", "__s", "__b", "__late")


def number_passages(df: DataFrame, label: str, order: str, prefix: Column) -> DataFrame:
    """passage_id: prefix and the position within the label, as three digits at least."""
    nth = (F.col("__nth") - 1).cast("string")
    return tables.numbered(df, [label], [order], "__nth").withColumn("passage_id", F.concat(prefix, F.lit("_"), F.lpad(nth, F.greatest(F.lit(3), F.length(nth)), "0"))).drop("__nth")


#: Groups that are placed one after the other, the largest; the others, of less than one in so many rows, are dealt.
PLACED = 4096


def group_folds(df: DataFrame, group: str, y: str, k: int, seed: int, placed: int = PLACED) -> DataFrame:
    """(group, fold): every group in one fold, so that each label's rows spread evenly over the folds.

    The largest groups are placed in turn, each in the fold where its labels are
    rarest so far: that keeps the sum of the labels' squared shares least. Of
    equal folds the smaller takes it, then the earlier. A table of more than
    `placed` groups deals the rest, by majority label, back and forth by size.
    Null labels are a label; null groups are one group.
    """
    labels = [r[0] for r in df.select(y).distinct().orderBy(y).collect()]
    if not labels:
        return df.select(group).distinct().withColumn("fold", F.lit(0))
    each = [F.count_if(F.col(y).eqNullSafe(F.lit(v))).alias(f"n{i}") for i, v in enumerate(labels)]
    groups = staged(df.groupBy(group).agg(*each).select(group, F.array(*[f"n{i}" for i in range(len(labels))]).alias("n"), T.md5_int(F.lit(seed), F.col(group)).alias("h")))
    size = F.aggregate("n", F.lit(0).cast("long"), lambda s, v: s + v)
    total = groups.agg(F.array(*[F.sum(F.get("n", F.lit(i))) for i in range(len(labels))]).alias("t")).first()["t"]
    largest = groups.withColumn("size", size).orderBy(F.desc("size"), "h", group).limit(placed)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("less"), "h", F.col(group).alias("g"), "n"))), lambda x: F.struct(x["g"].alias("g"), x["n"].alias("n")))
    zero = F.array_repeat(F.array_repeat(F.lit(0).cast("long"), len(labels)), k)
    start = F.struct(zero.alias("held"), F.array().cast("array<int>").alias("folds"))

    def place(s, g):
        rarity = lambda c: F.aggregate(F.zip_with(F.zip_with(c, g["n"], lambda a, b: (a * b).cast("double")), F.array(*[F.lit(float(t or 1)) for t in total]), lambda v, t: v / t / t), F.lit(0.0), lambda u, v: u + v)
        rows = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda u, v: u + v)
        best = F.array_min(F.transform(s["held"], lambda c, i: F.struct(rarity(c).alias("r"), rows(c).alias("n"), i.alias("i"))))["i"]
        return F.element_at(F.transform(F.array(best), lambda at: F.struct(F.transform(s["held"], lambda c, i: F.when(i == at, F.zip_with(c, g["n"], lambda a, b: a + b)).otherwise(c)).alias("held"), F.array_append(s["folds"], at).alias("folds"))), 1)

    one = largest.agg(ordered.alias("gs")).select("gs", F.aggregate("gs", start, place)["folds"].alias("folds"))
    out = one.select(F.explode(F.arrays_zip("gs", "folds")).alias("x")).select(F.col("x.gs.g").alias(group), F.col("x.folds").alias("fold"))
    if groups.count() <= placed:
        return out
    small = tables.null_safe(groups, largest.select(group), [group], "left_anti").withColumns({"size": size, "label": F.array_position("n", F.array_max("n"))})
    turn = F.pmod(F.col("__i") - 1, F.lit(2 * k))
    dealt = tables.numbered(small.withColumn("less", -F.col("size")), ["label"], ["less", "h", group], "__i")
    return out.unionByName(dealt.select(group, F.when(turn < k, turn).otherwise(2 * k - 1 - turn).cast("int").alias("fold")))


def with_folds(df: DataFrame, group: str, y: str, k: int = 5, seed: int = 0) -> DataFrame:
    return tables.null_safe(df, group_folds(df, group, y, k, seed), [group])


def quarantine_split(folded: DataFrame, y: str, fold: str = "fold") -> DataFrame:
    """folded with split: held_out for the first fold that has every label, dev for the rest; none held if no fold has."""
    all_ = folded.agg(F.countDistinct(y).alias("k"))
    ok = folded.groupBy(fold).agg(F.countDistinct(y).alias("c")).join(all_, F.col("c") == F.col("k")).agg(F.min(fold).alias("held"))
    return folded.crossJoin(ok).withColumn("split", F.when(F.col(fold) == F.col("held"), "held_out").otherwise("dev")).drop("held")


def carry_forward(split: DataFrame, rows: DataFrame, key: str, label: str, group: str, share: float = 0.2, seed: int = 0) -> DataFrame:
    """(key, split) of all rows: known members stay; whole new groups are held until their class has its rounded share."""
    new = rows.join(split, key, "left_anti")
    groups = new.groupBy(label, group).agg(F.count(F.lit(1)).alias("n"))
    h = T.md5_int(F.lit(seed), F.col(group))
    w = Window.partitionBy(label).orderBy(h, group)
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    target = F.bround(F.sum("n").over(Window.partitionBy(label)) * F.lit(share))
    placed = groups.select(label, group, F.when(before < target, "held_out").otherwise("dev").alias("split"))
    return split.select(key, "split").unionByName(new.join(placed, [label, group]).select(key, "split"))


def group_overlap(split: DataFrame, group: str) -> DataFrame:
    """Groups on both sides of a split; none if there is no leak."""
    return split.groupBy(group).agg(F.countDistinct("split").alias("sides")).where("sides > 1")


def blind_batches(df: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """(key, aid, batch): an anonymous id in shuffled order and its batch; the table is the mapping back.

    The order is cut into hashed blocks whose counts give each block's offset.
    """
    h = T.md5_int(F.lit(seed), F.col(key))
    t = df.select(key, h.alias("h")).withColumn("block", F.floor(F.col("h") / (1 << 18)))
    n = t.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    offset = n.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))  # 16,384 rows at most
    at = t.join(offset, "block").withColumn("i", F.col("before") + F.row_number().over(Window.partitionBy("block").orderBy("h", key)) - 1)
    s = F.col("i").cast("string")
    return at.select(key, F.concat(F.lit("p"), F.lpad(s, F.greatest(F.lit(3), F.length(s)), "0")).alias("aid"), F.floor(F.col("i") / size).cast("int").alias("batch"))


def spread_groups(df: DataFrame, group: str, value: str, order: str, n: int) -> DataFrame:
    """Every row of one group gets one of n made-up groups in turn."""
    hit = F.col(group).eqNullSafe(F.lit(value))
    turn = F.pmod(F.col("__t") - 1, F.lit(n)).cast("string")
    spread = tables.numbered(df.where(hit), [group], [order], "__t").withColumn(group, F.concat(F.lit(f"{value}_"), turn)).drop("__t")
    return df.where(~hit).unionByName(spread)
