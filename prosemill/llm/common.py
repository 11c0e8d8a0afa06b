"""Helpers shared by the operators: staged tables, ranks and shipped code."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in spark.checkpoint.dir. Only where that is unset and
    all runs in one process, as in tests, a temporary folder takes its place;
    elsewhere a folder of one machine would lose rows, so that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="prosemill-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Cuts the lineage: what follows survives the loss of any executor without
    computing df again, and an iteration's plan doesn't grow.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/prosemill-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*staged: DataFrame) -> None:
    """Delete the files of tables made by stage() that nothing reads any more."""
    for df in staged:
        for file in df.inputFiles()[:1]:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if path.getParent().getName().startswith("prosemill-"):
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with the gapless position of each row in a global order, from 0.

    The rows are dealt by range, numbered within each partition and moved by
    the partition's offset, so no task sees more than its own range. Ties must
    be broken by order. Null keys sort as order says.
    """
    at = "__part"
    dealt = df.repartitionByRange(*order).withColumn(at, F.spark_partition_id())
    dealt = stage(dealt)
    counts = dealt.groupBy(at).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(at, (F.sum("__n").over(Window.orderBy(at)) - F.col("__n")).alias("__before"))
    return (
        dealt.withColumn(name, F.row_number().over(Window.partitionBy(at).orderBy(*order)).cast("long") - 1)
        .join(offsets, at)
        .withColumn(name, F.col(name) + F.col("__before"))
        .drop(at, "__before")
    )


def ship(spark: SparkSession) -> None:
    """Give the executors this package once per application, as --py-files does."""
    sc: SparkContext = spark.sparkContext
    if getattr(sc, "_prosemill_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    to = os.path.join(tempfile.mkdtemp(prefix="prosemill-code-"), "prosemill.zip")
    with zipfile.ZipFile(to, "w") as z:
        for top, _, names in os.walk(os.path.join(root, "prosemill")):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(top, n), os.path.relpath(os.path.join(top, n), root))
    sc.addPyFile(to)
    sc._prosemill_shipped = True


def unit(*cols: Column | str) -> Column:
    """A uniform number in [0, 1) that is a function of cols alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 53)) / F.lit(float(1 << 53))


def let(value: Column, then) -> Column:
    """then(value) with value computed once, also where then uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), then), 1)


def same(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on on where nulls equal nulls; keeps the left side's key columns."""
    r = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    cond = None
    for c in on:
        e = left[c].eqNullSafe(r[f"__r_{c}"])
        cond = e if cond is None else cond & e
    return left.join(r, cond, how).drop(*[f"__r_{c}" for c in on])


#: A key of more than one in so many rows is a hot one, so there are at most so many hot keys.
HOT = 2000


def hot_keys(df: DataFrame, key: list[str], least: int = 100) -> DataFrame | None:
    """The keys that hold more than 1/HOT of df's rows, and more than least; None if there are none. HOT rows at most, as a local table."""
    n = df.count()
    if n <= 10 * least:
        return None
    per = df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > max(least, n / HOT)).select(*key)
    rows = per.collect()
    return df.sparkSession.createDataFrame(rows, per.schema) if rows else None


def spread_join(left: DataFrame, right: DataFrame, key: list[str], hot: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """left joined with right on key, where left may hold very many rows of one key and right only a few of each.

    Hot keys of left meet their few rows of right by broadcast, so that no task
    gets all rows of a key; the rest is shuffled. left should be staged, as it
    is read once to count. hot: its hot keys, if known.
    """
    hot = hot if hot is not None else hot_keys(left, key)
    if hot is None:
        return left.join(right, key, how)
    few = right.join(F.broadcast(hot), key, "left_semi")
    rest = left.join(F.broadcast(hot), key, "left_anti").join(right, key, how)
    return left.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(few), key, how).unionByName(rest)


#: Bits of a sieve, and bits to a word of it: 8 MB whatever it holds.
SIEVE, WORD = 1 << 26, 64


def sieved(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """df without most of the rows whose key isn't in wanted, where they are read, ahead of the join that decides.

    A broadcast of SIEVE bits, set by hashed key. The more keys, the more other
    rows pass, but its size is fixed. Rows without a key go.
    """
    spot = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(SIEVE))
    word, bit = F.floor(spot / WORD).alias("__word"), (spot % WORD).cast("int")
    bits = wanted.where(F.col(key).isNotNull()).groupBy(word).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("__bits"))
    may = df.where(F.col(key).isNotNull()).withColumns({"__word": F.floor(spot / WORD), "__bit": bit})
    return may.join(F.broadcast(bits), "__word").where(F.getbit("__bits", F.col("__bit")) == 1).select(*[F.col(f"`{c}`") for c in df.columns])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long): (node, comp), comp the least node.

    Least labels spread along the edges and then jump to their own label's
    label, so chains shorten at twice the speed each round. Every round is a
    staged table; nothing but the number of changed labels reaches the driver.
    """
    both = stage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    hubs = hot_keys(both, ["b"])
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")))
    while True:
        told = labels.select(F.col("node").alias("b"), "comp")
        heard = (spread_join(both, told, ["b"], hubs) if hubs is not None else both.join(told, "b")).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        near = stage(labels.join(heard, "node").select("node", F.col("comp").alias("was"), F.least("comp", "m").alias("c")))
        up = labels.select(F.col("node").alias("c"), F.col("comp").alias("up"))
        new = stage(spread_join(near, up, ["c"]).select("node", "was", F.least("c", "up").alias("comp")))
        changed = new.where("was <> comp").count()
        discard(labels, near)
        labels = new.select("node", "comp")
        if not changed:
            discard(both)
            return labels
