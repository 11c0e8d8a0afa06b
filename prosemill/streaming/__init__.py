"""Incremental forms: what is new is worked on, once; what is known stays.

Cleaning, segmenting and other row-local functions run on a stream unchanged.
Aggregates by document run in foreachBatch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from prosemill.functions import text as T
from prosemill.sources import shared_path


def unscored(rows: DataFrame, scored: DataFrame, key: str) -> DataFrame:
    """Rows without a score yet, to resume from."""
    return rows.join(scored, key, "left_anti")


def committed(spark: SparkSession, path: str) -> list[str]:
    """The folders of a resumable table whose job ended well; others are left by a crash and don't count."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    found = [x.getPath() for x in fs.listStatus(p) if x.isDirectory()]
    return sorted(x.toString() for x in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))


def resume(rows: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, key: str, every: int = 100_000, most: int = 1_000) -> DataFrame:
    """Score the rows that the table at path lacks, bucket by bucket, and return the whole table.

    Rows are dealt by a hash of the key to buckets of about `every` rows, `most`
    buckets at most. Each bucket is scored and committed by itself, so a crash
    loses one; what it left uncommitted is never read. A later call deals out
    anew what has no score, and scores nothing twice.
    """
    spark = rows.sparkSession
    done = committed(spark, path)
    todo = unscored(rows, spark.read.parquet(*done).select(key), key) if done else rows
    n = todo.count()
    if n or not done:
        buckets = max(1, min(most, -(-n // every)))
        dealt = todo.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        at = shared_path(spark)
        dealt.write.partitionBy("__bucket").parquet(at)
        held = spark.read.schema(dealt.schema).parquet(at)
        for b in range(buckets):
            score(held.where(F.col("__bucket") == b).drop("__bucket")).write.parquet(f"{path}/{uuid.uuid4().hex}")
        _delete(spark, at)
    return spark.read.parquet(*committed(spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def stream_files(spark: SparkSession, path: str, schema, per_trigger: int = 16) -> DataFrame:
    """New Parquet files of a folder as a stream; the source remembers those it has seen."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Work through all that is there, batch by batch, and stop; a later run goes on from the checkpoint."""
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def append_unseen(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A sink that appends the keys it lacks, so a repeated batch changes nothing."""

    def each(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates([key])
        if _exists(batch.sparkSession, path):
            new = unscored(new, batch.sparkSession.read.parquet(path).select(key), key)
        new.write.mode("append").parquet(path)

    return each


def collect_updates(counts: DataFrame, keys: list[str], path: str, checkpoint: str) -> DataFrame:
    """A streaming aggregate run over all that is there; of each key what the last batch that changed it says.

    Each batch's changes are one folder of the table at path, so a repeated
    batch replaces its own.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = counts.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    rest = [c for c in counts.columns if c not in keys]
    last = counts.sparkSession.read.parquet(path).groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x"))
    return last.select(*keys, "x.*")


def windowed_counts(stream: DataFrame, ts: str, group: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by time window and group, with rows later than `late` left out on a stream."""
    s = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    s = s.withWatermark(ts, late) if stream.isStreaming else s
    return s.groupBy(F.window(ts, size).alias("w"), group).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), group, "n")


def group_counts(stream: DataFrame, label: str, group: str) -> DataFrame:
    """(label, group, n, first): of each group that a batch of the stream brings, its rows and whether no batch before had any.

    The state, by label and group, is the number of rows so far.
    """
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (label, group)}

    def each(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = sum(len(f) for f in frames)
        before = state.get[0] if state.exists else 0
        state.update((before + n,))
        yield pd.DataFrame({label: [key[0]], group: [key[1]], "n": [n], "first": [before == 0]})

    schema = f"`{label}` {kinds[label]}, `{group}` {kinds[group]}, n long, first boolean"
    return stream.select(label, group).groupBy(label, group).applyInPandasWithState(each, schema, "seen long", "update", GroupStateTimeout.NoTimeout)


def sticky_split(stream: DataFrame, label: str, group: str, path: str, checkpoint: str, share: float = 0.2, seed: int = 0) -> DataFrame:
    """Work through all that the stream has and return (label, group, split, n): each group's split, decided when it first appears and never changed.

    Groups that a batch brings first are held out in the order of their hash,
    as long as their class holds less than its rounded share of the rows that
    came with such groups, of this and all earlier batches. Decisions of a
    batch are a folder of the table at path, so a repeated batch replaces its
    own. What is kept of a class is its two counts.
    """
    spark = stream.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        new = batch.where("first").select(label, group, "n")
        before = _decisions(spark, path, new).where(F.col("batch") < number)
        counts = before.groupBy(label).agg(F.sum(F.when(F.col("split") == "held_out", F.col("n")).otherwise(0)).alias("__held"), F.sum("n").alias("__total"))
        w = Window.partitionBy(label)
        h = T.md5_int(F.lit(seed), F.col(group))
        so_far = F.coalesce(F.sum("n").over(w.orderBy(h, group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.coalesce("__held", F.lit(0))
        target = F.bround((F.sum("n").over(w) + F.coalesce("__total", F.lit(0))) * F.lit(share))
        split = F.when(so_far < target, "held_out").otherwise("dev")
        new.join(F.broadcast(counts), label, "left").select(label, group, split.alias("split"), "n").write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = group_counts(stream, label, group).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return _decisions(spark, path, stream.select(label, group)).drop("batch")


def _decisions(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    label, group = like.columns[:2]
    schema = f"`{label}` {like.schema[label].dataType.simpleString()}, `{group}` {like.schema[group].dataType.simpleString()}, split string, n long, batch int"
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)
