"""Sharding by minimax contiguous partition of atomic groups.

Documents with equal texts are one atomic group. Groups stand in the order of
their text's hash. The smallest capacity at which a greedy walk along that
order needs no more than the given shards is found by binary search, and the
order is cut there. A group of more than an even share stands first, largest
first, and fills a shard of its own: no cut could make the largest shard smaller.

The driver never holds the groups. It walks a tree of sums by hash prefix, of
which it opens only the nodes that a cut may fall into; below a node of few
groups it reads these. Shards follow from a document's hash and the cuts alone,
so documents aren't shuffled to be assigned.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Groups that the driver reads at once, and hex digits by which a node of the tree is opened.
OPEN_GROUPS, DIGITS = 4096, 3


def size_of(text: str = "text") -> Column:
    """UTF-8 bytes plus 1; 1 for null."""
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long")


def key_of(doc: str = "doc_id", text: str = "text") -> Column:
    """The text's hash. Null texts equal none: theirs is that of the id."""
    return F.coalesce(F.sha2(F.col(text), 256), F.sha2(F.concat(F.lit("null:"), F.coalesce(F.col(doc).cast("string"), F.lit(""))), 256))


class _Sums:
    """Prefix sums over the groups in order, opened where they are asked for."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        self.open: dict[str, tuple[list[str], list[int], list[int]]] = {}

    def _node(self, prefix: str, few: bool) -> tuple[list[str], list[int], list[int]]:
        if prefix not in self.open:
            part = self.groups.where((F.col("key") >= prefix) & (F.col("key") < prefix + "g")) if prefix else self.groups
            if few:
                rows = part.select("key", "bytes", F.lit(1).alias("n")).orderBy("key").collect()
            else:
                rows = part.groupBy(F.substring("key", 1, len(prefix) + DIGITS).alias("key")).agg(F.sum("bytes").alias("bytes"), F.count("key").alias("n")).orderBy("key").collect()
            self.open[prefix] = ([r["key"] for r in rows], list(accumulate((r["bytes"] for r in rows), initial=0)), [r["n"] for r in rows])
        return self.open[prefix]

    def cut(self, at: int) -> tuple[int, str]:
        """The largest prefix sum up to at, and a string that no key before that cut is above and all after are; (0, "") before the first."""
        below, prefix, few, last = 0, "", False, ""
        while True:
            keys, sums, counts = self._node(prefix, few)
            i = bisect_right(sums, at - below) - 1
            if i:
                last = keys[i - 1] + ("" if few else "g")  # beyond all hex digits
            below += sums[i]
            if few or i == len(keys) or counts[i] == 1:
                return below, last
            prefix, few = keys[i], counts[i] <= OPEN_GROUPS

    def coarse(self, shards: int, total: int) -> tuple[int, int]:
        """A capacity that suffices, from the first level alone, and how far it may be above the smallest."""
        _, sums, _ = self._node("", False)
        most = max((y - x for x, y in zip(sums, sums[1:], strict=False)), default=0)

        def fits(c: int) -> bool:
            at = 0
            for _ in range(shards):
                at = sums[bisect_right(sums, at + c) - 1]
            return at >= total

        low, high = max(most, -(-total // shards)), total
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if fits(mid) else (mid + 1, high)
        return low, most


class Plan:
    """Where the shards begin: giant groups by key, and the last keys of the others."""

    def __init__(self, shards: int, giants: list[str], cuts: list[str], capacity: int):
        self.shards, self.giants, self.cuts, self.capacity = shards, giants, cuts, capacity

    def shard(self, key: Column) -> Column:
        out = F.lit(len(self.giants))
        for c in self.cuts:
            out = out + (key > c).cast("int")
        for i, g in enumerate(self.giants):
            out = F.when(key == g, F.lit(i)).otherwise(out)
        return out.cast("int")


def plan(sizes: DataFrame, shards: int = 8) -> Plan:
    """From (key, size) of all documents."""
    groups = sizes.groupBy("key").agg(F.sum("size").alias("bytes"))
    groups = stage(groups.repartitionByRange("key").sortWithinPartitions("key"))
    total = groups.agg(F.sum("bytes").alias("b")).first()["b"] or 0
    largest = groups.orderBy(F.desc("bytes"), "key").limit(shards + 1).collect()
    giants, left, rest = [], shards, total
    for r in largest:
        if left <= 1 or r["bytes"] * left < rest:
            break
        giants.append(r["key"])
        left, rest = left - 1, rest - r["bytes"]
    biggest = next((r["bytes"] for r in largest if r["key"] not in giants), 0)
    sums = _Sums(groups.where(~F.col("key").isin(giants)) if giants else groups)

    def walk(capacity: int) -> list[str] | None:
        """The cuts of a greedy walk, or None if it needs more shards."""
        at, cuts = 0, []
        for _ in range(left):
            if at + capacity >= rest:
                return cuts
            at, key = sums.cut(at + capacity)
            cuts.append(key)
        return None

    suffices, most = sums.coarse(max(1, left), rest)
    low = max(biggest, -(-rest // max(1, left)), suffices - most)
    high = max(low, suffices)
    while low < high:
        mid = (low + high) // 2
        if walk(mid) is None:
            low = mid + 1
        else:
            high = mid
    return Plan(shards, giants, walk(low) or [], low)


def numbered(rows: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """rows with slot: gapless from 0 within each value of by.

    Rows are dealt over hashed blocks within each value and moved by the block's
    offset, so no task gets a whole shard.
    """
    blocks = max(16, -(-rows.count() // (max(1, n) * 20_000)))
    dealt = rows.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    counts = dealt.groupBy(by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(by, "__b", (F.sum("__n").over(Window.partitionBy(by).orderBy("__b")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(by, "__b").orderBy(*order)).cast("long") - 1
    return dealt.withColumn("slot", inside).join(offsets, [by, "__b"]).withColumn("slot", F.col("slot") + F.col("__before")).drop("__b", "__before")


def assign(docs: DataFrame, shards: int = 8, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, key, shard, slot.

    Rows with equal texts share a shard; null texts are groups of their own and
    have the size 1 and the checksum of no bytes. Fewer groups than shards leave
    shards empty; an empty table has no rows. slot counts the rows of a shard
    from 0. Other columns aren't read, so none can clash.
    """
    crc = F.coalesce(F.crc32(F.col(text)), F.lit(0)).cast("long")
    slim = stage(docs.select(F.col(doc).alias("doc_id"), size_of(text).alias("size"), crc.alias("text_crc32"), key_of(doc, text).alias("key")))
    p = plan(slim.select("key", "size"), shards)
    return numbered(slim.withColumn("shard", p.shard(F.col("key"))), "shard", ["doc_id", "key"], shards)


def sharded(docs: DataFrame, shards: int = 8) -> DataFrame:
    """docs with shard; texts are read, not shuffled.

    A column that is named shard already stays as shard_before, all others as
    they are. Rows are placed as by assign(): equal texts together, each null
    text by itself, an empty or very long text by its bytes like any other;
    an empty table has no rows.
    """
    slim = stage(docs.select(key_of().alias("key"), size_of().alias("size")))
    p = plan(slim, shards)
    mine = [F.col(f"`{c}`").alias("shard_before" if c == "shard" else c) for c in docs.columns]
    return docs.select(*mine, p.shard(key_of()).alias("shard"))
