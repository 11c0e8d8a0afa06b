"""Near-duplicate documents by SimHash fingerprints and the pigeonring filter.

A fingerprint's 64 bits are a ring of eight segments. If two fingerprints
differ in at most two bits, then from one of the eight segments on every chain
of consecutive segments keeps to its share of these two: the differences in its
first l segments are at most 2 l / 8. So its first three segments are equal,
and the first seven differ in one bit at most. Each fingerprint is dealt to
eight buckets, by its first three segments from each of the segments on; pairs
of a bucket are pruned by the budgets of longer chains, and what is left is
compared whole.

No bucket is compared pair by pair once that costs more than the exact way in
linear work: of two fingerprints that differ in at most two bits one is the
other, or with one bit flipped the other or the other with one bit flipped; so
each member is listed with the flips of the bits outside the bucket's key, and
equal entries link. A bucket of more than MOST fingerprints is listed over many
tasks, by entry. Equal fingerprints are one node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, discard, hot_keys, ship, spread_join, stage

#: Words of a shingle, seed of its hash, and bits that linked fingerprints differ in at most.
SHINGLE, SEED, DIFFER = 3, 42, 2
#: Segments, their bits, and how many of a chain must be equal: the most whose share of DIFFER is below 1.
SEGMENTS, BITS, EQUAL = 8, 8, 3
#: From so many members on a bucket is listed with flips in place of pairs: these are more than 40 flips a member then.
PAIRS_UP_TO = 82
#: Fingerprints of a bucket that one task handles, and of all buckets of a task, on average.
MOST, PER_TASK = 20_000, 60_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_KEY = (1 << EQUAL * BITS) - 1


def fingerprint(text: bytes) -> int:
    """Of a text in UTF-8, unsigned; 0 without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    k = min(SHINGLE, len(words))
    of = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)
    h = np.fromiter((of(joined[s:e], SEED) for s, e in spans), np.uint64, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long) for each row of docs; fp is the fingerprint as a signed number, 0 for null texts and such without words."""
    ship(docs.sparkSession)
    kind = docs.schema[doc].dataType.simpleString()

    def each(batches):
        for batch in batches:
            made = [fingerprint(t.as_py()) if t.is_valid else 0 for t in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(made, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).mapInArrow(each, f"doc_id {kind}, fp long")


def buckets(nodes: DataFrame) -> DataFrame:
    """(at, r, key): each fp of nodes turned so that segment `at` comes first, for all segments; key is its first EQUAL segments."""
    fp, by = F.col("fp"), F.col("at") * BITS
    turned = F.call_function("shiftrightunsigned", fp, by).bitwiseOR(F.call_function("shiftleft", fp, 64 - by))  # by 0: both are fp
    return nodes.select("fp", F.explode(F.array(*map(F.lit, range(SEGMENTS)))).alias("at")).select("at", turned.alias("r")).withColumn("key", F.col("r").bitwiseAND(_KEY))


def _turned_back(r: np.ndarray, at: np.ndarray) -> np.ndarray:
    by = (at * BITS).astype(np.uint64)
    return (r << by) | (r >> ((np.uint64(64) - by) & np.uint64(63)))


def _linked(at: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): members of the same bucket that differ in at most DIFFER bits, or pairs that connect the same. r: unsigned, in any order."""
    order = np.lexsort((r, r & np.uint64(_KEY), at))
    at, r = at[order], r[order]
    new = np.ones(len(r), bool)
    new[1:] = (at[1:] != at[:-1]) | ((r[1:] ^ r[:-1]) & np.uint64(_KEY) != 0)
    bucket = np.cumsum(new) - 1
    size = np.bincount(bucket)[bucket]
    a, b = [], []
    few = np.flatnonzero((size > 1) & (size < PAIRS_UP_TO))
    i = few
    for step in range(1, PAIRS_UP_TO):
        i = i[i + step < len(r)]
        i = i[bucket[i] == bucket[i + step]]
        if not len(i):
            break
        x, ok = r[i] ^ r[i + step], np.arange(len(i))
        for chain in range(EQUAL + 1, SEGMENTS + 1):  # the chain's budget is its share of DIFFER
            ok = ok[np.bitwise_count(x[ok] & np.uint64((1 << chain * BITS) - 1)) <= chain * DIFFER // SEGMENTS]
        a.append(i[ok])
        b.append(i[ok] + step)
    many = np.flatnonzero(size >= PAIRS_UP_TO)
    for s, e in zip(many[np.flatnonzero(np.diff(bucket[many], prepend=-1))], many[np.flatnonzero(np.diff(bucket[many], append=-1))] + 1, strict=True) if len(many) else ():
        flips = np.concatenate(([0], np.uint64(1) << np.arange(EQUAL * BITS, 64, dtype=np.uint64))).astype(np.uint64)
        entry = (r[s:e, None] ^ flips[None, :]).ravel()
        member = np.repeat(np.arange(s, e), len(flips))
        by = np.argsort(entry, kind="stable")
        entry, member = entry[by], member[by]
        same = entry[1:] == entry[:-1]
        a.append(member[:-1][same])
        b.append(member[1:][same])
    if not a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a, b = _forest(np.concatenate(a), np.concatenate(b))
    return _turned_back(r[a], at[a]), _turned_back(r[b], at[b])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs without those whose ends are connected already."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(i)
    return a[kept], b[kept]


def links(nodes: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b): pairs of distinct fingerprints (fp) that connect all that differ in at most DIFFER bits."""
    rows = buckets(nodes)
    n = nodes.count() * SEGMENTS
    groups = max(1, n // PER_TASK)
    rows = rows.withColumn("g", F.pmod(F.xxhash64("at", "key"), F.lit(groups)))
    # Only a task of very many fingerprints can hold a large bucket.
    full = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    large = stage(rows.join(full.select("g"), "g", "left_semi").groupBy("at", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("at", "key"))
    some = bool(large.limit(1).count())

    def each(table):
        a, b = _linked(table["at"].to_numpy(), table["r"].to_numpy().view(np.uint64))
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    rest = rows.join(large, ["at", "key"], "left_anti") if some else rows
    found = rest.groupBy("g").applyInArrow(each, "a long, b long")
    if not some:
        return found
    # By entry: a member itself, or with one of the bits beyond the key flipped.
    fp = F.call_function("shiftleft", F.col("r"), F.col("at") * BITS).bitwiseOR(F.call_function("shiftrightunsigned", F.col("r"), 64 - F.col("at") * BITS))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)) for b in range(EQUAL * BITS, 64)])
    listed = rows.join(large, ["at", "key"]).select("at", fp.alias("a"), F.explode(F.transform(flips, lambda f: F.col("r").bitwiseXOR(f))).alias("entry"))
    least = listed.groupBy("at", "entry").agg(F.min("a").alias("b"), F.count("a").alias("n")).where("n > 1")
    return found.unionByName(listed.join(least, ["at", "entry"]).where("a <> b").select("a", "b"))


def near_classes(docs: DataFrame, doc: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """(doc_id, fp long, component_id): one row for each row of docs.

    Fingerprints that differ in at most DIFFER bits link; component_id is the
    least doc_id that links reach, null if all that are reached are null. Null
    texts and such without words have the fingerprint 0 and link like others.
    Rows with a null id, and repeated rows, each have their row. Very long texts
    are read whole. An empty table has no rows. Other columns aren't read, so
    none can clash.
    """
    rows = stage(fingerprints(docs, doc, text))
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = stage(links(nodes, most))
    comps = components(found)
    named = stage(nodes.join(comps, nodes.fp == comps.node, "left").select("fp", "least", F.coalesce("comp", "fp").alias("comp")))
    ids = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_fp = stage(spread_join(named.select("fp", "comp"), ids, ["comp"]).select("fp", "component_id"))
    discard(found, named)
    return spread_join(rows, by_fp, ["fp"], hot_keys(rows, ["fp"])).select("doc_id", "fp", "component_id")


def hexed(fp: str) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def brute(texts: dict[int, str | None]) -> dict[int, tuple[str, int]]:
    """Fingerprints and components of a few texts by comparing all pairs in plain Python, for tests."""
    import re

    prints = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        h = [xxhash.xxh64(" ".join(w[i : i + SHINGLE]).encode(), seed=SEED).intdigest() for i in range(max(1, len(w) - SHINGLE + 1))] if w else []
        prints[k] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {k: k for k in texts}
    for a in texts:
        for b in texts:
            if a < b and root[a] != root[b] and (prints[a] ^ prints[b]).bit_count() <= DIFFER:
                lo, hi = sorted((root[a], root[b]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    return {k: (f"{prints[k]:016x}", root[k]) for k in texts}
