"""Near-duplicate documents by ProbMinHash, banding and exact verification.

A document's shingles of five words are weighted by 1 + ln(occurrences). Each
shingle is a Poisson process whose rate is its weight: its arrivals, functions
of the shingle alone, each fall on one of the signature's registers, and a
register keeps the shingle that arrives first. A shingle stops as soon as its
next arrival is later than all registers, so a text costs about its number of
shingles. Two registers agree with the probability Jaccard similarity of the
two texts, which bands of registers turn into candidates.

Equal texts are one node. Texts that share a band are candidates, and every
pair of candidates is settled on its exact probability Jaccard, in two steps:
each text against the earliest of its bucket, which settles nearly all of a
group of copies in linear work; then, in those buckets whose other texts still
aren't all of one class, all pairs between different classes. For these, large
blocks are dealt into parts and every pair of parts with different classes is a
task of its own. So no link between candidates is lost, no task gets more than
two parts, and a group of copies that agree with their earliest costs no pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import HOT, components, same, ship, sieved, spread_join, stage

#: Words of a shingle and the similarity of near duplicates.
SHINGLE, SIMILAR = 5, 0.8
#: 24 bands of 5 registers: a pair at 0.8 shares a band with probability 0.9999.
BANDS, ROWS = 24, 5
#: What a text has a word by, as kernel.WORD splits it.
SOME_WORD = r"[0-9A-Za-z]|[^\x00-\x7F]"
#: A part of a large block, or of the texts that meet one centre: so many texts and bytes of text at most, on average.
PART_TEXTS, PART_BYTES = 512, 4 << 20


def weighted(block: kernel.Block, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text no., shingle, weight) of the distinct shingles of each text, ordered by text no."""
    doc, h = block.shingles(k)
    bits = max(1, int(block.n).bit_length())
    key = (doc.astype(np.uint64) << np.uint64(64 - bits)) | (h >> np.uint64(bits))
    key, count = np.unique(key, return_counts=True)
    return (key >> np.uint64(64 - bits)).astype(np.int64), (key << np.uint64(bits)) >> np.uint64(20), 1 + np.log(count)


def signatures(n: int, doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """(n, m) ids of the shingle that arrives first in each register; 0 in those of texts without shingles."""
    first = np.full(n * m, np.inf)
    ids = np.zeros(n * m, dtype=np.uint64)
    latest = np.full(n, np.inf)
    x = np.zeros(len(doc))
    seed = kernel.mix(shingle + np.uint64(0x51AFD7ED558CCD25))
    turn = 0
    while len(doc):
        turn += 1
        r = kernel.mix(seed + np.uint64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        x = x - np.log(((r >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52) / weight
        at = doc * m + (kernel.mix(r) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, at, x)
        won = first[at] == x
        ids[at[won]] = shingle[won]
        hit = np.unique(doc)
        latest[hit] = first.reshape(n, m)[hit].max(axis=1)
        on = x < latest[doc]
        doc, shingle, weight, x, seed = doc[on], shingle[on], weight[on], x[on], seed[on]
    return ids.reshape(n, m)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two (sorted shingles, weights)."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = a[1][i], b[1][j]
    only_a, only_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    ratio = y / x
    order = np.argsort(ratio, kind="stable")
    xs, ys, r = x[order], y[order], ratio[order]
    low = np.searchsorted(r, r, "right")
    cx, cy = np.concatenate(([0], np.cumsum(xs))), np.concatenate(([0], np.cumsum(ys)))
    return float((1 / ((cx[low] + only_a) / xs + (cy[-1] - cy[low] + only_b) / ys)).sum())


def sketch(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, n_bytes, bands array<long>) for each row with at least one word."""
    ship(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("n_bytes", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def each(batches):
        for batch in batches:
            for at, block in kernel.blocks(batch.column(2), kernel.WORD):
                doc_no, shingle, weight = weighted(block)
                ids = signatures(block.n, doc_no, shingle, weight)
                has = np.flatnonzero(block.counts > 0)
                g = np.zeros((len(has), BANDS), dtype=np.uint64)
                for r in range(ROWS):
                    g = kernel.mix(g * np.uint64(0x9E3779B97F4A7C15) + ids[has].reshape(len(has), BANDS, ROWS)[:, :, r])
                g = kernel.mix(g + np.arange(BANDS, dtype=np.uint64)[None, :]).view(np.int64)
                take = pa.array(has + at)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * BANDS), pa.array(g.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(np.diff(block.starts)[has]), bands], schema=schema)

    slim = docs.select(F.col(doc).cast("long").alias("doc_id"), F.md5(text).alias("digest"), F.col(text).alias("text"))
    return slim.mapInArrow(each, "doc_id long, digest string, n_bytes long, bands array<long>")


def near_classes(docs: DataFrame, doc: str = "doc_id", text: str = "text", threshold: float = SIMILAR) -> DataFrame:
    """(doc_id, digest, copies, class_id, class_digest, n_texts): one row for each distinct (doc_id, digest) of docs.

    copies counts the repeated rows; class_digest is the text of class_id.
    A class holds texts that are equal or linked by similarities of at least
    the threshold; class_id is its least doc_id, n_texts its distinct texts.
    digest is the text's MD5. Texts without any word, the empty one too, are
    alike only if equal; a null text is alike to none, so its class_id is its
    own doc_id. Rows with a null doc_id are classed too; a class of such rows
    only has a null id. Very long texts are compared whole. An empty table has
    no rows. Other columns aren't read, so none of them can clash.
    """
    rows = stage(docs.select(F.col(doc).cast("long").alias("doc_id"), F.md5(text).alias("digest"), F.col(text).rlike(SOME_WORD).alias("words")).groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies"), F.max("words").alias("words")))
    sk = stage(sketch(docs, doc, text))
    # Equal texts have equal sketches: one node for each text, numbered once and for all as its table is written.
    first = sk.groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("n_bytes").alias("n_bytes"), F.first("bands").alias("bands"))
    nodes = stage(first.withColumn("node", F.monotonically_increasing_id()))

    comps = components(links(docs, doc, text, nodes, threshold, bool(rows.where("copies > 1").limit(1).count())))
    named = stage(nodes.select("digest", "node", "least").join(comps, "node", "left").select("digest", "least", F.coalesce("comp", "node").alias("comp")))
    first_of = F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least"), F.col("digest"))).alias("k")
    ids = named.groupBy("comp").agg(first_of, F.count("digest").alias("n_texts"))
    by_digest = spread_join(named, ids, ["comp"]).select("digest", F.col("k.least").alias("class_id"), F.col("k.digest").alias("class_digest"), "n_texts")
    # Texts without words have no node.
    some = rows.where("digest IS NOT NULL")
    bare_ids = some.where("NOT words").groupBy("digest").agg(F.min("doc_id").alias("class_id")).select("digest", "class_id", F.col("digest").alias("class_digest"), F.lit(1).cast("long").alias("n_texts"))
    known = spread_join(some, stage(by_digest.unionByName(bare_ids)), ["digest"])
    null = rows.where("digest IS NULL").select("digest", "doc_id", "copies", F.col("doc_id").alias("class_id"), F.col("digest").alias("class_digest"), F.lit(1).cast("long").alias("n_texts"))
    return known.drop("words").unionByName(null).select("doc_id", "digest", "copies", "class_id", "class_digest", "n_texts")


def links(docs: DataFrame, doc: str, text: str, nodes: DataFrame, threshold: float, repeated: bool) -> DataFrame:
    """(a, b): links of at least the threshold between nodes that share a band, enough to connect all that such links connect."""
    each = nodes.select("node", "least", F.explode("bands").alias("bucket"))
    sizes = stage(each.groupBy("bucket").agg(F.min(F.struct("least", "node")).alias("k"), F.count("node").alias("n")).where("n > 1").select("bucket", F.col("k.node").alias("centre"), "n"))
    frequent = sizes.where(F.col("n") > max(100, nodes.count() * BANDS / HOT)).select("bucket").collect()  # HOT at most
    hot = docs.sparkSession.createDataFrame(frequent, "bucket long") if frequent else None
    held = each.select("node", "bucket")
    held = stage(spread_join(held, sizes.select("bucket", "centre"), ["bucket"], hot) if hot is not None else held.join(sizes.select("bucket", "centre"), "bucket"))
    texts = stage(_texts(docs, doc, text, nodes, held.select("node").distinct(), repeated))

    # Each text against the earliest of its buckets; one centre's texts are dealt into parts.
    edges = stage(held.where("node <> centre").select("node", F.col("centre").alias("key")).distinct())
    parts = edges.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / PART_TEXTS).cast("int").alias("parts"))
    dealt = stage(spread_join(edges, parts, ["key"]).select("node", "key", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")))
    centres = dealt.select(F.col("key").alias("node"), "key", "part").distinct()
    by = F.struct("key", "part", F.lit(0).alias("other")).alias("task")
    asked = dealt.select("node", by, F.lit(0).alias("side"), F.col("node").alias("label")).unionByName(centres.select("node", by, F.lit(1).alias("side"), F.col("node").alias("label")))
    stars = stage(_settled(asked, texts, threshold))

    # What other members of a bucket are still of different classes.
    labels = components(stars)
    named = lambda df: df.join(labels, "node", "left").withColumn("label", F.coalesce("comp", "node")).drop("comp")
    others = stage(named(held.where("node <> centre").select("node", "bucket")))
    open_ = others.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("node").alias("centre")).where("lo < hi").select("bucket", "centre")
    left = stage(spread_join(others, open_, ["bucket"], hot) if hot is not None else others.join(open_, "bucket"))
    blocks = components(stage(left.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()))
    return stars.unionByName(_settled(_tasks(stage(named(blocks.withColumnRenamed("comp", "block"))), texts), texts, threshold))


def _texts(docs: DataFrame, doc: str, text: str, nodes: DataFrame, wanted: DataFrame, repeated: bool) -> DataFrame:
    """(node, n_bytes, text) of the wanted nodes."""
    mine = stage(nodes.join(wanted, "node").select("node", "least", "digest", "n_bytes"))
    source = docs.select(F.col(doc).cast("long").alias("least"), F.md5(text).alias("digest"), F.col(text).alias("text"))
    spot = F.xxhash64("least", "digest")  # of copies only the row that stands for the text passes the sieve
    rows = sieved(source.where(F.col("digest").isNotNull()).withColumn("__spot", spot), mine.withColumn("__spot", spot), "__spot").drop("__spot")
    out = same(rows, mine, ["least", "digest"]).select("node", "n_bytes", "text")
    return out.dropDuplicates(["node"]) if repeated else out  # the same doc_id and text in several rows


def _tasks(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, task, side, label): each pair of parts of a block that hold different labels, and each part with several.

    Labels of many texts have parts of their own, which needn't meet each other; the rest of a block shares parts.
    """
    sized = placed.join(texts.select("node", "n_bytes"), "node")
    parts = lambda: F.ceil(F.greatest(F.count("node") / PART_TEXTS, F.sum("n_bytes") / PART_BYTES)).cast("int")
    sized = stage(sized)
    per = sized.groupBy("block", "label").agg(parts().alias("own"), F.count("node").alias("n"))
    big = stage(per.where("own > 1").select("block", "label", "own"))
    of_own = stage(sized.join(big, ["block", "label"], "left"))
    pool = of_own.where("own IS NULL").groupBy("block").agg(parts().alias("pool"))
    shared = spread_join(stage(of_own.where("own IS NULL").drop("own")), pool, ["block"])
    at = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int").alias("part")
    dealt = of_own.where("own IS NOT NULL").select("node", "block", "label", F.col("label").alias("own"), at("own")).unionByName(shared.select("node", "block", "label", F.lit(-1).cast("long").alias("own"), at("pool")))
    dealt = stage(dealt)
    p = dealt.select("block", "own", "part").distinct()
    q = p.select("block", F.col("own").alias("own2"), F.col("part").alias("part2"))
    first, second = F.struct("own", "part"), F.struct(F.col("own2").alias("own"), F.col("part2").alias("part"))
    pairs = p.join(q, "block").where((first <= second) & ((F.col("own") != F.col("own2")) | (F.col("own") < 0)))
    pairs = stage(pairs.withColumn("task", F.struct(F.monotonically_increasing_id().alias("key"), F.lit(0).alias("part"), (first != second).cast("int").alias("other"))))
    sides = pairs.select("block", "own", "part", "task", F.lit(0).alias("side")).unionByName(pairs.where("task.other = 1").select("block", F.col("own2").alias("own"), F.col("part2").alias("part"), "task", F.lit(1).alias("side")))
    return dealt.join(sides, ["block", "own", "part"]).select("node", "task", "side", "label")


def _settled(asked: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links that connect what the tasks' pairs connect. asked: (node, task, side, label).

    The pairs of a task are those between its sides, or within side 0 if it has
    no other, of different labels. Small tasks share a group.
    """
    rows = stage(asked.join(texts, "node"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("b")).first()
    groups = max(1, size["n"] // PART_TEXTS, size["b"] // PART_BYTES)

    def each(table):
        a, b = [], []
        key = np.stack([table["task"].combine_chunks().field(x).to_numpy(zero_copy_only=False) for x in ("key", "part")], axis=1)
        node, side, label = (table[x].to_numpy() for x in ("node", "side", "label"))
        sets = _sets(table["text"])
        order = np.lexsort((node, side, key[:, 1], key[:, 0]))
        cut = np.flatnonzero(np.any(np.diff(key[order], axis=0, prepend=key[order][:1] - 1) != 0, axis=1))
        for s, e in zip(cut, [*cut[1:], len(order)], strict=True):
            i = order[s:e]
            x, y = _forest(node[i], side[i], label[i], [sets[k] for k in i], threshold)
            a += x
            b += y
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.withColumn("g", F.pmod(F.xxhash64("task.key", "task.part"), F.lit(groups))).groupBy("g").applyInArrow(each, "a long, b long")


def _sets(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sorted shingles, weights) of each text."""
    sets = []
    for _, block in kernel.blocks(column, kernel.WORD):
        d, s, w = weighted(block)
        cut = np.searchsorted(d, np.arange(block.n + 1))
        for i in range(block.n):
            x, y = s[cut[i] : cut[i + 1]], w[cut[i] : cut[i + 1]]
            o = np.argsort(x)
            sets.append((x[o], y[o]))
    return sets


def _forest(node: np.ndarray, side: np.ndarray, label: np.ndarray, sets: list, threshold: float) -> tuple[list[int], list[int]]:
    """Links that connect what links between the sides, or within the one side, connect.

    Two texts can't be more similar than the sum of the smaller of their shares
    in each shingle, which an index of all shingles gives for a text and all
    others at once; only pairs for which this reaches the threshold are compared.
    """
    n = len(node)
    two = side[-1] != side[0]
    size = np.array([len(s[0]) for s in sets])
    shingle, text = np.concatenate([s[0] for s in sets]), np.repeat(np.arange(n), size)
    share = np.concatenate([s[1] / s[1].sum() for s in sets])
    by = np.argsort(shingle, kind="stable")
    held, text, share_of = shingle[by], text[by], share[by]
    _, root = np.unique(label, return_inverse=True)
    start = np.cumsum(size) - size
    a, b = [], []
    for i in range(n):
        if two and side[i]:
            break
        x = sets[i][0]
        lo, hi = np.searchsorted(held, x), np.searchsorted(held, x, "right")
        m = hi - lo
        at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo, m)
        most = np.bincount(text[at], np.minimum(share_of[at], np.repeat(share[start[i] : start[i] + size[i]], m)), n)
        most[: i + 1] = 0
        for j in np.flatnonzero((most >= threshold - 1e-9) & (root != root[i]) & ((side != side[i]) if two else True)):
            if root[i] != root[j] and similarity(sets[i], sets[j]) >= threshold:
                a.append(int(node[i]))
                b.append(int(node[j]))
                root[root == root[j]] = root[i]
    return a, b


def keep_one(docs: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """docs with one document of each class, that with the least doc_id; of repeated rows one stays.

    Null texts all stay, and so does one of each class of rows without an id.
    Texts without a word, the empty one too, are copies only if equal. All
    columns stay, whatever their names.
    """
    kept = stage(near_classes(docs.select("doc_id", "text"), threshold=threshold).where("doc_id <=> class_id AND digest = class_digest").select("doc_id", F.col("digest").alias("__digest"), F.col("copies").alias("__copies")))
    cols = [F.col(f"`{c}`") for c in docs.columns]
    keep = same(docs.where("text IS NOT NULL").withColumn("__digest", F.md5("text")), kept, ["doc_id", "__digest"])
    out = keep.where("__copies = 1").select(*cols).unionByName(docs.where("text IS NULL").select(*cols))
    if kept.where("__copies > 1").limit(1).count():
        out = out.unionByName(keep.where("__copies > 1").dropDuplicates(["doc_id", "__digest"]).select(*cols))
    return out


def brute(texts: dict[int, str], threshold: float = SIMILAR) -> dict[int, int]:
    """The classes of a few texts by comparing all pairs in plain Python, for tests."""
    import re
    from collections import Counter

    def bag(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda x: x[0].lower(), t))
        c = Counter(tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))) if w else {}
        return {k: 1 + math.log(v) for k, v in c.items()}

    bags = {k: bag(t) for k, t in texts.items()}
    root = {k: k for k in texts}
    for a in texts:
        for b in texts:
            if a < b and root[a] != root[b]:
                x, y = bags[a], bags[b]
                j = sum(1 / sum(max(x.get(k, 0) / x[i], y.get(k, 0) / y[i]) for k in x.keys() | y.keys()) for i in x.keys() & y.keys())
                if texts[a] == texts[b] or j >= threshold:
                    lo, hi = sorted((root[a], root[b]))
                    root = {k: lo if v == hi else v for k, v in root.items()}
    return root
