"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same expected number of copies, the
source's target over its size: a whole part, and a fraction that is rounded so
that the source's words stay what they are. In a leaf of some documents two
fractional ones at a time are paired and words are moved at random from one to
the other until one is integral, with odds that keep both expectations. Each
leaf leaves at most one fraction; these are combined by the same step in a
reduction tree over the leaves of a source, level by level. What is taken from
a source so differs from its target by less than one document.

All of it are DataFrame expressions: leaves and tree nodes are groups of a
bounded number of rows, so a source with most of the rows is many leaves.
Random numbers are hashes of the paired documents, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, ranked, same, stage, unit

#: Weights of the sources in order, repeating, and the most copies of a document.
WEIGHTS, MOST_COPIES = (5.0, 2.0, 1.0), 3.0
#: Documents of a leaf and residuals of a tree node, on average.
LEAF = 64
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def targets(units: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """(source, n, source_size, target, whole, part) from units (source, size, n).

    Sources are weighed in the order of their code points, null last. Targets
    share the sum of all sizes by weight; none is above `most` times its
    source's size, and the excess is shared by weight among the rest, until
    none is above. The level of the rest is found by one aggregate over the
    sources a round. whole and part are the copies of each document.
    """
    sources = units.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    at = F.pmod(F.col("rank"), F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at + 1).cast("int"))
    table = stage(ranked(sources, [F.col("source").asc_nulls_last()]).select("source", "n", "source_size", weight.alias("weight")))
    total = table.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    size, level, capped = float(total["s"] or 0), 0.0, -1
    if size:
        level = size / total["w"]
        while True:
            over = F.col("source_size") * most < F.col("weight") * level
            r = table.agg(F.count_if(over).alias("k"), F.sum(F.when(over, F.col("source_size"))).alias("s"), F.sum(F.when(~over, F.col("weight"))).alias("w")).first()
            if r["k"] == capped or not r["w"]:
                break
            capped, level = r["k"], (size - most * (r["s"] or 0)) / r["w"]
    cap = F.col("source_size") * most
    over = cap <= F.col("weight") * level
    rate = F.when(F.col("source_size") == 0, 0.0).when(over, most).otherwise(F.col("weight") * level / F.col("source_size"))
    return table.select("source", "n", "source_size", F.when(over, cap).otherwise(F.col("weight") * level).cast("double").alias("target"), F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("part"))


_ITEM = "struct<h:bigint,doc_id:{id},digest:bigint,size:bigint,n:bigint,whole:bigint,p:double,extra:int>"


def _pivot(left: Column, right: Column, seed: int) -> Column:
    """(decided, rest) of two items: words move until one is integral."""

    def odds(_):
        si, sj = left["size"] * left["n"], right["size"] * right["n"]
        return F.struct(
            ((1 - left["p"]) * si).alias("up_i"), (right["p"] * sj).alias("down_j"), (left["p"] * si).alias("down_i"), ((1 - right["p"]) * sj).alias("up_j"),
            unit(left["h"], right["h"], left["digest"], right["digest"], F.lit(seed)).alias("u"), si.alias("si"), sj.alias("sj"),
        )

    def step(o):
        a, b = F.least(o["up_i"], o["down_j"]), F.least(o["down_i"], o["up_j"])
        to_left = o["u"] * (a + b) < b
        clip = lambda p: F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))
        done = lambda x, e: x.withField("extra", F.lit(e))
        moved = lambda x, p: x.withField("p", clip(p))
        pair = lambda d, r: F.struct(d.alias("decided"), r.alias("rest"))
        return (
            F.when(to_left & (o["up_i"] <= o["down_j"]), pair(done(left, 1), moved(right, right["p"] - a / o["sj"])))
            .when(to_left, pair(done(right, 0), moved(left, left["p"] + a / o["si"])))
            .when(o["down_i"] <= o["up_j"], pair(done(left, 0), moved(right, right["p"] + b / o["sj"])))
            .otherwise(pair(done(right, 1), moved(left, left["p"] - b / o["si"])))
        )

    return let(odds(None), step)


def _fold(items: Column, kind: str, seed: int) -> Column:
    """struct(rest, decided) of a bounded array of items, in the array's order."""
    start = F.struct(F.lit(None).cast(kind).alias("rest"), F.array().cast(f"array<{kind}>").alias("decided"))

    def merge(acc, x):
        both = lambda r: F.struct(r["rest"].alias("rest"), F.concat(acc["decided"], F.array(r["decided"])).alias("decided"))
        return F.when(acc["rest"].isNull(), F.struct(x.alias("rest"), acc["decided"].alias("decided"))).otherwise(let(_pivot(acc["rest"], x, seed), both))

    return F.aggregate(items, start, merge)


def mix(units: DataFrame, seed: int = 11, leaf: int = LEAF, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """units (doc_id, source, digest, size, n) with source_size, target and copies.

    A unit stands for n equal rows, each of which gets the same copies.
    Documents without words have the whole copies of their source.
    """
    per_source = stage(targets(units, weights, most))
    id_type = units.schema["doc_id"].dataType.simpleString()
    kind = _ITEM.format(id=id_type)
    rows = same(units, per_source.select("source", F.col("n").alias("in_source"), "whole", "part"), ["source"])
    settled = (F.col("size") == 0) | (F.col("part") <= 0)
    h = F.xxhash64("doc_id", "digest", F.lit(seed))
    item = F.struct(h.alias("h"), "doc_id", "digest", "size", "n", "whole", F.col("part").alias("p"), F.lit(0).alias("extra")).cast(kind)
    leaves = F.ceil(F.col("in_source") / leaf)
    node = F.pmod(F.xxhash64("digest", "doc_id", F.lit(seed + 1)), leaves)
    open_ = rows.where(~settled).select("source", node.alias("node"), item.alias("item"))
    out = rows.where(settled).select("source", item.alias("item"))
    levels = per_source.agg(F.max(F.ceil(F.col("n") / leaf)).alias("k")).first()["k"] or 1
    depth = 0
    while True:
        folded = open_.groupBy("source", "node").agg(F.array_sort(F.collect_list("item")).alias("items")).select("source", "node", _fold(F.col("items"), kind, seed + depth).alias("f"))
        folded = stage(folded.select("source", "node", F.col("f.rest").alias("rest"), F.col("f.decided").alias("decided")))
        out = out.unionByName(folded.select("source", F.explode("decided").alias("item")))
        open_ = folded.select("source", F.floor(F.col("node") / leaf).alias("node"), F.col("rest").alias("item"))
        if levels <= 1:
            break
        levels, depth = -(-levels // leaf), depth + 1
    last = F.col("item").withField("extra", (unit("item.h", F.lit(seed + 99)) < F.col("item.p")).cast("int"))
    out = out.unionByName(open_.select("source", last.alias("item")))
    flat = out.select("source", "item.doc_id", "item.digest", "item.size", "item.n", (F.col("item.whole") + F.col("item.extra")).alias("copies"))
    return same(flat, per_source.select("source", "source_size", "target"), ["source"])


def units_of(docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, digest, size, n): the distinct rows of docs and how often each is there. A null text has no words."""
    slim = docs.select(F.col(doc).alias("doc_id"), F.col(source).alias("source"), F.xxhash64(text).alias("digest"), word_count(text).alias("size"))
    return slim.groupBy("doc_id", "source", "digest", "size").agg(F.count(F.lit(1)).alias("n"))


def mixed(docs: DataFrame, seed: int = 11) -> DataFrame:
    """docs in the mix: each row as often as its copies, none for 0.

    A null source is a source of its own. Texts that are null, empty or without
    a word have the whole copies of their source; a very long text counts with
    all its words. Repeated rows have the same copies each. All columns stay,
    whatever their names; an empty table has no rows.
    """
    copies = mix(stage(units_of(docs)), seed).where("copies > 0").select("doc_id", "source", F.col("digest").alias("__digest"), F.col("copies").alias("__copies"))
    rows = same(docs.withColumn("__digest", F.xxhash64("text")), copies, ["doc_id", "source", "__digest"])
    return rows.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
