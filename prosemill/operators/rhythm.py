"""Rhythm of a text: series of counts in text order, and their dispersion.

The long table of series is (doc, name, pos, value): sl words of each sentence,
phg words between marks, spw syllables of each word in the lexicon, syms 1 or 0
for each syllable, stressed or not. Every feature is 0 where it is undefined.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.functions import text as T
from prosemill.operators import segment
from prosemill.sources import ship

#: Named groups of features, for reports by group.
GROUPS = {"gap_mean": "rhythm", "gap_var": "rhythm", "gap_cv": "rhythm", "stress_runlen_var": "rhythm", "stress_bin_entropy": "rhythm", "spw_mean": "syllables", "spw_var": "syllables", "spw_skew": "syllables", "sl_mean": "sentence", "sl_var": "sentence", "sl_cv": "sentence", "ph_mean": "phrase", "ph_var": "phrase", "mt_mean": "meter", "mt_var": "meter", "mattr": "lexical"}


#: Stress of words: a table (word, stress), or a rule, a function that makes a lower-case word's stress, None if it is unknown.
Lexicon = DataFrame | Callable[[str], str | None]
#: Words whose stress a task keeps.
KEPT = 1 << 18


def or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def cv(mean: Column, sd: Column) -> Column:
    return F.when(mean > 0, sd / mean).otherwise(F.lit(0.0))


def feature_groups(spark) -> DataFrame:
    """(feature, feature_group): the dimension table of the named groups."""
    return spark.createDataFrame(sorted(GROUPS.items()), "feature string, feature_group string")


def rule_lexicon(words: DataFrame, word: str = "word") -> DataFrame:
    """(word, stress) by a rule, where no pronouncing dictionary is at hand: alternating stress by vowel groups, one word in ten unknown."""
    w = words.select(F.lower(word).alias("word")).distinct().where(T.md5_int(F.col("word")) % 10 != 0)
    n = T.syllables(F.col("word"))
    stress = F.when(T.md5_int(F.col("word")) % 2 == 0, F.repeat(F.lit("10"), n)).otherwise(F.repeat(F.lit("01"), n))
    return w.select("word", F.substring(stress, F.lit(1), n).alias("stress"))


@lru_cache(KEPT)
def rule_stress(word: str) -> str | None:
    """The same rule for one lower-case word, which needs no table of them all."""
    h = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
    n = max(1, len(re.findall("[aeiouy]+", word)))
    return None if h % 10 == 0 else (("10" if h % 2 == 0 else "01") * n)[:n]


def _stress_by(rule: Callable[[str], str | None]):
    @F.arrow_udf("array<string>")
    def stress(words: pa.Array) -> pa.Array:
        flat = words.flatten().dictionary_encode()  # the rule is asked once for each distinct word of a batch
        made = pa.array([rule(w) for w in flat.dictionary.to_pylist()], pa.string())
        ends = pc.cumulative_sum(pc.list_value_length(words).cast(pa.int32()))
        return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), made.take(flat.indices))

    return stress


def stress_arrays(docs: DataFrame, lexicon: Lexicon, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with low and stress array<string>: the words in lower case and the stress of each, null for those unknown.

    A rule works on each row alone. To meet a table the words cross the network.
    """
    docs = docs.withColumn("low", F.transform(T.words(F.coalesce(F.col(text), F.lit(""))), F.lower))
    if not isinstance(lexicon, DataFrame):
        ship(docs.sparkSession)
        return docs.withColumn("stress", _stress_by(lexicon)("low"))
    words = docs.select(doc, F.posexplode("low").alias("pos", "word")).join(lexicon, "word", "left")
    made = words.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "stress"))), lambda x: x["stress"]).alias("stress"))
    return docs.join(made, doc, "left").withColumn("stress", F.coalesce("stress", F.array().cast("array<string>")))


def stressed_words(docs: DataFrame, lexicon: Lexicon, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, pos, word, stress): every word with its stress, null for those not in the lexicon."""
    if isinstance(lexicon, DataFrame):
        w = segment.words(docs, doc, text).select(doc, "pos", F.lower("word").alias("word"))
        return w.join(lexicon, "word", "left").select(doc, "pos", "word", "stress")
    w = stress_arrays(docs.select(doc, text), lexicon, doc, text)
    return w.select(doc, F.posexplode(F.arrays_zip("low", "stress")).alias("pos", "x")).select(doc, (F.col("pos") + 1).alias("pos"), F.col("x.low").alias("word"), "x.stress")


def stress_summary(stressed: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Syllables, stressed syllables and the share of unknown words of each document."""
    n = F.length("stress")
    return stressed.groupBy(doc).agg(
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("syllables"),
        F.coalesce(F.sum(F.length(F.regexp_replace("stress", "0", ""))), F.lit(0)).cast("long").alias("stressed"),
        F.avg(F.col("stress").isNull().cast("double")).alias("oov_rate"),
    )


def series(docs: DataFrame, lexicon: Lexicon | None, doc: str = "doc_id", text: str = "text", names: tuple[str, ...] = ("sl", "phg", "spw", "syms")) -> DataFrame:
    """The long table of the series of these names, of which only spw and syms need the lexicon; no other is worked out."""
    c = F.col(text)
    if {"spw", "syms"} & set(names):
        docs = stress_arrays(docs, lexicon, doc, text)
    beats = F.transform(F.filter(F.split(F.array_join("stress", ""), ""), lambda x: x != ""), lambda x: (x != "0").cast("int"))
    made = {"sl": T.sentence_words(c), "phg": T.phrases(c), "spw": F.transform(F.filter("stress", lambda x: x.isNotNull()), F.length), "syms": beats}
    arrays = [F.struct(F.lit(n).alias("name"), v.alias("v")) for n, v in made.items() if n in names]
    counts = docs.select(doc, F.explode(F.array(*arrays)).alias("x")).select(doc, "x.name", F.posexplode("x.v").alias("pos", "value"))
    return counts.select(doc, "name", F.col("pos").cast("long").alias("pos"), F.col("value").cast("double").alias("value"))


def moments(s: DataFrame, prefix: str, doc: str = "doc_id", value: str = "value", skew: bool = False) -> DataFrame:
    """Mean, population variance, coefficient of variation and, if asked, population skewness (0 up to two values)."""
    m, sd = F.avg(value), F.stddev_pop(value)
    out = [m.alias(f"{prefix}_mean"), F.var_pop(value).alias(f"{prefix}_var"), cv(m, sd).alias(f"{prefix}_cv")]
    if skew:
        out.append(F.when((F.count(value) > 2) & (F.var_pop(value) > 0), F.skewness(value)).otherwise(0.0).alias(f"{prefix}_skew"))
    return s.groupBy(doc).agg(*out)


def gaps(s: DataFrame, doc: str = "doc_id", pos: str = "pos", value: str = "value") -> DataFrame:
    """(doc, gap): distances between neighbouring ones of a 0/1 series."""
    at = s.where(F.col(value) == 1)
    return at.withColumn("gap", F.col(pos) - F.lag(pos).over(Window.partitionBy(doc).orderBy(pos))).where("gap IS NOT NULL").select(doc, "gap")


def run_lengths(s: DataFrame, doc: str = "doc_id", pos: str = "pos", value: str = "value") -> DataFrame:
    """(doc, run, length): lengths of runs of equal values."""
    w = Window.partitionBy(doc).orderBy(pos)
    changed = F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(0))
    return s.withColumn("__c", changed).withColumn("run", F.sum("__c").over(w)).groupBy(doc, "run").agg(F.count(value).alias("length"))


def entropy(s: DataFrame, value: str, name: str, doc: str = "doc_id") -> DataFrame:
    """Entropy in bits of the values' histogram."""
    n = s.groupBy(doc, value).agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(doc))
    return n.withColumn("p", p).groupBy(doc).agg((-F.sum(F.col("p") * F.log2("p"))).alias(name))


def type_ratio(window: int, n: str = "n", pos: str = "pos", prev: str = "prev") -> Column:
    """Mean type-token ratio over all windows, as an aggregate over words with the text's length and each word's place before (0 if none).

    A window counts a word where it occurs first within it, so each occurrence
    adds the number of windows in which it is the first.
    """
    w = F.least(F.col(n), F.lit(window))
    first = F.greatest(F.lit(1), F.col(pos) - w + 1, F.col(prev) + 1)
    last = F.least(F.col(pos), F.col(n) - w + 1)
    return F.sum(F.greatest(F.lit(0), last - first + 1)) / F.first(w * (F.col(n) - w + 1))


def mattr(tokens: DataFrame, window: int = 50, doc: str = "doc_id", pos: str = "pos", word: str = "word") -> DataFrame:
    """Mean type-token ratio over all windows; over the whole of a shorter text."""
    n = F.count(word).over(Window.partitionBy(doc))
    prev = F.lag(pos).over(Window.partitionBy(doc, word).orderBy(pos))
    t = tokens.select(doc, F.lower(word).alias(word), pos).withColumn("n", n).withColumn("prev", F.coalesce(prev, F.lit(0)))
    return t.groupBy(doc).agg(type_ratio(window, "n", pos).alias("mattr"))


def meter(syms: DataFrame, doc: str = "doc_id", pos: str = "pos", value: str = "value") -> DataFrame:
    """Mean and variance of the mismatch with the better of the two alternating patterns."""
    off = F.avg((F.col(value) != F.pmod(F.col(pos), F.lit(2))).cast("double"))
    m = syms.groupBy(doc).agg(F.least(off, 1 - off).alias("mt_mean"))
    return m.withColumn("mt_var", F.col("mt_mean") * (1 - F.col("mt_mean")))


def spread(n: Column, s1: Column, s2: Column) -> Column:
    """Population variance from a count, a sum and a sum of squares; of whole numbers only the division rounds."""
    return F.greatest(F.lit(0.0), n * s2 - s1 * s1) / (n * n)
