"""Rhythm and order rows from one compact row for each document, without a long table of series.

A document's series are arrays: words of each sentence and of each phrase, and
the stress of its known words as one string of digits. Nothing crosses the
network where stress is a rule; only words do, once, to meet a table. Rows are
then worked on by Arrow batches; the order of a series is shuffled in place, for
all draws of a control at once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.functions import text as T
from prosemill.operators.rhythm import GROUPS, Lexicon, stress_arrays
from prosemill.operators.series import ORDER
from prosemill.sources import ship

#: The finaliser of a public 32-bit hash, and the odd constant that spreads positions.
SPREAD, FIRST, SECOND = 2654435761, 2246822507, 3266489909
#: Values of one series that are shuffled at once.
AT_ONCE = 1 << 22


def compact(docs: DataFrame, lexicon: Lexicon | None, doc: str = "doc_id", text: str = "text", names: tuple[str, ...] = ("sl", "phg", "stress", "words")) -> DataFrame:
    """(doc, sl array<int>, phg array<int>, stress string, words array<long>): a row for each row of docs.

    stress has the digits of each known word in order, words apart by a space;
    words are hashes of all words in lower case. Null texts have empty series,
    and so have all where the names leave one out.
    """
    c = F.coalesce(F.col(text), F.lit(""))
    if {"stress", "words"} & set(names):
        docs = stress_arrays(docs, lexicon, doc, text)
    words = F.transform("low", lambda w: F.xxhash64(w))
    made = {"sl": (T.sentence_words(c), "array<int>"), "phg": (T.phrases(c), "array<int>"), "stress": (F.array_join("stress", " "), "string"), "words": (words, "array<bigint>")}
    none = lambda kind: F.lit("") if kind == "string" else F.array().cast(kind)
    return docs.select(doc, *[(v if n in names else none(kind)).alias(n) for n, (v, kind) in made.items()])


def rhythm_features(docs: DataFrame, lexicon: Lexicon, window: int = 50, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, rhythm features and mattr) of documents."""
    return rhythm_rows(compact(docs, lexicon, doc, text), window, doc)


def _keys(doc: str, name: str, draws: list[int], n: int) -> np.ndarray:
    """(draws, n): order_keys() of each draw."""
    seeds = [int(hashlib.md5(f"{d}:{doc}:{name}".encode()).hexdigest()[:8], 16) for d in draws]
    x = (np.arange(n, dtype=np.uint64) * np.uint64(SPREAD) & np.uint64(0xFFFFFFFF)) ^ np.array(seeds, dtype=np.uint64)[:, None]
    for by, shift in ((FIRST, 16), (SECOND, 13)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by) & np.uint64(0xFFFFFFFF)
    return x ^ (x >> np.uint64(16))


def order_keys(doc: str, name: str, draw: int, n: int) -> np.ndarray:
    """By these numbers, then by position, a draw orders the n values of a series."""
    return _keys(doc, name, [draw], n)[0]


def shuffled(x: np.ndarray, doc: str, name: str, draws: list[int]) -> np.ndarray:
    """(draws, n): x in the order of each draw. Key and position are one number, so that a plain sort keeps ties in order."""
    keys = _keys(doc, name, draws, len(x)) << np.uint64(32) | np.arange(len(x), dtype=np.uint64)
    return x[(np.sort(keys, axis=1) & np.uint64(0xFFFFFFFF)).astype(np.int64)]


def _ac1(x: np.ndarray) -> np.ndarray:
    c = x - x.mean(axis=1, keepdims=True)
    return (c[:, 1:] * c[:, :-1]).sum(axis=1) / (c * c).sum(axis=1)


def _bvr(x: np.ndarray) -> np.ndarray:
    thirds = np.array_split(x, 3, axis=1)
    mean = x.mean(axis=1)
    within = sum(t.var(axis=1) for t in thirds) / 3
    between = sum(t.shape[1] * (t.mean(axis=1) - mean) ** 2 for t in thirds) / x.shape[1]
    return np.divide(between, within, out=np.zeros(len(x)), where=within > 0)


def _lre(x: np.ndarray) -> np.ndarray:
    return ((x[:, :-2] + x[:, 1:-1] + x[:, 2:]) / 3).var(axis=1) / x.var(axis=1)


def _turning(x: np.ndarray) -> np.ndarray:
    a, b = np.sign(x[:, 1:-1] - x[:, :-2]), np.sign(x[:, 1:-1] - x[:, 2:])
    return (a * b > 0).sum(axis=1) / (x.shape[1] - 2)


def _runz(x: np.ndarray) -> np.ndarray:
    n, n1, n0 = float(x.shape[1]), (x == 1).sum(axis=1).astype(float), (x == 0).sum(axis=1).astype(float)
    both = 2 * n1 * n0
    var = both * (both - n) / (n * n * (n - 1))
    z = np.divide(1 + (x[:, 1:] != x[:, :-1]).sum(axis=1) - (1 + both / n), np.sqrt(np.maximum(var, 0)), out=np.zeros(len(x)), where=var > 0)
    return np.where((n1 > 0) & (n0 > 0), np.clip(z, -6, 6), 0)


def _mk(x: np.ndarray) -> np.ndarray:
    """By the bits of the values' ranks: two ranks differ first in one bit, so no pair is formed.

    All rows, which hold the same values, are one sequence of groups. From the
    highest bit down each group is split by the bit, its order kept.
    """
    d, n = x.shape
    values = np.unique(x[0])
    r = np.searchsorted(values, x.ravel())
    first = np.repeat(np.arange(d) * n, n)  # where the group of each place begins
    at = np.arange(d * n)
    total = np.zeros(d, dtype=np.int64)
    for k in range((len(values) - 1).bit_length() - 1, -1, -1):
        bit = r >> k & 1
        before = np.concatenate([[0], np.cumsum(bit)])
        ones = before[:-1] - before[first]
        zeros = at - first - ones
        total += np.where(bit == 1, zeros, -ones).reshape(d, n).sum(axis=1)
        if k:
            begins = np.flatnonzero(np.diff(first, prepend=-1))
            size = np.diff([*begins, d * n])
            middle = first + np.repeat(size - (before[begins + size] - before[begins]), size)
            first = np.where(bit == 1, middle, first)
            to = first + np.where(bit == 1, ones, zeros)
            moved, start = np.empty_like(r), np.empty_like(first)
            moved[to], start[to] = r, first
            r, first = moved, start
    return total / (n * (n - 1) / 2)


#: Each feature, the least values that define it, and whether it needs values that differ.
FEATURES = {"ac1": (_ac1, 3, True), "mk": (_mk, 4, False), "bvr": (_bvr, 6, False), "lre": (_lre, 6, True), "turning": (_turning, 3, False), "runz": (_runz, 6, False)}


def order_row(series: dict[str, np.ndarray], doc: str, draws: list[int] | list[None]) -> list[list[float]]:
    """The ten order features of each draw; [None] is the order as it is."""
    out = [[0.0] * len(ORDER) for _ in draws]
    for name in dict.fromkeys(s for _, s, _ in ORDER):
        x = series[name].astype(float)
        for first in range(0, len(draws), step := max(1, AT_ONCE // max(1, len(x)))):
            some = draws[first : first + step]
            m = x[None] if some == [None] else shuffled(x, doc, name, some)
            for j, (_, s, f) in enumerate(ORDER):
                of, least, vary = FEATURES[f]
                if s == name and len(x) >= least and (not vary or x.min() < x.max()):
                    for i, v in enumerate(of(m)):
                        out[first + i][j] = float(v)
    return out


def _entropy(x: np.ndarray) -> float:
    """Entropy in bits of the values' histogram."""
    n = np.unique(x, return_counts=True)[1].astype(float)
    return float(np.log2(len(x)) - (n * np.log2(n)).sum() / len(x))


def mattr_of(words: np.ndarray, window: int) -> float:
    """Mean type-token ratio over all windows of a text's words, which are numbers; 0 without any."""
    n = len(words)
    if not n:
        return 0.0
    by = np.argsort(words, kind="stable")
    before = np.zeros(n, dtype=np.int64)
    same = words[by][1:] == words[by][:-1]
    before[by[1:][same]] = by[:-1][same] + 1
    pos, w = np.arange(1, n + 1), min(n, window)
    first = np.maximum(np.maximum(1, pos - w + 1), before + 1)
    return float(np.maximum(0, np.minimum(pos, n - w + 1) - first + 1).sum() / (w * (n - w + 1)))


def rhythm_row(series: dict[str, np.ndarray], words: np.ndarray, window: int) -> list[float]:
    """The rhythm features in the order of GROUPS, 0 where undefined."""
    f = dict.fromkeys(GROUPS, 0.0)

    def moments(name: str, x: np.ndarray) -> tuple[float, float]:
        n, s1, s2 = float(len(x)), float(x.sum()), float((x * x).sum())
        if not n:
            return 0.0, 0.0
        square = max(0.0, n * s2 - s1 * s1)
        for key, v in (("mean", s1 / n), ("var", square / (n * n)), ("cv", square**0.5 / s1 if s1 > 0 else 0.0)):
            if f"{name}_{key}" in f:
                f[f"{name}_{key}"] = v
        return s1 / n, square / (n * n)

    sl, ph, spw, syms = (series[k].astype(float) for k in ("sl", "phg", "spw", "syms"))
    moments("sl", sl)
    moments("ph", ph)
    m, var = moments("spw", spw)
    if len(spw) > 2 and var > 0:
        f["spw_skew"] = float(((spw**3).sum() / len(spw) - 3 * m * (spw * spw).sum() / len(spw) + 2 * m**3) / var**1.5)
    gaps = np.diff(np.flatnonzero(syms == 1)).astype(float)
    moments("gap", gaps)
    if len(gaps):
        f["stress_bin_entropy"] = _entropy(gaps)
    if len(syms):
        edges = np.flatnonzero(np.diff(syms)) + 1
        runs = np.diff([0, *edges, len(syms)]).astype(float)
        f["stress_runlen_var"] = max(0.0, len(runs) * (runs * runs).sum() - runs.sum() ** 2) / len(runs) ** 2
        off = float((syms != np.arange(len(syms)) % 2).mean())
        off = min(off, 1 - off)
        f["mt_mean"], f["mt_var"] = off, off * (1 - off)
    f["mattr"] = mattr_of(words, window)
    return [f[k] for k in GROUPS]


def _series(batch, i: int) -> dict[str, np.ndarray]:
    stress = batch.column(3)[i].as_py().encode()
    parts = stress.split()
    array = lambda c: np.array(batch.column(c)[i].values.to_numpy(zero_copy_only=False))
    return {"sl": array(1), "phg": array(2), "spw": np.array([len(p) for p in parts], dtype=np.int64), "syms": (np.frombuffer(b"".join(parts), np.uint8) != 48).astype(np.int64)}


def _rows(c: DataFrame, doc: str, key: str, columns: str, of) -> DataFrame:
    ship(c.sparkSession)
    kind = c.schema[doc].dataType.simpleString()

    def each(batches):
        for batch in batches:
            ids, made = [], []
            for i in range(batch.num_rows):
                rows = of(batch, i)
                ids += [i] * len(rows)
                made += rows
            if made:
                names = [x.strip().split()[0] for x in columns.split(",")]
                cols = list(zip(*made, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), *[pa.array(v) if k in ("draw", "name") else pa.array(v, pa.float64()) for k, v in zip(names, cols, strict=True)]], names=[doc, *names])

    slim = c.select(doc, "sl", "phg", "stress", "words", F.coalesce(F.col(doc).cast("string"), F.lit("")).alias(key))
    return slim.mapInArrow(each, f"`{doc}` {kind}, {columns}")


def order_rows(c: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, ten order features) of compact rows."""
    return _rows(c, doc, "__key", ", ".join(f"{n} double" for n, _, _ in ORDER), lambda b, i: order_row(_series(b, i), "", [None]))


def style_rows(c: DataFrame, window: int = 50, doc: str = "doc_id") -> DataFrame:
    """(doc, rhythm features, mattr, ten order features) of compact rows, in one pass."""

    def of(batch, i):
        x = _series(batch, i)
        return [[*rhythm_row(x, batch.column(4)[i].values.to_numpy(zero_copy_only=False), window), *order_row(x, "", [None])[0]]]

    return _rows(c, doc, "__key", ", ".join(f"{n} double" for n in (*GROUPS, *(n for n, _, _ in ORDER))), of)


def order_values(c: DataFrame, feature: str, names: tuple[str, ...], doc: str = "doc_id") -> DataFrame:
    """(doc, name, <feature>): one order feature of each of these series that has any value, of compact rows; 0 where undefined."""
    f, least, vary = FEATURES[feature]

    def of(batch, i):
        held = _series(batch, i)
        some = [(n, held[n].astype(float)) for n in names if len(held[n])]
        return [[n, float(f(x[None])[0]) if len(x) >= least and (not vary or x.min() < x.max()) else 0.0] for n, x in some]

    return _rows(c, doc, "__key", f"name string, {feature} double", of)


def gap_entropy(c: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, stress_bin_entropy) of the gaps between stressed syllables, of compact rows that have a gap."""

    def of(batch, i):
        gaps = np.diff(np.flatnonzero(_series(batch, i)["syms"] == 1))
        return [[_entropy(gaps)]] if len(gaps) else []

    return _rows(c, doc, "__key", "stress_bin_entropy double", of)


def shuffled_rows(c: DataFrame, draws: int = 20, doc: str = "doc_id") -> DataFrame:
    """(doc, draw, ten order features): of each document for each draw, its series shuffled independently."""

    def of(batch, i):
        rows = order_row(_series(batch, i), batch.column(5)[i].as_py(), list(range(draws)))
        return [[np.int32(d).item(), *r] for d, r in enumerate(rows)]

    return _rows(c, doc, "__key", "draw long, " + ", ".join(f"{n} double" for n, _, _ in ORDER), of)


def rhythm_rows(c: DataFrame, window: int = 50, doc: str = "doc_id") -> DataFrame:
    """(doc, rhythm features and mattr) of compact rows, 0 where undefined."""

    def of(batch, i):
        return [rhythm_row(_series(batch, i), batch.column(4)[i].values.to_numpy(zero_copy_only=False), window)]

    return _rows(c, doc, "__key", ", ".join(f"{n} double" for n in GROUPS), of)


#: Columns of level_rows().
LEVEL = ("level_mean", "level_var", "level_cv", "level_runlen_var", "level_entropy", "level_gap_mean", "level_gap_var", "level_ac1")


def _variance(x: np.ndarray) -> float:
    """Population variance by steps of each value, as Spark and SQL take them."""
    mean = square = 0.0
    for n, v in enumerate(x.tolist(), 1):
        d = v - mean
        mean += d / n
        square += d * (d - d / n)
    return square / len(x)


def level_row(x: np.ndarray, threshold: float = 1.0, lo: float = 0.0, hi: float = 2.0, bins: int = 5) -> list[float]:
    """The columns of LEVEL of one text's scores, 0 where undefined and below three values."""
    if len(x) < 3:
        return [0.0] * len(LEVEL)
    high = x > threshold
    gaps, runs = np.diff(np.flatnonzero(high)), np.diff([0, *(np.flatnonzero(np.diff(high)) + 1), len(x)])
    inside = x[(x >= lo) & (x <= hi)]
    entropy = _entropy(np.minimum(bins - 1, np.floor((inside - lo) / ((hi - lo) / bins)))) if len(inside) else 0.0
    mean, var = np.cumsum(x)[-1] / len(x), _variance(x)  # added up in order, as SQL does, so that halves round alike
    gap = (gaps.mean(), gaps.var()) if len(gaps) else (0.0, 0.0)
    return [*map(float, (mean, var, var**0.5 / mean if mean > 0 else 0.0, runs.var(), entropy, *gap, _ac1(x[None])[0] if x.min() < x.max() else 0.0))]


def level_rows(docs: DataFrame, values: Column, doc: str = "doc_id") -> DataFrame:
    """(doc, LEVEL): series.level_features() of arrays of scores, a row for each document that has any, in one pass without a shuffle."""
    ship(docs.sparkSession)

    def each(batches):
        for batch in batches:
            if batch.num_rows:
                rows = [level_row(batch.column(1)[i].values.to_numpy(zero_copy_only=False)) for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, pa.float64()) for v in zip(*rows, strict=True)]], names=[doc, *LEVEL])

    some = docs.select(doc, values.cast("array<double>").alias("x")).where(F.size("x") > 0)
    return some.mapInArrow(each, f"`{doc}` {docs.schema[doc].dataType.simpleString()}, " + ", ".join(f"{c} double" for c in LEVEL))
