"""Languages of a document by expectation-maximisation over a mixture.

Each language has an n-gram model: smoothed counts of byte trigrams of
lower-cased letters, hashed into a fixed number of buckets. A document is cut
into units of eight words. It is taken as a mixture whose unknown shares are
fitted by expectation-maximisation on the units' likelihoods; languages are
dropped one by one while the penalised likelihood gains. All documents of a
block are fitted at once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import ship

#: Entries of the model, languages by buckets: 16 MB as floats, whatever the corpus.
MODEL_SIZE = 1 << 22
UNIT_WORDS, ROUNDS, ALPHA = 8, 12, 0.05
#: Languages that are learned at most, those of the most texts.
MOST_LANGUAGES = 4096
#: Units times languages that are held at once; a longer text is worked on in parts.
CELLS = 1 << 22


def _grams(block: kernel.Block, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, bucket) of the trigram around each letter; word and text ends count as 0."""
    b = block.bytes
    n = len(b)
    at = np.flatnonzero(b)
    first = np.zeros(n + 1, dtype=bool)
    first[block.starts] = True
    before = np.where(first[at], 0, b[np.maximum(at - 1, 0)]).astype(np.uint32)
    after = np.where(first[at + 1] | (at + 1 >= n), 0, b[np.minimum(at + 1, n - 1)]).astype(np.uint32)
    g = before | (b[at].astype(np.uint32) << np.uint32(8)) | (after << np.uint32(16))
    return at, ((g * np.uint32(0x9E3779B1)) >> np.uint32(32 - buckets.bit_length() + 1)).astype(np.int64)


def fit(train: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log likelihoods of shape (languages, buckets)) from all rows with a text and a language.

    Of more than MOST_LANGUAGES values those of the most texts are learned, ties by name.
    """
    ship(train.sparkSession)
    rows = train.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    langs = sorted(r[0] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect())
    if not langs:
        return [], np.zeros((0, 1))
    buckets = 1 << min(16, int(math.log2(MODEL_SIZE // len(langs))))
    index = {x: i for i, x in enumerate(langs)}

    def each(batches):
        total = np.zeros((len(index), buckets), dtype=np.int64)
        for batch in batches:
            batch = batch.filter(pa.array([x in index for x in batch.column(0).to_pylist()], pa.bool_()))
            which = np.array([index[x] for x in batch.column(0).to_pylist()], dtype=np.int64)
            for at, block in kernel.blocks(batch.column(1), kernel.LETTERS, latin=True):
                pos, h = _grams(block, buckets)
                doc = np.searchsorted(block.starts, pos, "right") - 1
                total += np.bincount(which[doc + at] * buckets + h, minlength=total.size).reshape(total.shape)
        i, h = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(h), pa.array(total[i, h])], names=["i", "h", "n"])

    counts = rows.mapInArrow(each, "i long, h long, n long").groupBy("i", "h").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros((len(langs), buckets))
    total[counts["i"], counts["h"]] = counts["n"]
    return langs, np.log((total + ALPHA) / (total.sum(axis=1, keepdims=True) + ALPHA * buckets))


def mixtures(ll: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """(n, languages) shares of each document from the log likelihoods ll of its units."""
    k = ll.shape[1]
    units = np.bincount(doc, minlength=n).astype(float)
    top = ll.max(axis=1)
    like = np.exp(ll - top[:, None])

    def em(share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(ROUNDS):
            r = like * share[doc]
            r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
            share = np.stack([np.bincount(doc, r[:, j], n) for j in range(k)], axis=1) / np.maximum(units, 1)[:, None]
        fit = np.log(np.maximum((like * share[doc]).sum(axis=1), 1e-300)) + top
        return share, np.bincount(doc, fit, n)

    penalty = 0.5 * np.log(np.maximum(units, 2)) + 2
    share, value = em(np.full((n, k), 1 / k))
    share[(share < 0.5 / np.maximum(units, 1)[:, None]) & (share < share.max(axis=1, keepdims=True))] = 0  # less than half a unit
    share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
    share, value = em(share)
    while True:
        size = (share > 0).sum(axis=1)
        open_ = np.flatnonzero((size > 1) & (units > 0))
        if not len(open_):
            return share
        keep = np.isin(doc, open_)
        trial = share.copy()
        least = k - 1 - np.where(trial > 0, trial, np.inf)[:, ::-1].argmin(axis=1)  # of equal ones the last
        trial[open_, least[open_]] = 0
        trial /= np.maximum(trial.sum(axis=1, keepdims=True), 1e-300)
        renumber = np.full(n, -1)
        renumber[open_] = np.arange(len(open_))
        sub = mixtures_step(like[keep], top[keep], renumber[doc[keep]], trial[open_])
        better = sub[1] + penalty[open_] > value[open_]
        took = open_[better]
        if not len(took):
            return share
        share[took], value[took] = sub[0][better], sub[1][better]
        units = units.copy()
        units[open_[~better]] = 0  # settled


def mixtures_step(like: np.ndarray, top: np.ndarray, doc: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some rounds of expectation-maximisation from share, and the log likelihood reached."""
    n, k = share.shape
    units = np.maximum(np.bincount(doc, minlength=n), 1).astype(float)
    for _ in range(ROUNDS):
        r = like * share[doc]
        r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
        share = np.stack([np.bincount(doc, r[:, j], n) for j in range(k)], axis=1) / units[:, None]
    fit = np.log(np.maximum((like * share[doc]).sum(axis=1), 1e-300)) + top
    return share, np.bincount(doc, fit, n)


def mixture_in_parts(table: np.ndarray, gram: np.ndarray, unit: np.ndarray, units: int) -> np.ndarray:
    """The shares that mixtures() finds for one text, from the buckets of its n-grams and their units, in order.

    No more than CELLS likelihoods are held. If those of the languages still in
    the mixture are more, each round works them out anew, part by part; no
    language is left out for that.
    """
    top = np.full(units, -np.inf)
    for j in range(len(table)):
        top = np.maximum(top, np.bincount(unit, table[j][gram], units))

    def parts(among: np.ndarray):
        step = max(1, CELLS // len(among))
        for lo in range(0, units, step):
            hi = min(units, lo + step)
            i, j = np.searchsorted(unit, (lo, hi))
            ll = np.stack([np.bincount(unit[i:j] - lo, table[x][gram[i:j]], hi - lo) for x in among], axis=1)
            yield np.exp(ll - top[lo:hi, None]), top[lo:hi]

    def em(share: np.ndarray) -> tuple[np.ndarray, float]:
        among = np.flatnonzero(share > 0)
        held = list(parts(among)) if units * len(among) <= CELLS else None
        s = share[among]
        for _ in range(ROUNDS):
            new = np.zeros(len(among))
            for like, _ in held or parts(among):
                r = like * s
                new += (r / np.maximum(r.sum(axis=1, keepdims=True), 1e-300)).sum(axis=0)
            s = new / units
        out = np.zeros(len(share))
        out[among] = s
        return out, sum(float((np.log(np.maximum((like * s).sum(axis=1), 1e-300)) + t).sum()) for like, t in held or parts(among))

    penalty = 0.5 * np.log(max(units, 2)) + 2
    share, value = em(np.full(len(table), 1 / len(table)))
    share[(share < 0.5 / units) & (share < share.max())] = 0
    share, value = em(share / share.sum())
    while (share > 0).sum() > 1:
        trial = share.copy()
        trial[len(share) - 1 - np.where(share > 0, share, np.inf)[::-1].argmin()] = 0
        trial, reached = em(trial / trial.sum())
        if reached + penalty <= value:
            break
        share, value = trial, reached
    return share


def block_shares(table: np.ndarray, block: kernel.Block) -> np.ndarray:
    """(texts, languages) shares of a block's texts, some texts at a time, so that units times languages stay bounded."""
    k = len(table)
    share = np.zeros((block.n, k))
    if not len(block.s):
        return share
    pos, h = _grams(block, table.shape[1])
    word = np.searchsorted(block.s, pos, "right") - 1
    per = -(-block.counts // UNIT_WORDS)
    ends = np.cumsum(per)
    base = ends - per
    unit = base[block.doc] + (np.arange(len(block.doc)) - block.first[:-1][block.doc]) // UNIT_WORDS
    u = unit[word]
    owner = np.repeat(np.arange(block.n), per)
    cut = np.searchsorted(u, np.append(base, ends[-1]))
    d = 0
    while d < block.n:
        e = max(d + 1, int(np.searchsorted(ends, base[d] + CELLS // k, "right")))
        lo, hi = int(base[d]), int(ends[e - 1])
        part, at_unit = h[cut[d] : cut[e]], u[cut[d] : cut[e]] - lo
        if (hi - lo) * k > CELLS and hi - lo > 1:
            share[d] = mixture_in_parts(table, part, at_unit, hi - lo)
        else:
            ll = np.stack([np.bincount(at_unit, table[j][part], hi - lo) for j in range(k)], axis=1)
            share[d:e] = mixtures(ll, owner[lo:hi] - d, e - d)
        d = e
    return share


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], doc: str = "doc_id", text: str = "text", also: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, lang_pred, score, langs array<struct<lang,share>>.

    lang_pred is the language of the largest share (ties: the first in order),
    score that share. A text that is null or has no letter is `und` with score
    0 and no languages, and so is every text if nothing was learned. Every
    other text has a language, however short; a text whose letters the model
    has never seen has the first of those it can't tell apart. Very long texts
    are read whole, repeated rows each have their row, and an empty table has
    none. Other columns aren't read, so none can clash. also: further columns
    to carry through.
    """
    ship(docs.sparkSession)
    langs, table = model
    shared = docs.sparkSession.sparkContext.broadcast((langs, table.astype(np.float32)))
    also = also or {}
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(doc).alias("doc_id"), *[c.alias(k) for k, c in also.items()], F.col(text).alias("text"), letters.alias("letters"))

    def each(batches):
        langs, table = shared.value
        k = len(langs)
        for batch in batches:
            keep = [batch.column(i) for i in range(batch.num_columns - 2)]
            ok = np.array(batch.column(batch.num_columns - 1).to_pylist(), dtype=bool)
            share = np.zeros((batch.num_rows, k))
            if k:
                for at, block in kernel.blocks(batch.column(batch.num_columns - 2), kernel.LETTERS, latin=True):
                    share[at : at + block.n] = block_shares(table, block)
            share[~ok] = 0
            best = share.argmax(axis=1) if k else np.zeros(batch.num_rows, dtype=int)
            score = share[np.arange(batch.num_rows), best] if k else np.zeros(batch.num_rows)
            pred = [langs[b] if s > 0 else "und" for b, s in zip(best, score, strict=True)]
            sets = [[{"lang": langs[j], "share": float(row[j])} for j in np.flatnonzero(row > 0)] for row in share]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(sets, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
                names=[*names, "lang_pred", "score", "langs"],
            )

    names = rows.columns[:-2]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(names)]) + ", lang_pred string, score double, langs array<struct<lang:string,share:double>>"
    return rows.mapInArrow(each, schema)
