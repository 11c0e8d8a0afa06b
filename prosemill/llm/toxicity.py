"""Toxicity by weak supervision.

Voters are words and word beginnings of a lexicon mined from the training rows,
a few seed words and surface patterns. A generative label model of the true
label estimates each voter's accuracy from the votes by
expectation-maximisation, the given labels being one more, noisy voter, and
discounts other voters that correlate beyond what the label explains. A linear
classifier is then trained on the posterior labels and scores every text.

Counting covers all training rows; only the label model and the classifier are
fitted on a bounded, hashed sample of them, FIT_ROWS. Every text is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import ship, sieved, stage, unit

#: Buckets of hashed words and word beginnings, candidates and voters kept, and labelled rows that the models are fitted on at most.
BUCKETS, CANDIDATES, VOTERS, FIT_ROWS = 1 << 22, 2048, 256, 20_000
BEGINNINGS = (4, 5, 6, 7, 9)
#: A strong candidate goes with label 1 at least this often.
STRONG = 0.6
#: Words that vote for toxic before any is mined.
SEEDS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "clown", "dumb", "filth", "vermin", "idiota", "imbécile", "dummkopf")
#: Surface patterns: share of capitals, of exclamation marks, of digits, repeated words.
PATTERNS = ("shouting", "exclaiming", "digits", "repeating")


def _features(block: kernel.Block) -> tuple[np.ndarray, np.ndarray]:
    """(word no., bucket) of each word and each beginning of a longer word."""
    size = block.e - block.s
    at, ids = [np.arange(len(block.s))], [block.words()]
    for k in BEGINNINGS:
        long = np.flatnonzero(size > k)
        at.append(long)
        ids.append(block.hashes(block.s[long], block.s[long] + k, salt=k))
    return np.concatenate(at), (np.concatenate(ids) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _known(block: kernel.Block, lookup: np.ndarray, strong: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text no., candidate no.) once each, and how many words of each text have a strong candidate."""
    word, b = _features(block)
    i = lookup[b]
    hit = i >= 0
    word, i = word[hit], i[hit].astype(np.int64)
    told = np.unique(word[strong[i]])
    key = np.unique(block.doc[word] * len(strong) + i)
    return key // len(strong), key % len(strong), np.bincount(block.doc[told], minlength=block.n)


def _patterns(block: kernel.Block) -> np.ndarray:
    """(texts, patterns) of bits."""
    raw = block.raw
    doc_of = lambda at: np.searchsorted(block.starts, at, "right") - 1
    n = block.n
    letters = np.maximum(np.bincount(doc_of(np.flatnonzero(block.bytes)), minlength=n), 1)
    words = np.maximum(block.counts, 1)
    per = lambda mask: np.bincount(doc_of(np.flatnonzero(mask)), minlength=n)
    w = block.words()
    same = np.zeros(len(w), dtype=bool)
    same[1:] = (w[1:] == w[:-1]) & (block.doc[1:] == block.doc[:-1])
    return np.stack([per((raw >= 65) & (raw <= 90)) > 0.5 * letters, per(raw == 33) > 0.2 * words, per((raw >= 48) & (raw <= 57)) > 0.1 * letters, np.bincount(block.doc[same], minlength=n) > 0.1 * words], axis=1)


def seed_buckets() -> np.ndarray:
    text = pa.array([" ".join(SEEDS)])
    (_, block), = kernel.blocks(text, kernel.LETTERS, latin=True)
    return (block.words() & np.uint64(BUCKETS - 1)).astype(np.int64)


class Model:
    """What fit() learned: the candidates' buckets, which of them are strong, the linear weights and the label model's voters."""

    def __init__(self, buckets: np.ndarray, strong: np.ndarray, weights: np.ndarray, bias: float, voters: list[dict]):
        self.buckets, self.strong, self.weights, self.bias, self.voters = buckets, strong, weights, bias, voters


def _mined(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(buckets that go with label 1, whether they rarely go with 0), by counts over all training rows, most telling first."""

    def each(batches):
        pos, neg = np.zeros(BUCKETS, dtype=np.int32), np.zeros(BUCKETS, dtype=np.int32)
        for batch in batches:
            label = np.array(batch.column(0).to_pylist(), dtype=np.int64)
            for at, block in kernel.blocks(batch.column(1), kernel.LETTERS, latin=True):
                word, b = _features(block)
                key = np.unique(block.doc[word] * BUCKETS + b)
                y = label[key // BUCKETS + at] == 1
                for total, part in ((pos, key[y]), (neg, key[~y])):
                    i, c = np.unique(part % BUCKETS, return_counts=True)
                    total[i] += c.astype(np.int32)
        # Also buckets without a label 1 here: other partitions may have one, and filter, rank and strength need all counts of 0.
        i = np.flatnonzero(pos | neg)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(pos[i].astype(np.int64)), pa.array(neg[i].astype(np.int64))], names=["bucket", "pos", "neg"])

    counts = train.select("label", "text").mapInArrow(each, "bucket long, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    n = train.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos")).first()
    rate = (n["pos"] or 0) / max(1, n["n"])
    if not rate:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    hits = F.col("pos") + F.col("neg")
    z = (F.col("pos") - hits * rate) / F.sqrt(hits * rate * (1 - min(rate, 0.999)))
    top = counts.where((F.col("pos") >= 3) & (F.col("pos") > 2.5 * rate * hits)).select("bucket", "pos", "neg", z.alias("z")).orderBy(F.desc("z"), "bucket").limit(CANDIDATES).collect()
    strong = np.array([r["pos"] >= 4 and r["pos"] >= STRONG * (r["pos"] + r["neg"]) for r in top], dtype=bool)
    return np.array([r["bucket"] for r in top], dtype=np.int64), strong


def _lookup(buckets: np.ndarray) -> np.ndarray:
    out = np.full(BUCKETS, -1, dtype=np.int16)
    out[buckets] = np.arange(len(buckets))
    return out


def fit(train: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "label", fit_rows: int = FIT_ROWS) -> Model:
    """From all rows with a text and a label of 0 or 1; the models from fit_rows of them at most.

    These are drawn by a hash of id and text and taken in its order, so the
    model is the same however the rows are dealt over partitions.
    """
    ship(train.sparkSession)
    rows = train.where(F.col(text).isNotNull() & F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("label"), F.col(text).alias("text"), unit(doc, text).alias("u"))
    mined, is_strong = _mined(rows)
    seeds = np.setdiff1d(seed_buckets(), mined)
    buckets, strong = np.concatenate([mined, seeds]), np.concatenate([is_strong, np.ones(len(seeds), dtype=bool)])
    shared = train.sparkSession.sparkContext.broadcast((buckets, strong))
    n_c, n_p = len(buckets), len(PATTERNS)

    def each(batches):
        buckets, strong = shared.value
        lookup = _lookup(buckets)
        for batch in batches:
            feats, told = [], []
            for _, block in kernel.blocks(batch.column(1), kernel.LETTERS, latin=True):
                doc, i, occurs = _known(block, lookup, strong)
                bits = _patterns(block)
                cut = np.searchsorted(doc, np.arange(block.n + 1))
                feats += [i[cut[d] : cut[d + 1]].tolist() + (n_c + np.flatnonzero(bits[d])).tolist() for d in range(block.n)]
                told.append(occurs)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(feats, pa.list_(pa.int32())), pa.array(np.concatenate(told) if told else [], pa.int64())], names=["label", "u", "feats", "told"])

    table = stage(rows.mapInArrow(each, "label int, u double, feats array<int>, told long"))
    exact = table.select("label", F.explode("feats").alias("f")).groupBy("f").agg(F.sum("label").alias("pos"), F.count("label").alias("hits")).toPandas()
    n = table.count()
    # A few more than needed by their draw, so that no task ranks more.
    drawn = table.where(F.col("u") < (fit_rows + 6 * fit_rows**0.5 + 10) / n) if n > fit_rows else table
    got = drawn.orderBy("u", "label", "told", "feats").limit(fit_rows).toPandas()
    return _train(got["label"].to_numpy(dtype=float), list(got["feats"]), got["told"].to_numpy(), buckets, strong, n_c + n_p, exact)


def _train(label: np.ndarray, feats: list, told: np.ndarray, buckets: np.ndarray, strong: np.ndarray, width: int, exact) -> Model:
    n = len(label)
    if not n or not label.any():
        return Model(buckets, strong, np.zeros(width + 2), -4.0, [])
    doc = np.repeat(np.arange(n), [len(x) for x in feats])
    f = np.concatenate([np.asarray(x, dtype=np.int64) for x in feats]) if len(doc) else np.zeros(0, np.int64)
    hits, pos = np.zeros(width), np.zeros(width)
    hits[exact["f"]], pos[exact["f"]] = exact["hits"], exact["pos"]
    base = label.mean()
    lift = (pos + base) / (hits + 1)
    voters = np.argsort(-(lift - base) * np.sqrt(hits), kind="stable")[:VOTERS]
    voters = np.union1d(voters[lift[voters] > 2 * base], np.arange(len(buckets), width))
    place = np.full(width, -1)
    place[voters] = np.arange(len(voters))
    on = place[f] >= 0
    votes = np.zeros((n, len(voters)), dtype=np.float32)
    votes[doc[on], place[f[on]]] = 1
    votes = np.column_stack([votes, label.astype(np.float32)])
    posterior, rates, weight = label_model(votes, np.clip(0.9 * label + 0.05, 0, 1), base)
    w, b = _linear(doc, f, n, width, posterior, told)
    accuracies = [{"feature": int(v), "true_rate": float(r[1]), "false_rate": float(r[0]), "weight": float(x)} for v, r, x in zip([*voters, -1], rates, weight, strict=True)]
    return Model(buckets, strong, w, b, accuracies)


def label_model(votes: np.ndarray, start: np.ndarray, prior: float, rounds: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of label 1, (voters, 2) rates of voting given 0 and 1, weights) of 0/1 votes.

    Each voter fires with a rate of its own given the label. Voters that fire
    together more than the label explains have their evidence divided by one
    plus their positive conditional correlations. The last column holds the
    given labels: it shares no words with the others, so what they have in
    common isn't discounted from it.
    """
    q, w = start, np.ones(votes.shape[1])
    rates = None
    for turn in range(rounds):
        n1, n0 = q.sum(), (1 - q).sum()
        rates = np.stack([((1 - q) @ votes + 0.05) / (n0 + 1), (q @ votes + 0.05) / (n1 + 1)], axis=1)
        if turn in (2, 8):
            r = votes - ((1 - q)[:, None] * rates[:, 0] + q[:, None] * rates[:, 1])
            cov = r.T @ r / len(votes)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            rho = np.clip(cov / sd[:, None] / sd[None, :], 0, 1) - np.eye(len(sd))
            w = 1 / (1 + np.where(rho > 0.1, rho, 0).sum(axis=1))
            w[-1] = 1
        on = w * np.log(rates[:, 1] / rates[:, 0])
        off = w * np.log((1 - rates[:, 1]) / (1 - rates[:, 0]))
        z = np.log(prior / (1 - prior)) + votes @ (on - off) + off.sum()
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return q, rates, w


def _linear(doc: np.ndarray, f: np.ndarray, n: int, width: int, target: np.ndarray, told: np.ndarray, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on the features and two of the number of strong words, by gradient steps with momentum."""
    more = _counts(told)
    w, b = np.zeros(width + 2), float(np.log(target.mean() / (1 - target.mean())))
    m, v = np.zeros(width + 3), np.zeros(width + 3)
    for t in range(1, steps + 1):
        z = np.bincount(doc, w[f], n) + more @ w[width:] + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        grad = np.concatenate([np.bincount(f, g[doc], width) + 1e-5 * w[:width], g @ more + 1e-6 * w[width:], [g.sum()]])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def _counts(told: np.ndarray) -> np.ndarray:
    return np.stack([np.log1p(told), told >= 2], axis=1).astype(float)


def _scores(m: Model, lookup: np.ndarray, texts: pa.Array) -> np.ndarray:
    """The score of each text of a column."""
    n_c = len(m.buckets)
    width = n_c + len(PATTERNS)
    score = np.zeros(len(texts))
    for at, block in kernel.blocks(texts, kernel.LETTERS, latin=True):
        doc, i, told = _known(block, lookup, m.strong)
        z = np.bincount(doc, m.weights[i], block.n) + _patterns(block) @ m.weights[n_c:width] + _counts(told) @ m.weights[width:] + m.bias
        score[at : at + block.n] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return score


def predict(docs: DataFrame, model: Model, doc: str = "doc_id", text: str = "text", also: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, the columns of also, and score in [0, 1].

    Null and empty texts get the score of a text without features, very long
    ones are read whole, repeated rows each have their row, and an empty table
    none. Other columns aren't read, so none can clash.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc).alias("doc_id"), *[c.alias(k) for k, c in (also or {}).items()], F.col(text).alias("text"))
    names = rows.columns[:-1]

    def each(batches):
        lookup = _lookup(shared.value.buckets)
        for batch in batches:
            score = _scores(shared.value, lookup, batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(names))], pa.array(score)], names=[*names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(names)]) + ", score double"
    return rows.mapInArrow(each, schema)


def clean(docs: DataFrame, model: Model, reject: float = 0.7, text: str = "text") -> DataFrame:
    """docs without the rows that score reject or more; all columns stay, whatever their names.

    Null and empty texts have the score of a text without features, so they
    stay unless the model rejects that. Repeated rows go or stay together.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def each(batches):
        lookup = _lookup(shared.value.buckets)
        for batch in batches:
            yield batch.filter(pa.array(_scores(shared.value, lookup, batch.column(at)) < reject))

    return docs.mapInArrow(each, docs.schema)


def training_rows(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, text, label): all documents with a label whose crc32(doc_id as text) modulo parts isn't held. Of several labels of an id the largest counts.

    Most texts without a label are dropped where they are read; the join
    decides, by shuffle at every size. The result is staged.
    """
    mine = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % parts != held))
    mine = stage(mine.groupBy("doc_id").agg(F.max("toxic").alias("label")))
    return stage(sieved(docs.select("doc_id", "text"), mine, "doc_id").join(mine.hint("merge"), "doc_id").select("doc_id", "text", "label"))
