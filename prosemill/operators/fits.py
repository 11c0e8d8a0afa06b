"""Logistic regressions of many sets of columns, folds and labels at once.

All models take Newton's steps together: a step is one scan of the rows, which
adds up each model's loss, gradient and curvature where the rows are, and one
sum of these by model. So the number of jobs is that of the steps, whatever the
number of sets, folds, pairs of classes or permutations of the labels. A
fold's model learns from all other folds; means, deviations and the fit of
covariates that are taken out first come from sums by fold, the fold's own left
out. What the driver holds is the models, never rows or groups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as St

from prosemill.sources import dropped, ship, staged

#: Labels of a model whose sums are one row of the shuffle, and rows that are worked on at once.
CHUNK, ROWS = 64, 2048
#: Steps at most, and the longest step after which a model is done.
STEPS, DONE = 60, 1e-7


@dataclass(frozen=True)
class Fit:
    """A regression: columns, label, covariates whose least-squares fit is taken out of the columns first.

    y names a column of 0 and 1, or of arrays of these, a model for each entry;
    null leaves the row out. With more than two classes it holds 0 to classes - 1.
    """

    name: str
    cols: tuple[str, ...]
    y: str = "y"
    covs: tuple[str, ...] = ()
    classes: int = 2


def _upper(d: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(d)


def _terms(z: np.ndarray, y: np.ndarray, beta: np.ndarray, classes: int) -> np.ndarray:
    """A row for each label: loss, gradient and upper half of the curvature of its rows."""
    d, parts = z.shape[1], None
    for s in range(0, len(z), ROWS):
        a, b = z[s : s + ROWS], y[s : s + ROWS]
        eta = a @ beta
        if classes > 2:
            top = eta.max(axis=1, keepdims=True)
            e = np.exp(eta - top)
            p = e / e.sum(axis=1, keepdims=True)
            hit = b[:, :1] == np.arange(classes)
            loss = (np.log(e.sum(axis=1)) + top[:, 0] - eta[hit]).sum()
            g = (a.T @ (hit - p)).T.ravel()
            h = np.zeros((classes * d, classes * d))
            for i in range(classes):
                for j in range(i, classes):
                    block = (a * (p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ a
                    h[i * d : i * d + d, j * d : j * d + d] = block
                    h[j * d : j * d + d, i * d : i * d + d] = block.T
            out = np.concatenate(([loss], g, h[_upper(classes * d)]))[None, :]
        else:
            p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
            loss = (np.logaddexp(0, eta) - b * eta).sum(axis=0)
            i, j = _upper(d)
            out = np.column_stack([loss, (a.T @ (b - p)).T, ((a[:, i] * a[:, j]).T @ (p * (1 - p))).T])
        parts = out if parts is None else parts + out
    return parts


class Fitted:
    """Models by fit and held-out fold (None: of all rows)."""

    def __init__(self, fits: list[Fit], cols: list[str], folds: list, fold: str, kind: str):
        self.fits, self.cols, self.folds, self.fold, self.kind = {f.name: f for f in fits}, cols, folds, fold, kind
        #: (fit, held-out fold) -> weights on 1 and the columns as they are, a row for each label or class; none if a class is missing.
        self.weights: dict[tuple, np.ndarray] = {}
        #: The same on standardised columns, and their deviations.
        self.standard: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

    def scored(self, df: DataFrame, names: list[str] | None = None) -> DataFrame:
        """df with z__<name>: the score of the model that held out the row's fold, or of the only one; an array with a score for each class if there are more than two. Null if there is no model or a column is null. Of several labels it is the first's."""
        names = names or list(self.fits)
        told = lambda n, k: [*map(float, self.weights[n, k][: self.fits[n].classes if self.fits[n].classes > 2 else 1].ravel())] if (n, k) in self.weights and not np.isnan(self.weights[n, k][0, 0]) else None
        if self.folds == [None]:
            row = {n: told(n, None) for n in names}
            out = df.withColumns({f"__w_{n}": F.array(*map(F.lit, w)) if w else F.lit(None).cast("array<double>") for n, w in row.items()})
        else:
            rows = [(k, *(told(n, k) for n in names)) for k in self.folds]
            w = df.sparkSession.createDataFrame(rows, f"__fold {self.kind}, " + ", ".join(f"`__w_{n}` array<double>" for n in names))
            out = df.join(F.broadcast(w), F.col(self.fold) == F.col("__fold"), "left").drop("__fold")  # a row for each fold
        size = len(self.cols) + 1

        def score(n: str, row: int):
            used = [0, *(i + 1 for i, c in enumerate(self.cols) if c in (*self.fits[n].cols, *self.fits[n].covs))]
            x = F.array(*[F.col(self.cols[i - 1]).cast("double") if i else F.lit(1.0) for i in used])
            w = F.array(*[F.get(F.col(f"__w_{n}"), F.lit(row * size + i)) for i in used])
            return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

        many = {n: self.fits[n].classes for n in names}
        z = {f"z__{n}": score(n, 0) if many[n] == 2 else F.when(score(n, 0).isNotNull(), F.array(*[score(n, r) for r in range(many[n])])) for n in names}
        return out.withColumns(z).drop(*[f"__w_{n}" for n in names])

    def predicted(self, df: DataFrame, as_: dict[str, str]) -> DataFrame:
        """The rows of df that all the named fits have a model for, with the predicted class. as_: columns by fit."""
        out = self.scored(df, list(as_))
        has = [F.col(f"z__{n}").isNotNull() for n in as_]
        for h in has:
            out = out.where(h)
        one = lambda n: F.col(f"z__{n}")
        which = {c: ((one(n) > 0) if self.fits[n].classes == 2 else F.array_position(one(n), F.array_max(one(n))) - 1).cast("int") for n, c in as_.items()}
        return out.withColumns(which).drop(*[f"z__{n}" for n in as_])


def _packed(df: DataFrame, fits: list[Fit], cols: list[str], fold: str | None, folds: list) -> tuple[DataFrame, dict[str, tuple[int, int]]]:
    """(f, x, l): the number of the fold, the columns and all labels of each row that has all columns; where each label stands in l."""
    at, parts, n = {}, [], 0
    for y in dict.fromkeys(f.y for f in fits):
        many = isinstance(df.schema[y].dataType, St.ArrayType)
        size = (df.select(F.size(y).alias("n")).where("n >= 0").first() or [0])[0] if many else 1
        at[y] = (n, size)
        n += size
        gone = F.array_repeat(F.lit(-1), size)
        parts.append(F.coalesce(F.col(y).cast("array<int>"), gone) if many else F.array(F.coalesce(F.col(y).cast("int"), F.lit(-1))))
    number = F.lit(0) if fold is None else (F.array_position(F.array(*map(F.lit, folds)), F.col(fold)) - 1).cast("int")
    x = F.array(*[F.col(c).cast("double") for c in cols])
    whole = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in cols]
    for w in whole:
        df = df.where(w)
    return staged(df.select(number.alias("f"), x.alias("x"), F.concat(*parts).cast("array<tinyint>").alias("l"))), at


def _arrays(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = batch.num_rows
    return batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1), batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _summed(rows: DataFrame, each, keys: list[str]) -> DataFrame:
    """each(f, x, l) of every batch gives {keys: vector}; a task adds these up, and then all tasks' by keys."""

    def of_task(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for k, v in each(*_arrays(batch)):
                    held[k] = held[k] + v if k in held else v
        if held:
            made = [pa.array([k[i] for k in held], pa.int32()) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*made, pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], names=[*keys, "v"])

    sums = rows.mapInArrow(of_task, ", ".join(f"{k} int" for k in keys) + ", v array<double>")
    return sums.groupBy(*keys).agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("v")))).alias("v"))


def _design(s: np.ndarray, cols: list[int], covs: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """From the training rows' products of (1, columns): what makes (1, standardised columns) of (1, columns), and the deviations."""
    n, d = s[0, 0], len(cols)
    t = np.zeros((len(s), d))
    t[cols, range(d)] = 1
    if covs:
        c = [0, *covs]
        t[c] -= np.linalg.lstsq(s[np.ix_(c, c)], s[np.ix_(c, cols)], rcond=None)[0]
    mean = s[0] @ t / n
    var = (np.einsum("ij,ik,kj->j", t, s, t) - n * mean**2) / max(1, n - 1)
    flat = var <= 1e-12 * np.maximum(1e-300, np.diag(s)[cols] / n)
    dev = np.sqrt(np.where(flat, 1, var))
    t[0] -= mean
    a = np.zeros((len(s), d + 1))
    a[0, 0] = 1
    a[:, 1:] = np.where(flat, 0, t / dev)
    return a, np.where(flat, 0, dev)


def fit_all(df: DataFrame, fits: list[Fit], fold: str | None = None, c: float = 1.0, keep: bool = False) -> Fitted:
    """Every fit, for each fold from the rows of all others, or from all rows without fold.

    The loss is that of all rows and half the squared weights, over c, on
    columns less their mean over their sample deviation; a constant column has
    no weight. Rows with a null in any column, or in fold, take no part; a model
    without rows of every class is missing. keep: leave the packed rows for
    confusions() in Fitted.rows.
    """
    ship(df.sparkSession)
    cols = list(dict.fromkeys(x for f in fits for x in (*f.cols, *f.covs)))
    folds = [None] if fold is None else sorted(r[0] for r in df.select(fold).where(F.col(fold).isNotNull()).distinct().collect())
    kind = "int" if fold is None else df.schema[fold].dataType.simpleString()
    out = Fitted(fits, cols, folds, fold or "", kind)
    rows, at = _packed(df if fold is None else df.where(F.col(fold).isNotNull()), fits, cols, fold, folds)
    labels = list(at)
    classes = {y: max(f.classes for f in fits if f.y == y) for y in labels}
    mean = np.array([v or 0.0 for v in rows.agg(*[F.avg(F.get("x", F.lit(i))) for i in range(len(cols))]).first()])

    def moments(f, x, l):  # noqa: E741
        one = np.column_stack([np.ones(len(x)), x - mean])
        for i, y in enumerate(labels):
            first, size = at[y]
            for k in np.unique(f):
                m = (f == k) & (l[:, first] >= 0) if size else np.zeros(len(f), bool)
                if m.any():
                    counts = [(l[m, first : first + size] == v).sum(axis=0) for v in range(classes[y])]
                    yield (i, int(k)), np.concatenate([(one[m].T @ one[m]).ravel(), *counts]).astype(float)

    by = {(r["y"], r["f"]): np.array(r["v"]) for r in _summed(rows, moments, ["y", "f"]).collect()}
    p = len(cols) + 1
    models: dict[tuple[int, int], tuple] = {}  # (fit, held-out fold) -> design, deviations, label's place
    for i, f in enumerate(fits):
        for k in range(len(folds)):
            mine = [v for (y, g), v in by.items() if labels[y] == f.y and (fold is None or g != k)]
            if not mine:
                continue
            s = sum(mine)
            counts = s[p * p :].reshape(classes[f.y], -1)[: f.classes]
            if f.classes > 2 and (counts == 0).any():
                continue
            if f.classes == 2 and not (counts > 0).all(axis=0).any():
                continue
            where = lambda names: [cols.index(x) + 1 for x in names]
            models[i, k] = (*_design(s[: p * p].reshape(p, p), where(f.cols), where(f.covs)), at[f.y], (counts > 0).all(axis=0))
    beta = {m: np.zeros((v[0].shape[1], fits[m[0]].classes if fits[m[0]].classes > 2 else v[2][1])) for m, v in models.items()}
    before = {m: b.copy() for m, b in beta.items()}
    loss = {m: np.full(b.shape[1] if fits[m[0]].classes == 2 else 1, np.inf) for m, b in beta.items()}
    open_ = {m: v[3].copy() if fits[m[0]].classes == 2 else np.ones(1, bool) for m, v in models.items()}

    for _ in range(STEPS):
        now = {m: beta[m] for m in models if open_[m].any()}
        if not now:
            break
        design = {m: models[m][0] for m in now}
        place = {m: models[m][2] for m in now}
        many = [f.classes for f in fits]

        def terms(f, x, l, now=now, design=design, place=place):  # noqa: E741
            one = np.column_stack([np.ones(len(x)), x - mean])
            for (i, k), b in now.items():
                first, size = place[i, k]
                m = l[:, first] >= 0
                m = m if fold is None else m & (f != k)
                if m.any():
                    t = _terms(one[m] @ design[i, k], l[m, first : first + size].astype(float), b, many[i])
                    for chunk in range(0, len(t), CHUNK):
                        yield (i, k, chunk // CHUNK), t[chunk : chunk + CHUNK].ravel()

        def solved(frames, now=now):
            for frame in frames:
                told = []
                for i, k, chunk, v in zip(frame["i"], frame["k"], frame["c"], frame["v"], strict=True):
                    b = now[i, k]
                    b = b.T.ravel()[None, :] if many[i] > 2 else b.T[chunk * CHUNK : (chunk + 1) * CHUNK]
                    d = b.shape[1]
                    free = np.tile(np.arange(now[i, k].shape[0]) == 0, d // now[i, k].shape[0])  # intercepts
                    t = np.asarray(v).reshape(len(b), -1)
                    held = np.where(free, 0, b) / c
                    h = np.zeros((len(b), d, d))
                    u = _upper(d)
                    h[:, u[0], u[1]] = h[:, u[1], u[0]] = t[:, 1 + d :]
                    h[:, range(d), range(d)] += np.where(free, 0, 1 / c)
                    g = t[:, 1 : 1 + d] - held
                    step = np.stack([np.linalg.lstsq(h[r], g[r], rcond=1e-13)[0] for r in range(len(b))])
                    told.append((i, k, chunk, (t[:, 0] + (held * b).sum(axis=1) / 2).tolist(), step.ravel().tolist()))
                yield pd.DataFrame(told, columns=["i", "k", "c", "loss", "step"])

        sums = _summed(rows, terms, ["i", "k", "c"])
        for r in sums.mapInPandas(solved, "i int, k int, c int, loss array<double>, step array<double>").collect():
            m, s = (r["i"], r["k"]), slice(r["c"] * CHUNK, (r["c"] + 1) * CHUNK)
            if many[m[0]] > 2:
                part, step, s = beta[m].T.ravel()[None, :], np.array(r["step"])[None, :], slice(0, 1)
                was = before[m].T.ravel()[None, :]
            else:
                part, step, was = beta[m].T[s], np.array(r["step"]).reshape(len(r["loss"]), -1), before[m].T[s]
            new, on = np.array(r["loss"]), open_[m][s]
            worse = new > loss[m][s] + 1e-10 * (1 + np.abs(loss[m][s]))
            short = np.abs(step).max(axis=1) < DONE
            went = np.where((on & ~worse)[:, None], part + step, np.where((on & worse)[:, None], (part + was) / 2, part))
            stay = np.where((on & ~worse)[:, None], part, was)
            loss[m][s] = np.where(on & ~worse, new, loss[m][s])
            open_[m][s] = on & ~(short & ~worse)
            if many[m[0]] > 2:
                beta[m], before[m] = went.reshape(many[m[0]], -1).T, stay.reshape(many[m[0]], -1).T
            else:
                beta[m][:, s], before[m][:, s] = went.T, stay.T

    for (i, k), (a, dev, _, ok) in models.items():
        w = (a @ beta[i, k]).T
        w[:, 0] -= w[:, 1:] @ mean
        if fits[i].classes == 2:
            w[~ok] = np.nan
        out.weights[fits[i].name, folds[k]] = w
        out.standard[fits[i].name, folds[k]] = (beta[i, k].T, dev)
    out.rows, out.at = (rows, at) if keep else (None, at)
    if not keep:
        dropped(rows)
    return out


def confusions(fitted: Fitted, name: str) -> np.ndarray:
    """(labels, folds, 4): rows of each held-out fold by truth and prediction, n00, n01, n10, n11, for each label of a fit; one scan of the kept rows."""
    first, size = fitted.at[fitted.fits[name].y]
    weights = {k: fitted.weights.get((name, v)) for k, v in enumerate(fitted.folds)}

    def counts(f, x, l):  # noqa: E741
        for k in np.unique(f):
            w = weights[int(k)]
            m = (f == k) & (l[:, first] >= 0)
            if w is None or not m.any():
                continue
            hit = np.column_stack([np.ones(m.sum()), x[m]]) @ w.T > 0
            y = l[m, first : first + size] == 1
            for chunk in range(0, size, CHUNK):
                a, b = hit[:, chunk : chunk + CHUNK], y[:, chunk : chunk + CHUNK]
                yield (int(k), chunk // CHUNK), np.stack([(~b & ~a).sum(axis=0), (~b & a).sum(axis=0), (b & ~a).sum(axis=0), (b & a).sum(axis=0)]).astype(float).ravel()

    out = np.zeros((size, len(fitted.folds), 4))
    for r in _summed(fitted.rows, counts, ["k", "c"]).collect():
        v = np.array(r["v"]).reshape(4, -1)
        out[r["c"] * CHUNK : r["c"] * CHUNK + v.shape[1], r["k"]] = v.T
    missing = np.array([[weights[k] is None or np.isnan(weights[k][r, 0]) for k in range(len(fitted.folds))] for r in range(size)])
    out[missing] = np.nan
    return out
