"""Regression trees per series for all folds at once (ML3-ML5, ML16).

A series has one row per month, so what a task holds at a time is bounded by
the calendar, not by the data: the panel is shuffled once by series, and every
(series, target kind) is one group. Within a group all folds (and many trees
of a forest) grow together, level by level, as array operations: node sums per
(fold, tree, node, feature value) from a ``bincount``, split gains from their
cumulative sums, the best per node. A fold trains on its own rows only; values
that none of them has change nothing.

Splits are exact (between neighbouring values that occur in the node). Gains
are sums of squares over weights plus the leaf penalty, leaf values
G / (W + penalty), so forests and plain boosting have penalty 0 and the
penalised variant L2 on its leaves. Random choices are hashes of (seed, fold,
tree, ...), the same for every run and independent of other folds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of node sums held at a time.
CELLS = 3_000_000
#: Tasks that the groups are spread over at most.
MOST_TASKS = 20_000


@dataclass(frozen=True)
class TreeSettings:
    """Settings of one tree model; see ``backtest.TREE_PROFILES``."""

    boosted: bool
    num_trees: int
    max_depth: int
    min_leaf: int = 1
    learning_rate: float = 1.0
    #: share of the rows per boosting round, drawn without replacement
    subsample: float = 1.0
    #: features a tree (boosted) or a node (forest) may use: "all", "sqrt" or a share
    feature_subset: str = "all"
    l2: float = 0.0
    #: forests draw as many rows as there are, with replacement
    bootstrap: bool = True
    seed: int = 42

    def n_features(self, p: int) -> int:
        if self.feature_subset == "all":
            return p
        if self.feature_subset == "sqrt":
            return max(1, int(p**0.5))
        return max(1, int(float(self.feature_subset) * p))


def _hash(*parts) -> np.ndarray:
    """64 bits of whole numbers (arrays broadcast against each other)."""
    out = np.uint64(0x243F6A8885A308D3)
    for part in parts:
        with np.errstate(over="ignore"):
            out = (out ^ np.asarray(part).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out = out ^ (out >> np.uint64(29))
            out = out * np.uint64(0xBF58476D1CE4E5B9)
            out = out ^ (out >> np.uint64(32))
    return out


def _lowest(keys: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """True for the ``n`` lowest of each row."""
    order = np.argsort(keys, axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(keys.shape[1]), keys.shape), axis=1)
    return rank < np.reshape(n, (-1, 1))


class Bins:
    """Distinct values of every feature as cells of one long axis."""

    def __init__(self, x: np.ndarray):
        self.x, values, cells, start = x, [], np.zeros(x.shape, dtype=np.int64), 0
        starts = []
        for j in range(x.shape[1]):
            distinct, code = np.unique(x[:, j], return_inverse=True)
            values.append(distinct)
            cells[:, j] = start + code
            starts.append(start)
            start += len(distinct)
        self.cells, self.values, self.n = cells, np.concatenate(values), start
        self.feature = np.repeat(np.arange(x.shape[1]), np.diff([*starts, start]))


def grow(bins: Bins, w: np.ndarray, r: np.ndarray, s: TreeSettings, allowed: np.ndarray | None = None,
         names: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One tree per row of the weights ``w`` (fits x rows) on targets ``r``:
    predictions of all rows and the gain per feature (fits x features).
    ``allowed``: features a fit may use; ``names``: hashes that name the fits,
    for the choice of features per node."""
    fits, n = w.shape
    p, size = bins.x.shape[1], bins.n
    unit = bool(((w == 0) | (w == 1)).all())
    fi, ii = np.nonzero(w > 0)
    ww, wr = w[fi, ii], w[fi, ii] * r[fi, ii]
    noise = 1e-12 * np.bincount(fi, wr * r[fi, ii], minlength=fits)  # gains this close are ties
    slot = np.repeat(np.arange(fits)[:, None], n, axis=1)
    fit_of, heap = np.arange(fits), np.ones(fits, dtype=np.int64)
    value = np.bincount(fi, wr, minlength=fits) / np.maximum(np.bincount(fi, ww, minlength=fits) + s.l2, 1e-300)
    live = np.bincount(fi, minlength=fits) >= 2 * s.min_leaf
    gains = np.zeros((fits, p))
    for _ in range(s.max_depth):
        slots = np.flatnonzero(live)
        if not len(slots):
            break
        number = np.cumsum(live) - 1
        inside = live[slot[fi, ii]]
        fi, ii, ww, wr = fi[inside], ii[inside], ww[inside], wr[inside]
        at_slot = number[slot[fi, ii]]
        flat = (at_slot[:, None] * size + bins.cells[ii]).ravel()
        cells = len(slots) * size
        count = np.bincount(flat, minlength=cells)
        held = np.flatnonzero(count)  # (node, feature value) that occur, in order
        count = count[held]
        of_slot = held // size
        cell = held - of_slot * size
        on = bins.feature[cell]
        starts = np.flatnonzero(np.diff(of_slot * p + on, prepend=-1))
        lengths = np.diff(starts, append=len(held))

        def left(sums: np.ndarray) -> np.ndarray:
            """Sums up to and with each value, within its node and feature."""
            c = np.cumsum(sums)
            return c - np.repeat(c[starts] - sums[starts], lengths)

        def of_rows(v: np.ndarray | None) -> np.ndarray:
            return np.bincount(at_slot, v, minlength=len(slots))

        n_left, n_all = left(count), of_rows(None)
        w_left, w_all = (n_left, n_all) if unit else (
            left(np.bincount(flat, np.repeat(ww, p), minlength=cells)[held]), of_rows(ww))
        r_left, r_all = left(np.bincount(flat, np.repeat(wr, p), minlength=cells)[held]), of_rows(wr)
        fit = (n_left >= s.min_leaf) & (n_all[of_slot] - n_left >= s.min_leaf)
        if allowed is not None:
            fit &= allowed[fit_of[slots]][of_slot, on]
        elif names is not None and s.n_features(p) < p:
            keys = _hash(names[fit_of[slots]][:, None], heap[slots][:, None], np.arange(p)[None, :])
            fit &= _lowest(keys, s.n_features(p))[of_slot, on]
        with np.errstate(divide="ignore", invalid="ignore"):
            score = r_left**2 / (w_left + s.l2) + (r_all[of_slot] - r_left) ** 2 / (w_all[of_slot] - w_left + s.l2)
        score[~fit] = -np.inf
        most = np.maximum.reduceat(score, np.flatnonzero(np.diff(of_slot, prepend=-1)))
        gain = most - r_all**2 / (w_all + s.l2)
        cut = np.flatnonzero(gain > noise[fit_of[slots]])
        if not len(cut):
            break
        tops = np.flatnonzero(score >= (most - noise[fit_of[slots]])[of_slot])
        best = tops[np.searchsorted(of_slot[tops], cut)]  # the first of each node
        feature, threshold = on[best], (bins.values[cell[best]] + bins.values[cell[best + 1]]) / 2
        np.add.at(gains, (fit_of[slots[cut]], feature), gain[cut])

        # every row, in the fit or not, goes to its side
        first = len(value)
        split_on, limit, child = np.full(first, -1), np.zeros(first), np.zeros(first, dtype=np.int64)
        split_on[slots[cut]], limit[slots[cut]] = feature, threshold
        child[slots[cut]] = first + 2 * np.arange(len(cut))
        fa, ia = np.nonzero(split_on[slot] >= 0)
        old = slot[fa, ia]
        slot[fa, ia] = child[old] + (bins.x[ia, split_on[old]] > limit[old])
        fit_of = np.concatenate([fit_of, np.repeat(fit_of[slots[cut]], 2)])
        heap = np.concatenate([heap, np.repeat(2 * heap[slots[cut]], 2) + np.tile([0, 1], len(cut))])
        total = len(fit_of)
        where = slot[fi, ii]
        sums = np.bincount(where, wr, minlength=total) / np.maximum(np.bincount(where, ww, minlength=total) + s.l2, 1e-300)
        value = np.concatenate([value, sums[first:]])
        live = np.bincount(where, minlength=total) >= 2 * s.min_leaf
        live[:first] = False
    return value[slot], gains


def forest(bins: Bins, y: np.ndarray, train: np.ndarray, s: TreeSettings) -> tuple[np.ndarray, np.ndarray]:
    """Mean of ``num_trees`` trees per fold (rows of ``train``: folds x rows)."""
    folds, n = train.shape
    mean = np.array([y[t].mean() if t.any() else 0.0 for t in train])
    counts = np.zeros((folds, s.num_trees, n), dtype=np.int16)
    for k in range(folds):
        rows = np.flatnonzero(train[k])
        if s.bootstrap and len(rows):
            drawn = np.random.default_rng([s.seed, k]).integers(0, len(rows), (s.num_trees, len(rows)))
            each = np.repeat(np.arange(s.num_trees), len(rows))
            counts[k] = np.bincount(each * n + rows[drawn].ravel(), minlength=s.num_trees * n).reshape(s.num_trees, n)
        else:
            counts[k] = train[k]
    nodes = min(2 ** (s.max_depth - 1), max(1, n // (2 * s.min_leaf)))
    step = max(1, int(CELLS // (folds * nodes * bins.n)))
    total, gains = np.zeros((folds, n)), np.zeros((folds, bins.x.shape[1]))
    for at in range(0, s.num_trees, step):
        w = counts[:, at:at + step].astype(float)
        trees = w.shape[1]
        names = _hash(s.seed, np.arange(folds)[:, None], np.arange(at, at + trees)[None, :]).ravel()
        r = np.repeat(y[None, :] - mean[:, None], trees, axis=0)
        out, g = grow(bins, w.reshape(-1, n), r, s, names=names)
        total += out.reshape(folds, trees, n).sum(axis=1)
        whole = g.sum(axis=1, keepdims=True)
        gains += (g / np.where(whole > 0, whole, 1)).reshape(folds, trees, -1).sum(axis=1)
    return mean[:, None] + total / s.num_trees, gains


def boosting(bins: Bins, y: np.ndarray, train: np.ndarray, s: TreeSettings) -> tuple[np.ndarray, np.ndarray]:
    """``num_trees`` rounds per fold, each a tree on the residuals so far."""
    folds, n = train.shape
    p = bins.x.shape[1]
    start = np.array([y[t].mean() if t.any() else 0.0 for t in train])
    out, gains = np.repeat(start[:, None], n, axis=1), np.zeros((folds, p))
    size = (s.subsample * train.sum(axis=1)).astype(int)
    for m in range(s.num_trees):
        w = train
        if s.subsample < 1:
            keys = _hash(s.seed, 1, np.arange(folds)[:, None], m, np.arange(n)[None, :])
            w = _lowest(np.where(train, keys >> np.uint64(1), np.uint64(2**64 - 1)), size)
        allowed = None
        if s.n_features(p) < p:
            allowed = _lowest(_hash(s.seed, 2, np.arange(folds)[:, None], m, np.arange(p)[None, :]), s.n_features(p))
        step, g = grow(bins, w.astype(float), y[None, :] - out, s, allowed)
        out += s.learning_rate * step
        gains += g
    return out, gains


def fitted(x: np.ndarray, y: np.ndarray, train: np.ndarray, s: TreeSettings) -> tuple[np.ndarray, np.ndarray]:
    """Predictions of all rows (folds x rows) and the features' shares of the
    gain (folds x features; zeros where nothing was split)."""
    out, gains = (boosting if s.boosted else forest)(Bins(x), y, train, s)
    whole = gains.sum(axis=1, keepdims=True)
    return out, gains / np.where(whole > 0, whole, 1)


def _spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` in as many partitions as it has groups (``MOST_TASKS`` at most):
    the rows are few and the work per group is large."""
    groups = df.select(*keys).distinct().count()
    return df.repartition(max(1, min(groups, MOST_TASKS)), *keys)


def _arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels, and which rows have all features; gaps as 0."""
    x = np.array([np.asarray(v, dtype=float) for v in pdf["x"]]).reshape(len(pdf), -1)
    whole = ~np.isnan(x).any(axis=1)
    return np.nan_to_num(x, nan=0.0), pdf["y"].to_numpy(dtype=float, na_value=np.nan), whole


def _schema(df: DataFrame, keys: Sequence[str], more: str) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", " + more


def fold_predictions(df: DataFrame, keys: Sequence[str], s: TreeSettings, x: str = "x", y: str = "y",
                     t: str = "t", eligible: str = "eligible") -> DataFrame:
    """Every fold of a planned frame (``c0``, ``step``, ``K``, ``h``): one
    model per group and fold, trained on the eligible rows before its cutoff;
    returns (keys, t, k, pred_target, importance) of the rows it scores.
    Folds without training rows give none."""
    keys = list(keys)

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable")
        features, labels, whole = _arrays(pdf)
        at, usable = pdf["t"].to_numpy(), pdf["eligible"].to_numpy(dtype=bool) & whole
        c0, step, folds, h = (int(pdf[c].iloc[0]) for c in ("c0", "step", "K", "h"))
        cuts = c0 + step * np.arange(folds)
        train = usable[None, :] & (at[None, :] < cuts[:, None])
        out, shares = fitted(features, labels, train, s)
        scored = whole[None, :] & (at[None, :] >= cuts[:, None]) & (at[None, :] < cuts[:, None] + h)
        k, i = np.nonzero(scored & train.any(axis=1)[:, None])
        return pd.DataFrame({c: pdf[c].to_numpy(dtype=object)[:1].repeat(len(k)) for c in keys} | {
            "t": at[i], "k": k.astype("int32"), "pred_target": out[k, i],
            "importance": pd.Series([shares[f].tolist() for f in k], dtype=object)})

    rows = df.select(*keys, F.col(t).cast("long").alias("t"), F.col(x).alias("x"), F.col(y).cast("double").alias("y"),
                     F.col(eligible).alias("eligible"), "c0", "step", "K", "h")
    return _spread(rows, keys).groupBy(*keys).applyInPandas(
        group, _schema(df, keys, "t bigint, k int, pred_target double, importance array<double>"))


def split_predictions(df: DataFrame, keys: Sequence[str], s: TreeSettings, t: str = "t") -> DataFrame:
    """One model per group, trained on the rows with ``split`` 'train':
    (keys, t, prediction, importance) of all rows."""
    keys = list(keys)

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable")
        features, labels, whole = _arrays(pdf)
        train = ((pdf["split"] == "train").to_numpy() & whole & ~np.isnan(labels))[None, :]
        keep = whole if train.any() else np.zeros(len(pdf), dtype=bool)
        out, shares = fitted(features, labels, train, s)
        return pd.DataFrame({c: pdf[c].to_numpy(dtype=object)[:1].repeat(int(keep.sum())) for c in keys} | {
            "t": pdf["t"].to_numpy()[keep], "prediction": out[0][keep],
            "importance": pd.Series([shares[0].tolist()] * int(keep.sum()), dtype=object)})

    rows = df.select(*keys, F.col(t).cast("long").alias("t"), "x", F.col("y").cast("double").alias("y"), "split")
    return _spread(rows, keys).groupBy(*keys).applyInPandas(
        group, _schema(df, keys, "t bigint, prediction double, importance array<double>"))


def settings(kind: str, profiles: dict, profile: str = "delevel", seed: int = 42, **params) -> TreeSettings:
    """Settings of ``kind`` in ``profile``; keyword arguments override single
    ones (None leaves them). An unknown kind is a ValueError."""
    if kind not in ("forest", "boosting", "boosting_colsample"):
        raise ValueError(f"unknown tree model {kind}")
    known = dict(profiles[profile].get(kind) or profiles["level"][kind])
    known.update({k: v for k, v in params.items() if v is not None})
    return replace(TreeSettings(kind != "forest", 0, 0, seed=seed), **known)
