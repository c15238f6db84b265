"""Forecasters: one model per series. Targets are changes from the last reading unless said otherwise.

Persistence and conditional quantiles are plain aggregations. Learners fit in grouped functions, a series at a time, in
numpy; a fit that fails is a row with its status, not an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import d, normal_z


def persistence(df: DataFrame, value: str = "occ") -> DataFrame:
    return df.withColumn("yhat", F.col(value))


def quantile_band(df: DataFrame, y: str, value: str, group: str, alpha: float, *keys: str) -> DataFrame:
    """low and high: the reading plus the alpha/2 and 1 - alpha/2 quantiles of train changes in the row's group, or of the
    series for a group that train lacks."""
    change = F.col(y) - F.col(value)
    train = df.filter("split = 'train'")
    cuts = [F.percentile(change, d(p)) for p in (alpha / 2, 1 - alpha / 2)]
    own = train.groupBy(*keys, group).agg(cuts[0].alias("__lo"), cuts[1].alias("__hi"))
    all_ = train.groupBy(*keys).agg(cuts[0].alias("__alo"), cuts[1].alias("__ahi"))
    joined = df.join(own, [*keys, group], "left").join(all_, list(keys))
    return joined.withColumn("low", F.col(value) + F.coalesce("__lo", "__alo")).withColumn("high", F.col(value) + F.coalesce("__hi", "__ahi")).drop("__lo", "__hi", "__alo", "__ahi")


def gaussian_band(df: DataFrame, mu: str, sigma: str, alpha: float, value: str = "occ") -> DataFrame:
    z = d(normal_z(alpha))
    return df.withColumn("low", F.col(value) + F.col(mu) - z * F.col(sigma)).withColumn("high", F.col(value) + F.col(mu) + z * F.col(sigma))


# Learners: (x, y, options) to a function of x. They are small on purpose; no outside library is needed.


def ridge(x, y, penalty: float = 1.0):
    """Normal equations with an unpenalised intercept."""
    import numpy as np

    mx, my = x.mean(0), y.mean()
    w = np.linalg.solve((x - mx).T @ (x - mx) + penalty * np.eye(x.shape[1]), (x - mx).T @ (y - my))
    return lambda z: (z - mx) @ w + my


def _tree(x, y, depth: float, leaf: int, rng, tries: int, value: Callable):
    """A regression tree by variance, over quantile cuts; a nested tuple."""
    import numpy as np

    if depth == 0 or len(y) < 2 * leaf or np.ptp(y) == 0:
        return value(y)
    tried = rng.permutation(x.shape[1])[:tries]
    columns = np.ascontiguousarray(x[:, tried].T)
    order = np.argsort(columns, axis=1, kind="stable")
    v, t = np.take_along_axis(columns, order, 1), y[order]
    n = np.arange(1, len(y))
    left, total = np.cumsum(t, axis=1)[:, :-1], t.sum(axis=1, keepdims=True)
    gain = left**2 / n + (total - left) ** 2 / (len(y) - n)
    gain[(v[:, 1:] == v[:, :-1]) | (n < leaf) | (len(y) - n < leaf)] = -np.inf
    f, k = divmod(int(gain.argmax()), len(y) - 1)
    if not np.isfinite(gain[f, k]):
        return value(y)
    # the middle of neighbouring doubles can be the upper one, which would leave a side empty
    cut = (v[f, k] + v[f, k + 1]) / 2
    best = gain[f, k], tried[f], cut if cut < v[f, k + 1] else v[f, k]
    side = x[:, best[1]] <= best[2]
    return best[1], best[2], _tree(x[side], y[side], depth - 1, leaf, rng, tries, value), _tree(x[~side], y[~side], depth - 1, leaf, rng, tries, value)


def _walk(tree, x):
    import numpy as np

    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    out, side = np.empty(len(x)), x[:, tree[0]] <= tree[1]
    out[side], out[~side] = _walk(tree[2], x[side]), _walk(tree[3], x[~side])
    return out


#: Gains that differ by less are equal; the first feature and the lowest cut win.
TIE = 1e-9


def _grown(x, y, rows, leaf: int, depth: float):
    """Regression trees by variance on the rows of each (a row of `rows` is a tree), all of them level by level: of every
    node its feature (-1 in leaves), cut, left child (the right one comes next) and mean; the first nodes are the roots.
    A level costs one sort per feature, however many nodes and trees it has."""
    import numpy as np

    trees, m = rows.shape
    ranks = np.stack([np.unique(x[:, f], return_inverse=True)[1] for f in range(x.shape[1])])
    many = int(ranks.max()) + 1
    r, node, counts = rows.ravel(), np.repeat(np.arange(trees), m), np.full(trees, m)
    out, offset, level = [], 0, 0
    while len(counts):
        starts = np.cumsum(counts) - counts
        t = y[r]
        mean = np.add.reduceat(t, starts) / counts
        feature, cut, left = np.full(len(counts), -1), np.zeros(len(counts)), np.zeros(len(counts), np.int64)
        out.append((feature, cut, left, mean))
        open_ = (counts >= 2 * leaf) & (np.maximum.reduceat(t, starts) > np.minimum.reduceat(t, starts)) & (level < depth)
        if not open_.any():
            break
        inside = open_[node]
        r, number = r[inside], np.cumsum(open_) - 1
        c = t[inside] - mean[node[inside]]  # sums to the right are those to the left, negated
        node, n = number[node[inside]], counts[open_]
        starts = np.cumsum(n) - n
        before, after = np.arange(1, len(r) + 1) - starts[node], n[node] - (np.arange(1, len(r) + 1) - starts[node])
        roomy = (before >= leaf) & (after >= leaf)
        best, chosen, value = np.full(len(n), -np.inf), np.zeros(len(n), np.int64), np.zeros(len(n))
        for f in range(len(ranks)):
            rank = ranks[f, r]
            order = np.argsort(node * many + rank, kind="stable")
            rank, sums = rank[order], np.cumsum(c[order])
            sums -= np.concatenate(([0.0], sums[starts[1:] - 1]))[node]
            ok = roomy.copy()
            ok[:-1] &= rank[1:] != rank[:-1]
            gain = np.where(ok, sums * sums * (1 / before + 1 / np.maximum(1, after)), -np.inf)
            top = np.maximum.reduceat(gain, starts)
            better = top > best * (1 + TIE)
            if better.any():
                hit = np.flatnonzero((gain >= top[node] * (1 - TIE)) & better[node])
                which, first = np.unique(node[hit], return_index=True)
                at = hit[first]
                low, high = x[r[order[at]], f], x[r[order[at + 1]], f]
                middle = (low + high) / 2
                # the middle of neighbouring doubles can be the upper one, which would leave a side empty
                best[which], chosen[which], value[which] = top[which], f, np.where(middle < high, middle, low)
        split = np.isfinite(best)
        if not split.any():
            break
        offset += len(feature)
        place = np.flatnonzero(open_)[split]
        feature[place], cut[place], left[place] = chosen[split], value[split], offset + 2 * np.arange(int(split.sum()))
        going = split[node]
        r, node = r[going], node[going]
        node = 2 * (np.cumsum(split) - 1)[node] + (x[r, chosen[node]] > value[node])
        order = np.argsort(node, kind="stable")
        r, node = r[order], node[order]
        counts, level = np.bincount(node), level + 1
    return tuple(np.concatenate(parts) for parts in zip(*out, strict=True))


def forest(x, y, trees: int = 100, leaf: int = 2, depth: float = 12, seed: int = 42, rows=None):
    """Bagged trees. rows: draws the rows of a tree; by default a plain bootstrap."""
    import numpy as np

    rng = np.random.default_rng(seed)
    drawn = np.stack([rows() if rows else rng.integers(0, len(y), len(y)) for _ in range(trees)])
    feature, cut, left, mean = _grown(x, y, drawn, leaf, depth)

    def predict(z):
        out = np.zeros(len(z))
        for at in range(0, len(z), 4096):
            some = z[at : at + 4096]
            row, node = np.arange(len(some))[:, None], np.tile(np.arange(trees), (len(some), 1))
            while (inner := feature[node] >= 0).any():
                node = np.where(inner, left[node] + (some[row, feature[node]] > cut[node]), node)
            out[at : at + 4096] = mean[node].mean(1)
        return out

    return predict


def boosting(x, y, rounds: int = 200, rate: float = 0.1, depth: int = 3, leaf: int = 5, seed: int = 42, tau: float | None = None):
    """Gradient boosting for the mean, or for a quantile: trees follow the loss's gradient, leaves take the residuals'
    quantile."""
    import numpy as np

    rng = np.random.default_rng(seed)
    base = y.mean() if tau is None else np.quantile(y, tau)
    f, grown = np.full(len(y), base), []
    for _ in range(rounds):
        residual = y - f
        if tau is None:
            tree = _tree(x, residual, depth, leaf, rng, x.shape[1], np.mean)
        else:
            # the tree is grown on the gradient; a leaf's rows are found by walking it with row numbers
            shape = _tree(x, np.where(residual >= 0, tau, tau - 1.0), depth, leaf, rng, x.shape[1], lambda g: 0.0)

            def settle(node, rows, residual=residual):
                if not isinstance(node, tuple):
                    return float(np.quantile(residual[rows], tau)) if len(rows) else 0.0
                side = x[rows, node[0]] <= node[1]
                return node[0], node[1], settle(node[2], rows[side]), settle(node[3], rows[~side])

            tree = settle(shape, np.arange(len(y)))
        grown.append(tree)
        f = f + rate * _walk(tree, x)
    return lambda z: base + rate * np.sum([_walk(t, z) for t in grown], axis=0) if grown else np.full(len(z), base)


def gaussian(x, y, **options):
    """(mean, deviation): a boosted mean, and boosted log squared residuals for the spread."""
    import numpy as np

    options = {"rounds": 100} | options
    mean = boosting(x, y, **options)
    log_var = boosting(x, np.log((y - mean(x)) ** 2 + 1e-6), **options)
    scale = np.sqrt(np.mean((y - mean(x)) ** 2 / np.exp(log_var(x))))
    return mean, lambda z: scale * np.exp(log_var(z) / 2)


LEARNERS = {"ridge": ridge, "forest": forest, "boosting": boosting}


def fitted(df: DataFrame, features: list[str], y: str, value: str, learner: str, *keys: str, carry: tuple = ("i", "split"), delta: bool = True, **options) -> DataFrame:
    """keys, carry, y, value, yhat, status of all rows; the model is fitted on the train rows of each series."""

    def run(pdf):
        import numpy as np

        out = pdf[[*keys, *carry, y, value]].copy()
        train = (pdf["split"] == "train").to_numpy()
        x, base = pdf[features].to_numpy(float), pdf[value].to_numpy(float) if delta else np.zeros(len(pdf))
        try:
            predict = LEARNERS[learner](x[train], pdf[y].to_numpy(float)[train] - base[train], **options)
            out["yhat"], out["status"] = base + predict(x), "ok"
        except Exception as e:  # noqa: BLE001  a series that can't be fitted is reported, the others go on
            out["yhat"], out["status"] = np.nan, f"failed: {type(e).__name__}"
        return out

    fields = {c: df.schema[c].dataType.simpleString() for c in (*keys, *carry, y, value)}
    schema = ", ".join(f"`{c}` {t}" for c, t in fields.items()) + ", yhat double, status string"
    return df.select(*dict.fromkeys([*keys, *carry, y, value, "split", *features])).groupBy(*keys).applyInPandas(run, schema)


def fitted_band(df: DataFrame, features: list[str], y: str, value: str, alpha: float, *keys: str, kind: str = "quantile", carry: tuple = ("i", "split"), **options) -> DataFrame:
    """low and high per row: boosted quantiles, or a Gaussian band."""
    z = normal_z(alpha)

    def run(pdf):
        import numpy as np

        out = pdf[[*keys, *carry, y, value]].copy()
        train = (pdf["split"] == "train").to_numpy()
        x, base = pdf[features].to_numpy(float), pdf[value].to_numpy(float)
        change = (pdf[y].to_numpy(float) - base)[train]
        try:
            if kind == "quantile":
                settings = {"rounds": 100} | options
                out["low"] = base + boosting(x[train], change, tau=alpha / 2, **settings)(x)
                out["high"] = base + boosting(x[train], change, tau=1 - alpha / 2, **settings)(x)
            else:
                mean, spread = gaussian(x[train], change, **options)
                out["low"], out["high"] = base + mean(x) - z * spread(x), base + mean(x) + z * spread(x)
            out["status"] = "ok"
        except Exception as e:  # noqa: BLE001
            out["low"], out["high"], out["status"] = np.nan, np.nan, f"failed: {type(e).__name__}"
        return out

    fields = {c: df.schema[c].dataType.simpleString() for c in (*keys, *carry, y, value)}
    schema = ", ".join(f"`{c}` {t}" for c, t in fields.items()) + ", low double, high double, status string"
    return df.select(*dict.fromkeys([*keys, *carry, y, value, "split", *features])).groupBy(*keys).applyInPandas(run, schema)
