"""Small boosted trees, fitted on the driver and applied as SQL expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Split:
    """A tree: a leaf's value, or a feature, a cut and what lies at most and above it."""

    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    low: Split | None = None
    high: Split | None = None


@dataclass(frozen=True)
class Boosted:
    features: tuple[str, ...]
    base: float
    trees: tuple[Split, ...]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum(_apply(t, x) for t in self.trees)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))

    def sql(self, row: str) -> str:
        """The probability as SQL over the fields of ``row``."""

        def tree(t: Split) -> str:
            if t.low is None:
                return f"{t.value!r}D"
            return f"IF({row}.{self.features[t.feature]} <= {t.cut!r}D, {tree(t.low)}, {tree(t.high)})"

        return f"1 / (1 + exp(-({' + '.join([f'{self.base!r}D', *map(tree, self.trees)])})))"


def _apply(t: Split, x: np.ndarray) -> np.ndarray:
    if t.low is None:
        return np.full(len(x), t.value)
    return np.where(x[:, t.feature] <= t.cut, _apply(t.low, x), _apply(t.high, x))


#: Most cuts of a feature that are tried, at even shares of the rows.
CUTS = 48


def _cuts(column: np.ndarray) -> np.ndarray:
    values = np.unique(column)
    cuts = (values[1:] + values[:-1]) / 2
    return cuts if len(cuts) <= CUTS else np.unique(np.quantile(column, np.linspace(1 / (CUTS + 1), CUTS / (CUTS + 1), CUTS)))


def _grow(bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, ridge: float, rate: float) -> Split:
    """A tree over binned features: bin i of a column lies above its first i cuts."""

    def leaf() -> Split:
        return Split(value=float(rate * g.sum() / (h.sum() + ridge)))

    if depth == 0 or len(g) < 8:
        return leaf()
    width = CUTS + 1
    at = (bins + np.arange(bins.shape[1]) * width).ravel()
    gl, hl = (np.bincount(at, np.repeat(v, bins.shape[1]), bins.shape[1] * width).reshape(-1, width).cumsum(axis=1)[:, :-1] for v in (g, h))
    n = np.bincount(at, minlength=bins.shape[1] * width).reshape(-1, width).cumsum(axis=1)[:, :-1]
    gain = gl**2 / (hl + ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    gain[(n == 0) | (n == len(g))] = 0
    j, i = np.unravel_index(gain.argmax(), gain.shape)
    if gain[j, i] <= 1e-6:
        return leaf()
    low = bins[:, j] <= i
    low_tree, high_tree = (_grow(bins[side], cuts, g[side], h[side], depth - 1, ridge, rate) for side in (low, ~low))
    return Split(feature=int(j), cut=float(cuts[j][i]), low=low_tree, high=high_tree)


def boost(x: np.ndarray, y: np.ndarray, features: tuple[str, ...], rounds: int = 24, depth: int = 3, rate: float = 0.35, ridge: float = 1.0) -> Boosted:
    """Gradient boosting of logistic loss with Newton leaves."""
    p0 = np.clip(y.mean(), 0.01, 0.99)
    base = float(np.log(p0 / (1 - p0)))
    cuts = [_cuts(column) for column in x.T]
    bins = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T, strict=True)], axis=1)
    score, trees = np.full(len(y), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        t = _grow(bins, cuts, y - p, p * (1 - p), depth, ridge, rate)
        trees.append(t)
        score = score + _apply(t, x)
    return Boosted(features, base, tuple(trees))
