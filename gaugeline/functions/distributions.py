"""Distribution functions on the driver, of single numbers: no outside library is needed."""

from __future__ import annotations

from math import erfc, exp, inf, lgamma, log, log1p, nan, sqrt


def _fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, e = 1.0, 1 - (a + b) * x / (a + 1)
    e = 1 / (e if abs(e) > tiny else tiny)
    h = e
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            e, c = 1 + num * e, 1 + num / c
            e, c = 1 / (e if abs(e) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= e * c
        if abs(e * c - 1) < 1e-16:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def t_sf(t: float, df: float) -> float:
    """P(T > t)."""
    tail = beta_cdf(df / (df + t * t), df / 2, 0.5) / 2
    return tail if t >= 0 else 1 - tail


def t_quantile(p: float, df: float) -> float:
    low, high = -1e3, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_sf(mid, df) < p else (low, mid)
    return (low + high) / 2


def normal_sf(z: float) -> float:
    return erfc(z / sqrt(2)) / 2


def wilcoxon(d: list[float]) -> tuple[float, float]:
    """Signed-rank statistic (the smaller rank sum) and two-sided p: exact up to 50 differences without ties or zeros,
    else normal with tie correction. Zeros are left out."""
    x = sorted((v for v in d if v != 0), key=abs)
    n = len(x)
    if not n:
        return 0.0, nan
    ranks, i, ties = [0.0] * n, 0, 0.0
    while i < n:
        j = i
        while j < n and abs(x[j]) == abs(x[i]):
            j += 1
        for k in range(i, j):
            ranks[k] = (i + j + 1) / 2
        ties += (j - i) ** 3 - (j - i)
        i = j
    plus = sum(r for r, v in zip(ranks, x, strict=True) if v > 0)
    w = min(plus, n * (n + 1) / 2 - plus)
    if n <= 50 and not ties and n == len(d):
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        return w, min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    sd = sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return w, min(1.0, 2 * normal_sf((n * (n + 1) / 4 - w) / sd)) if sd else 1.0


def spearman_p(rho: float, n: int) -> float:
    if n < 3 or rho != rho:
        return nan
    if abs(rho) >= 1:
        return 0.0
    t = abs(rho) * sqrt((n - 2) / (1 - rho * rho)) if abs(rho) < 1 else inf
    return 2 * t_sf(t, n - 2)
