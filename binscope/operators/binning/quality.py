"""Quality score of a binning table (per factor, on the table's few rows).

quality = r(x) * prod(1 - p_value of adjacent bins) * (1 - normalised HHI), with
r(x) = (x / c) exp((1 - (x / c)^2) / 2) peaking at x = c = 0.39573882184806863;
x = IV (binary), sum |WoE| / |mean| (continuous), JS (multiclass).  Adjacent-bin
p-values: two-proportion chi-square with one degree of freedom (binary),
Welch t-test (continuous); none for multiclass.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binscope.session import ship_package

# Fixed value: where the score's IV term peaks
QUALITY_C = 0.39573882184806863


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        de = d * c
        h *= de
        if abs(de - 1.0) < 1e-14:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)
    if x < (a + 1) / (a + b + 2):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1 - x) / b


def t_two_sided_p(t: float, dof: float) -> float:
    if not np.isfinite(t) or dof <= 0:
        return 1.0 if not np.isfinite(t) and np.isnan(t) else 0.0
    return betainc(dof / 2.0, 0.5, dof / (dof + t * t))


def chi2_p_value(e_a, n_a, e_b, n_b) -> float:
    """Two-proportion chi-square test (1 df): p = erfc(sqrt(chi2 / 2))."""
    n = n_a + n_b
    e = e_a + e_b
    if n == 0 or e == 0 or e == n or n_a == 0 or n_b == 0:
        return 1.0
    chi2 = 0.0
    exp_tab = [[n_a * e / n, n_a * (n - e) / n], [n_b * e / n, n_b * (n - e) / n]]
    obs_tab = [[e_a, n_a - e_a], [e_b, n_b - e_b]]
    for i in range(2):
        for j in range(2):
            chi2 += (obs_tab[i][j] - exp_tab[i][j]) ** 2 / exp_tab[i][j]
    return math.erfc(math.sqrt(chi2 / 2.0))


def welch_p_value(m_a, v_a, n_a, m_b, v_b, n_b) -> float:
    """Welch t-test of two bins (sample variances)."""
    if n_a < 2 or n_b < 2:
        return 1.0
    se2 = v_a / n_a + v_b / n_b
    if se2 <= 0:
        return 0.0 if m_a != m_b else 1.0
    t = (m_a - m_b) / math.sqrt(se2)
    dof = se2 ** 2 / ((v_a / n_a) ** 2 / (n_a - 1) + (v_b / n_b) ** 2 / (n_b - 1))
    return t_two_sided_p(t, dof)


def rayleigh(x: float) -> float:
    r = x / QUALITY_C
    return r * math.exp(0.5 * (1 - r * r))


def hhi_normalised(shares: np.ndarray) -> float:
    k = len(shares)
    if k <= 1:
        return 1.0
    return float((np.sum(shares ** 2) - 1.0 / k) / (1.0 - 1.0 / k))


def _score(pdf: pd.DataFrame, kind: str) -> float:
    reg = pdf[pdf["kind"] == "regular"].sort_values("bin_id")
    tot = pdf[pdf["kind"] == "totals"]
    if kind == "multiclass":
        per_bin = reg.groupby("bin_id")["count"].first()
        n = per_bin.to_numpy(dtype=float)
        shares = n / n.sum() if n.sum() > 0 else n
        x = float(pdf["__js"].iloc[0] or 0.0)
        return rayleigh(x) * (1 - hhi_normalised(shares))
    n = reg["count"].to_numpy(dtype=float)
    if n.sum() == 0:
        return 0.0
    shares = n / n.sum()
    pv = []
    if kind == "binary":
        e = reg["event"].to_numpy(dtype=float)
        for i in range(len(n) - 1):
            pv.append(chi2_p_value(e[i], n[i], e[i + 1], n[i + 1]))
        x = float(tot["iv"].iloc[0] or 0.0)
    else:
        m = reg["mean"].to_numpy(dtype=float)
        sd = reg["std"].to_numpy(dtype=float)
        var = np.where(n > 1, sd ** 2 * n / np.maximum(n - 1, 1), 0.0)
        for i in range(len(n) - 1):
            pv.append(welch_p_value(m[i], var[i], n[i], m[i + 1], var[i + 1], n[i + 1]))
        mean = float(tot["mean"].iloc[0] or 0.0)
        woe = float(tot["woe"].iloc[0] or 0.0)
        x = woe / abs(mean) if mean != 0 else 0.0
    prod = float(np.prod([1 - p for p in pv])) if pv else 1.0
    return rayleigh(x) * prod * (1 - hhi_normalised(shares))


def quality_score(table: DataFrame, kind: str, summary: DataFrame | None = None) -> DataFrame:
    """``(factor, quality_score)`` from a binning table (grouped per factor: a few rows each)."""
    if kind == "continuous":
        cols = ["factor", "bin_id", "kind", "count", "mean", "std", "woe", "iv"]
        t = table.select(*cols)
    elif kind == "binary":
        cols = ["factor", "bin_id", "kind", "count", "event", "iv"]
        t = table.select(*cols)
    else:
        t = table.select("factor", "bin_id", "kind", "count").join(
            summary.select("factor", F.col("js").alias("__js")), "factor")

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"factor": [pdf["factor"].iloc[0]], "quality_score": [float(_score(pdf, kind))]})

    ship_package(table.sparkSession)
    return t.groupBy("factor").applyInPandas(fn, "factor string, quality_score double")
