"""CART pre-binning and exact optimal binning over pre-bins (numpy, per factor).

Everything here works on a handful of rows per factor (fine bins from the
candidate cuts: at most a few hundred), inside ``applyInPandas``.

Statistics of a fine bin are additive vectors:

* continuous: ``[n, sum_y, sum_y2]``
* binary:     ``[n, events]``
* multiclass: ``[n, count_class_1, ..., count_class_C]``

Objective of a bin (additive over bins):

* continuous: ``|mean_b - mean|`` (summed over bins: the table's total WoE)
* binary:     ``IV_b = (p_b - q_b) ln(p_b / q_b)``, ``p = non-events share``, ``q = events share``
* multiclass: sum over classes of the one-vs-rest IV

The DP chooses consecutive groups of pre-bins maximising the objective with
each group's size within ``[min_bin_size, max_bin_size]`` and the group metric
(mean or event rate) following the trend.  State (i, j) = last group covers
pre-bins i..j; peak / valley add a phase.  O(m^3) with m <= max_n_prebins,
vectorised over the predecessor index.

For several classes each class has a trend of its own: the state of (i, j)
also carries, for every class, where it has got to (no change yet, rising,
falling, turned); states that are no better than another which allows as much
are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

# ---------------------------------------------------------------------------
# Fixed values (defaults of the reference's binning parameters)
# ---------------------------------------------------------------------------
MAX_N_PREBINS = 20          # library default
MIN_PREBIN_SIZE = 0.05      # library default
REPORT_MAX_N_PREBINS = 60   # regression binning report
REPORT_MIN_PREBIN_SIZE = 0.01
REPORT_MAX_BIN_SIZE = 0.2
AUTO_PEAK_FACTOR = 1.1      # peak / valley must beat the monotonic objective by 10 %

NEG = -np.inf


@dataclass
class Solution:
    groups: list[int]        # start index (into pre-bins) of every final bin
    status: str              # OPTIMAL, RELAXED_TREND, INFEASIBLE
    trend: str               # trend constraint used
    objective: float


# ---------------------------------------------------------------------------
# bin metrics
# ---------------------------------------------------------------------------
def bin_objective(stats: np.ndarray, total: np.ndarray, kind: str) -> np.ndarray:
    """Objective of every row of ``stats`` (rows are bins)."""
    n = stats[:, 0]
    N = total[0]
    if kind == "continuous":
        mean_all = total[1] / N if N > 0 else 0.0
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.where(n > 0, stats[:, 1] / np.where(n > 0, n, 1), mean_all)
        return np.abs(mean - mean_all) if N > 0 else np.zeros(len(n))
    if kind == "binary":
        e, E = stats[:, 1], total[1]
        return _iv(n - e, N - E, e, E)
    # multiclass: one-vs-rest IV per class
    out = np.zeros(len(n))
    for c in range(1, stats.shape[1]):
        e, E = stats[:, c], total[c]
        out += _iv(n - e, N - E, e, E)
    return out


def _iv(ne, NE, e, E):
    with np.errstate(divide="ignore", invalid="ignore"):
        p = ne / NE if NE > 0 else np.zeros_like(ne)
        q = e / E if E > 0 else np.zeros_like(e)
        ok = (ne > 0) & (e > 0)
        return np.where(ok, (p - q) * np.log(np.where(ok, p / np.where(q > 0, q, 1), 1.0)), 0.0)


def bin_metric(stats: np.ndarray, kind: str) -> np.ndarray:
    """Mean (continuous) or event rate (binary) per bin; multiclass has no trend metric."""
    n = stats[:, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 0, stats[:, 1] / np.where(n > 0, n, 1), 0.0)


def impurity(stats: np.ndarray, kind: str) -> np.ndarray:
    """CART impurity (times n): squared error for continuous, Gini for classes."""
    n = stats[:, 0]
    safe = np.where(n > 0, n, 1)
    if kind == "continuous":
        return stats[:, 2] - stats[:, 1] ** 2 / safe
    if kind == "binary":
        p = stats[:, 1] / safe
        return n * (1 - p ** 2 - (1 - p) ** 2)
    p = stats[:, 1:] / safe[:, None]
    return n * (1 - (p ** 2).sum(axis=1))


# ---------------------------------------------------------------------------
# E5: CART pre-binning
# ---------------------------------------------------------------------------
def prebin_cart(stats: np.ndarray, kind: str, max_n_prebins: int = MAX_N_PREBINS,
                min_prebin_size: float = MIN_PREBIN_SIZE, max_bin_size: float | None = None) -> list[int]:
    """Start indices of pre-bins over the fine bins (best-first impurity splits).

    A split is valid when both sides hold at least ``min_prebin_size`` of the
    rows, and it leaves enough of ``max_n_prebins`` to cut every segment down
    to ``max_bin_size``. Segments above that size are split even without gain.
    Where the limits exclude each other, segments above the size remain (the
    solver then finds no partition).
    """
    m = len(stats)
    if m <= 1:
        return [0]
    N = stats[:, 0].sum()
    min_n = min_prebin_size * N
    cum = np.vstack([np.zeros(stats.shape[1]), np.cumsum(stats, axis=0)])

    def best_split(a: int, b: int, min_side: float, fits: np.ndarray):
        """Best split point s in (a, b) of segment [a, b) among those that fit: (gain, s)."""
        if b - a < 2:
            return None
        tot = cum[b] - cum[a]
        left = cum[a + 1:b] - cum[a]
        right = tot - left
        ok = (left[:, 0] >= min_side) & (right[:, 0] >= min_side) & fits
        if not ok.any():
            return None
        gain = impurity(tot[None, :], kind)[0] - impurity(left, kind) - impurity(right, kind)
        gain = np.where(ok, gain, -np.inf)
        k = int(np.argmax(gain))
        return float(gain[k]), a + 1 + k

    limit = max_bin_size * N + 1e-9 if max_bin_size is not None else np.inf

    def need(a: int, b: int) -> int:
        """Fewest pieces of [a, b) within the size limit (a fine bin above it is a piece)."""
        pieces = 0
        while a < b:
            a = min(b, max(a + 1, int(np.searchsorted(cum[:, 0], cum[a][0] + limit, "right")) - 1))
            pieces += 1
        return pieces

    # a split may take no more pre-bins than are left beside those the size limit will need
    segs, needed = [(0, m)], {}
    for a in range(m if max_bin_size is not None else 0):
        for b in range(a + 1, m + 1):
            needed[a, b] = need(a, b)
    of = lambda a, b: needed.get((a, b), 1)
    while len(segs) < max_n_prebins:
        room = max_n_prebins - sum(of(a, b) for a, b in segs)
        cands = []
        for idx, (a, b) in enumerate(segs):
            large = of(a, b) > 1
            fits = np.array([of(a, x) + of(x, b) - of(a, b) <= max(room, 0 if large else room) for x in range(a + 1, b)], bool)
            r = best_split(a, b, min_n, fits)
            if r is not None and (r[0] > 1e-12 or large):
                cands.append((r[0] > 1e-12, r[0], idx, r[1]))
        if not cands:
            break
        _, _, idx, x = max(cands)
        a, b = segs[idx]
        segs[idx:idx + 1] = [(a, x), (x, b)]
    return [a for a, _ in segs]


def merge_pure_prebins(stats: np.ndarray, starts: list[int]) -> list[int]:
    """Binary: merge pre-bins with no events or no non-events into a neighbour."""
    starts = list(starts)
    bounds = starts + [len(stats)]
    groups = [stats[bounds[i]:bounds[i + 1]].sum(axis=0) for i in range(len(starts))]
    i = 0
    while len(groups) > 1 and i < len(groups):
        n, e = groups[i][0], groups[i][1]
        if e == 0 or e == n:
            j = i + 1 if i + 1 < len(groups) else i - 1
            lo, hi = min(i, j), max(i, j)
            groups[lo] = groups[lo] + groups[hi]
            del groups[hi]
            del starts[hi]
            i = 0
            continue
        i += 1
    return starts


# ---------------------------------------------------------------------------
# Exact DP over pre-bins
# ---------------------------------------------------------------------------
def _range_tables(pstats: np.ndarray, total: np.ndarray, kind: str):
    m = len(pstats)
    cum = np.vstack([np.zeros(pstats.shape[1]), np.cumsum(pstats, axis=0)])
    # range (i, j) inclusive -> stats cum[j+1] - cum[i]
    rs = cum[None, 1:, :] - cum[:-1, None, :]            # m x m x d (valid for j >= i)
    flat = rs.reshape(m * m, -1)
    obj = bin_objective(flat, total, kind).reshape(m, m)
    met = bin_metric(flat, kind).reshape(m, m)
    size = rs[:, :, 0]
    return obj, met, size


_EPS = 1e-12
# (trend, previous phase, phase) -> relation the previous group's metric must have to this one's
_RULES = {
    ("ascending", 0, 0): "le", ("descending", 0, 0): "ge", ("none", 0, 0): "any",
    ("peak", 0, 0): "le", ("peak", 0, 1): "ge", ("peak", 1, 1): "ge",
    ("valley", 0, 0): "ge", ("valley", 0, 1): "le", ("valley", 1, 1): "le",
}


def _allowed(trend: str, pph: int, ph: int, prev: np.ndarray, cur: float) -> np.ndarray:
    rule = _RULES.get((trend, pph, ph))
    if rule is None:
        return np.zeros(len(prev), dtype=bool)
    if rule == "le":
        return prev <= cur + _EPS
    if rule == "ge":
        return prev >= cur - _EPS
    return np.ones(len(prev), dtype=bool)


def solve_dp(pstats: np.ndarray, kind: str, trend: str, max_bin_size: float | None,
             min_bin_size: float | None) -> tuple[float, list[int]] | None:
    """Best partition of the pre-bins for one trend; None when infeasible."""
    m = len(pstats)
    total = pstats.sum(axis=0)
    N = total[0]
    obj, met, size = _range_tables(pstats, total, kind)
    tri = np.triu(np.ones((m, m), dtype=bool))
    ok = tri.copy()
    if max_bin_size is not None:
        ok &= size <= max_bin_size * N + 1e-9
    if min_bin_size is not None:
        ok &= size >= min_bin_size * N - 1e-9
    phases = 2 if trend in ("peak", "valley") else 1
    best = np.full((phases, m, m), NEG)
    back = np.full((phases, m, m, 2), -1, dtype=np.int64)   # (phase, k) of predecessor (k, i-1)
    for j in range(m):
        for i in range(j + 1):
            if not ok[i, j]:
                continue
            if i == 0:
                best[0, 0, j] = obj[0, j]
                continue
            cur = met[i, j]
            prev_met = met[:i, i - 1]           # predecessors (k, i-1), k < i
            for ph in range(phases):
                cand_best, cand = NEG, (-1, -1)
                for pph in range(ph + 1):
                    allowed = _allowed(trend, pph, ph, prev_met, cur)
                    v = np.where(allowed, best[pph, :i, i - 1], NEG)
                    k = int(np.argmax(v))
                    if v[k] > cand_best:
                        cand_best, cand = v[k], (pph, k)
                if cand_best > NEG:
                    best[ph, i, j] = cand_best + obj[i, j]
                    back[ph, i, j] = cand
    finals = [(best[ph, i, m - 1], ph, i) for ph in range(phases) for i in range(m)]
    val, ph, i = max(finals)
    if not np.isfinite(val):
        return None
    starts = []
    j = m - 1
    while True:
        starts.append(i)
        if i == 0:
            break
        pph, k = back[ph, i, j]
        j, i, ph = i - 1, int(k), int(pph)
    return float(val), sorted(starts)


# where a class has got to: no change yet, rising, falling, risen then falling, fallen then rising
_FLAT, _UP, _DOWN, _PEAK, _VALLEY = range(5)
_NEXT = {(_FLAT, 1): _UP, (_FLAT, -1): _DOWN, (_UP, 1): _UP, (_UP, -1): _PEAK, (_DOWN, -1): _DOWN, (_DOWN, 1): _VALLEY,
         (_PEAK, -1): _PEAK, (_VALLEY, 1): _VALLEY}
_REACHED = {"ascending": {_FLAT, _UP}, "descending": {_FLAT, _DOWN}, "auto": {_FLAT, _UP, _DOWN},
            "peak": {_FLAT, _UP, _DOWN, _PEAK}, "valley": {_FLAT, _UP, _DOWN, _VALLEY},
            "one turn": {_FLAT, _UP, _DOWN, _PEAK, _VALLEY}}
_NAMES = {_FLAT: "flat", _UP: "ascending", _DOWN: "descending", _PEAK: "peak", _VALLEY: "valley"}


def solve_classes(pstats: np.ndarray, trends: Sequence[str], max_bin_size: float | None,
                  min_bin_size: float | None) -> tuple[float, list[int], list[str]] | None:
    """Best partition of multiclass pre-bins in which each class follows its trend; None when infeasible.

    A trend is ascending, descending, peak, valley, auto (rising or falling,
    whichever is better), one turn, or none. Gives the objective, the starts of
    the groups and the trend each class has.
    """
    m, classes = len(pstats), pstats.shape[1] - 1
    total = pstats.sum(axis=0)
    obj, _, size = _range_tables(pstats, total, "multiclass")
    cum = np.vstack([np.zeros(pstats.shape[1]), np.cumsum(pstats, axis=0)])
    stats = cum[None, 1:, :] - cum[:-1, None, :]
    rate = stats[:, :, 1:] / np.maximum(stats[:, :, :1], 1e-300)
    lo = -np.inf if min_bin_size is None else min_bin_size * total[0] - 1e-9
    hi = np.inf if max_bin_size is None else max_bin_size * total[0] + 1e-9
    free = [t == "none" for t in trends]
    # (i, j) -> {state: (objective, predecessor's i, predecessor's state)}
    best: dict[tuple[int, int], dict[tuple, tuple]] = {}
    for j in range(m):
        for i in range(j + 1):
            if not lo <= size[i, j] <= hi:
                continue
            here: dict[tuple, tuple] = {}
            if i == 0:
                here[(_FLAT,) * classes] = (float(obj[0, j]), -1, ())
            for k in range(i):
                before = best.get((k, i - 1))
                if not before:
                    continue
                change = rate[i, j] - rate[k, i - 1]
                sign = np.where(change > _EPS, 1, np.where(change < -_EPS, -1, 0))
                for state, (value, _, _) in before.items():
                    to = _stepped(state, sign, trends, free)
                    if to is not None and value + obj[i, j] > here.get(to, (NEG,))[0]:
                        here[to] = (float(value + obj[i, j]), k, state)
            if here:
                best[i, j] = _undominated(here)
    ends = [(v[0], i, state) for i in range(m) for state, v in best.get((i, m - 1), {}).items()]
    if not ends:
        return None
    value, i, state = max(ends)
    names, starts, j = [_NAMES[x] for x in state], [], m - 1
    while True:
        starts.append(i)
        _, k, before = best[i, j][state]
        if k < 0:
            break
        i, j, state = k, i - 1, before
    return value, sorted(starts), ["none" if f else n for f, n in zip(free, names)]


def _stepped(state: tuple, sign: np.ndarray, trends: Sequence[str], free: Sequence[bool]) -> tuple | None:
    out = []
    for x, s, trend, any_way in zip(state, sign.tolist(), trends, free):
        if s and not any_way:
            x = _NEXT.get((x, s))
            if x not in _REACHED[trend]:
                return None
        out.append(x)
    return tuple(out)


def _undominated(states: dict[tuple, tuple]) -> dict[tuple, tuple]:
    """Drop a state if another of at least its value is the same but for classes that have not changed yet."""
    kept: dict[tuple, tuple] = {}
    for state, v in sorted(states.items(), key=lambda x: (-x[1][0], sum(map(bool, x[0])))):
        if not any(all(a in (_FLAT, b) for a, b in zip(other, state)) for other in kept):
            kept[state] = v
    return kept


def optimal_groups(pstats: np.ndarray, kind: str, monotonic_trend: str | Sequence[str] | None = "auto",
                   max_bin_size: float | None = None, min_bin_size: float | None = None) -> Solution:
    """E6-E8 with the fallbacks: trend -> (auto: peak/valley) -> no trend -> one bin."""
    if len(pstats) == 0:
        return Solution([0], "INFEASIBLE", "none", 0.0)
    if kind == "multiclass" and monotonic_trend:
        return _class_groups(pstats, monotonic_trend, max_bin_size, min_bin_size)
    if monotonic_trend == "auto":
        mono = [(r, t) for t in ("ascending", "descending")
                if (r := solve_dp(pstats, kind, t, max_bin_size, min_bin_size)) is not None]
        best = max(mono, key=lambda rt: rt[0][0]) if mono else None
        pv = [(r, t) for t in ("peak", "valley")
              if (r := solve_dp(pstats, kind, t, max_bin_size, min_bin_size)) is not None]
        best_pv = max(pv, key=lambda rt: rt[0][0]) if pv else None
        if best_pv is not None and (best is None or best_pv[0][0] >= AUTO_PEAK_FACTOR * best[0][0]):
            best = best_pv
        if best is not None:
            (val, starts), t = best
            return Solution(starts, "OPTIMAL", t, val)
    elif monotonic_trend:
        r = solve_dp(pstats, kind, monotonic_trend, max_bin_size, min_bin_size)
        if r is not None:
            return Solution(r[1], "OPTIMAL", monotonic_trend, r[0])
        return Solution([0], "INFEASIBLE", monotonic_trend, 0.0)
    r = solve_dp(pstats, kind, "none", max_bin_size, min_bin_size)
    if r is not None:
        status = "OPTIMAL" if not monotonic_trend else "RELAXED_TREND"
        return Solution(r[1], status, "none", r[0])
    return Solution([0], "INFEASIBLE", "none", 0.0)


def _class_groups(pstats: np.ndarray, wanted: str | Sequence[str], max_bin_size: float | None,
                  min_bin_size: float | None) -> Solution:
    """One trend for all classes, or one for each; ``auto`` takes one turn a class where it is much better."""
    classes = pstats.shape[1] - 1
    trends = [wanted] * classes if isinstance(wanted, str) else [t or "none" for t in wanted]
    if len(trends) != classes:
        raise ValueError(f"{len(trends)} trends for {classes} classes")
    r = solve_classes(pstats, trends, max_bin_size, min_bin_size)
    if "auto" in trends:
        turned = solve_classes(pstats, ["one turn" if t == "auto" else t for t in trends], max_bin_size, min_bin_size)
        if turned is not None and (r is None or turned[0] >= AUTO_PEAK_FACTOR * r[0]):
            r = turned
        if r is None:
            free = solve_classes(pstats, ["none" if t == "auto" else t for t in trends], max_bin_size, min_bin_size)
            if free is not None:
                return Solution(free[1], "RELAXED_TREND", ",".join(free[2]), free[0])
    if r is None:
        return Solution([0], "INFEASIBLE", ",".join(trends), 0.0)
    return Solution(r[1], "OPTIMAL", ",".join(r[2]), r[0])


def brute_force(pstats: np.ndarray, kind: str, trend: str, max_bin_size=None, min_bin_size=None):
    """Exhaustive search over all partitions (tests only, m <= 12)."""
    import itertools
    m = len(pstats)
    total = pstats.sum(axis=0)
    best = None
    for r in range(m):
        for cuts in itertools.combinations(range(1, m), r):
            starts = [0, *cuts]
            bounds = starts + [m]
            g = np.array([pstats[bounds[i]:bounds[i + 1]].sum(axis=0) for i in range(len(starts))])
            n = g[:, 0]
            if max_bin_size is not None and (n > max_bin_size * total[0] + 1e-9).any():
                continue
            if min_bin_size is not None and (n < min_bin_size * total[0] - 1e-9).any():
                continue
            met = bin_metric(g, kind)
            d = np.diff(met)
            if trend == "ascending" and (d < -1e-12).any():
                continue
            if trend == "descending" and (d > 1e-12).any():
                continue
            if trend == "peak":
                p = int(np.argmax(met))
                if (d[:p] < -1e-12).any() or (d[p:] > 1e-12).any():
                    continue
            if trend == "valley":
                p = int(np.argmin(met))
                if (d[:p] > 1e-12).any() or (d[p:] < -1e-12).any():
                    continue
            val = bin_objective(g, total, kind).sum()
            if best is None or val > best[0] + 1e-12:
                best = (val, starts)
    return best
