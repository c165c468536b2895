"""Pitman-Yor restaurants: table counts drawn by Gibbs from their conditional over all seatings."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .common import mix64

#: Customers of a dish for which the weights of all seatings are tabled.
TABLED = 1024
#: Numbers that are weighed together, and the share of all weight below which further counts are left out.
CELLS, REST = 400_000, 1e-9
#: Dishes of at most so many customers are weighed together with all others of as many; dishes at a time, few
#: enough that the numbers of a step stay in a core's cache and the sums of all steps in some MB.
FEW, BLOCK = 16, 4000
#: Weights beyond this are divided by it.
LARGEST = 1e200


@lru_cache(8)
def log_stirling(discount: float) -> np.ndarray:
    """log S(c, t): weights of all seatings of c customers at t tables, for c, t up to TABLED."""
    s = np.full((TABLED + 1, TABLED + 1), -np.inf)
    s[0, 0] = 0.0
    for c in range(TABLED):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            s[c + 1, 1 : c + 2] = np.logaddexp(s[c, t - 1], np.log(np.maximum(c - discount * t, 0)) + s[c, t])
    return s


@lru_cache(8)
def ratios(discount: float) -> np.ndarray:
    """By t and c: S(c, t + 1) / S(c, t), 0 from t = c."""
    s = log_stirling(discount).T
    with np.errstate(invalid="ignore"):
        return np.ascontiguousarray(np.nan_to_num(np.exp(s[1:] - s[:-1]), nan=0.0))


def draw_tables(customers: np.ndarray, log_base: np.ndarray, other_tables: np.ndarray, theta: float, discount: float, uniform: np.ndarray, gamma: np.ndarray | None = None) -> np.ndarray:
    """A draw of each dish's number of tables, given its customers (0 have none), the log probability
    of the dish under the parent, and the tables of the restaurant's other dishes.

    From p(t) ~ S(c, t) base**t (theta + d T)(theta + d (T + 1)) ..., which sums over all seatings. Given a
    draw `gamma` of Gamma(theta / d + tables of the restaurant), the dishes of a restaurant don't depend on
    one another: p(t) ~ S(c, t) (base d gamma)**t, and other_tables is not looked at. Of more than TABLED
    customers, t = s + n: s tables that the first TABLED open, and n of the others. Where a customer's
    chance to join one of t tables falls by d t / c, weights of t obey, in log c, a linear equation whose
    solution makes n negative binomial given s (Poisson given gamma), and s a draw from the table with
    other weights. The same uniform numbers (in [0, 1)) give the same draws.
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    base = np.exp(log_base)
    first = base * (theta + discount * other_tables if gamma is None else discount * gamma)
    more = base * discount if gamma is None else None
    stirling = np.exp(log_stirling(discount)[: FEW + 1, : FEW + 1])
    of = lambda x, some: None if x is None else x[some]
    few = np.minimum(customers, FEW + 1).astype(np.uint8)
    order = np.argsort(few, kind="stable")
    bounds = np.searchsorted(few[order], np.arange(2, FEW + 2)).tolist()
    for c, begin, end in zip(range(2, FEW + 1), bounds, bounds[1:]):
        for at in range(begin, end, BLOCK):
            some = order[at : min(end, at + BLOCK)]
            tables[some] = _few(stirling[c], first[some], of(more, some), uniform[some])
    some = order[bounds[-1] :]
    some = some[customers[some] <= TABLED]
    some = some[np.argsort(first[some] * np.log(customers[some]))]  # those that open about as many tables go together
    for at in range(0, len(some), BLOCK):
        part = some[at : at + BLOCK]
        tables[part] = _tabled(customers[part], first[part], of(more, part), discount, uniform[part], None)
    large = np.flatnonzero(customers > TABLED)
    everyone = customers[large].astype(float)
    left = 1 - (TABLED / everyone) ** discount  # of the later customers' chances, by a table among the first TABLED
    u = (mix64((uniform[large] * (1 << 53)).astype(np.uint64)) >> np.uint64(11)).astype(float) / (1 << 53)
    early = np.zeros(len(large), np.int64)
    if gamma is None:
        opening = base[large] * left
        first, more = first[large] / (1 - opening), more[large] / (1 - opening)
    else:
        first = first[large]
    for at in range(0, len(large), BLOCK):
        some = slice(at, at + BLOCK)
        early[some] = _tabled(np.full(len(large[some]), TABLED), first[some], of(more, some), discount, uniform[large[some]], everyone[some])
    if gamma is None:
        tables[large] = early + _negative_binomial((theta + discount * other_tables[large]) / discount + early, opening, u)
    else:
        tables[large] = early + _poisson(first / discount * left, u)
    return tables


def hashed_uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) for each key."""
    return ((mix64(key + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def hashed_gamma(key: np.ndarray, shape: np.ndarray, salt: int) -> np.ndarray:
    """A Gamma(shape) number for each key, the same for the same key, shape and salt: normal numbers,
    cubed, until accepted (shape 0: 0)."""
    key = mix64(key + np.uint64(salt * 0xC4CEB9FE1A85EC53 & 0xFFFFFFFFFFFFFFFF))
    size = np.where(shape < 1, shape + 1, shape) - 1 / 3
    out, todo, c = size.copy(), np.arange(len(key)), 1 / np.sqrt(9 * size)
    for attempt in range(40):
        u, v, w = (hashed_uniform(key[todo], 3 * attempt + k + 1) for k in range(3))
        x = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
        cube = (1 + c[todo] * x) ** 3
        with np.errstate(invalid="ignore", divide="ignore"):
            yes = (cube > 0) & (np.log(w) < x * x / 2 + size[todo] * (1 - cube + np.log(cube)))
        out[todo[yes]] = size[todo[yes]] * cube[yes]
        todo = todo[~yes]
        if not len(todo):
            break
    small = np.flatnonzero(shape < 1)
    with np.errstate(divide="ignore"):
        out[small] *= hashed_uniform(key[small], 0) ** (1 / shape[small])
    return out


def _few(stirling: np.ndarray, first: np.ndarray, more: np.ndarray | None, uniform: np.ndarray) -> np.ndarray:
    """Tables of dishes with the same number of customers, whose row of S is given: all weights, summed."""
    c = int(np.flatnonzero(stirling)[-1])
    sums = [stirling[1] * first]
    so_far = first.copy()
    for t in range(1, c):
        so_far *= first if more is None else first + more * t
        sums.append(sums[-1] + stirling[t + 1] * so_far)
    wanted, opened = uniform * sums[-1], np.ones(len(first), np.uint8)
    for x in sums:
        opened += (x < wanted).view(np.uint8)
    return opened


def _tabled(c: np.ndarray, first: np.ndarray, more: np.ndarray | None, discount: float, uniform: np.ndarray, everyone: np.ndarray | None) -> np.ndarray:
    """Tables of c customers, up to TABLED: p(t + 1) / p(t) = S(c, t + 1) / S(c, t) (first + more t), and a
    factor for the chances left to the later ones of `everyone`.

    Weights are summed from t = 1, all dishes at once, until what is left is REST of the sum; the sums so far
    are kept, and those below the random share of the last are counted.
    """
    table, total = ratios(discount), np.ones(len(c))
    rows, t = np.arange(len(c)), 0
    p, so_far, scratch = np.ones(len(c)), np.ones(len(c)), np.empty(len(c))
    kept = [(rows, [so_far])]
    of_c, of_first, of_more, of_all = c, first, more, everyone
    while len(rows) and t < TABLED - 1:
        t += 1
        if of_more is None and everyone is None:
            p *= of_first
        else:
            factor = of_first.copy() if of_more is None else of_more * t + of_first
            if everyone is not None:
                less = discount * t + (discount + 1) / 2
                factor *= ((TABLED - less) / (of_all - less)) ** discount
            p *= factor
        p *= np.take(table[t], of_c, out=scratch, mode="clip")  # "raise" would copy first
        so_far = so_far + p
        kept[-1][1].append(so_far)
        if t % 8 == 0 and (large := p > LARGEST).any():
            p[large] /= LARGEST
            for of_rows, sums in kept:
                at = np.searchsorted(of_rows, rows[large])
                for x in sums:
                    x[at] /= LARGEST
        # while weights rise, p is a t-th of the sum at least; those that are done are carried along until
        # they are many: their sums hardly grow
        if t % 4 == 0:
            going = p > so_far * REST
            if np.count_nonzero(going) <= 0.8 * len(rows):
                total[rows[~going]] = so_far[~going]
                rows, p, so_far, of_c, of_first = (x[going] for x in (rows, p, so_far, of_c, of_first))
                scratch = np.empty(len(rows))
                of_more, of_all = (None if x is None else x[going] for x in (of_more, of_all))
                kept.append((rows, []))
    total[rows] = so_far
    tables, wanted = np.ones(len(c), np.int64), uniform * total
    for of_rows, sums in kept:
        of_wanted, below = wanted[of_rows], np.empty(len(of_rows), bool)
        for at in range(0, len(sums), 255):  # as many as a byte counts
            opened = np.zeros(len(of_rows), np.uint8)
            for x in sums[at : at + 255]:
                opened += np.less(x, of_wanted, out=below).view(np.uint8)
            tables[of_rows] += opened
    return tables


def _negative_binomial(shape: np.ndarray, q: np.ndarray, uniform: np.ndarray) -> np.ndarray:
    """Numbers with p(k) ~ q**k shape (shape + 1) ... (shape + k - 1) / k!, by inversion within 9 deviations of the mean."""
    drawn = np.zeros(len(shape), np.int64)
    mean = shape * q / (1 - q)
    spread = 9 * np.sqrt(mean / (1 - q)) + 30
    order = np.argsort(spread)
    while len(order):
        some = order[: max(1, CELLS // (4 * int(spread[order[0]]) + 4))]
        some = some[spread[some] <= 2 * spread[order[0]]]
        width = 2 * int(spread[some[-1]]) + 2
        k = np.maximum(0, np.floor(mean[some] - spread[some]))[:, None] + np.arange(width)
        log_p = np.zeros(k.shape)
        log_p[:, 1:] = np.cumsum(np.log((shape[some, None] + k[:, :-1]) / k[:, 1:] * q[some, None]), axis=1)
        so_far = np.cumsum(np.exp(log_p - log_p.max(axis=1, keepdims=True)), axis=1)
        drawn[some] = k[:, 0] + (so_far < (uniform[some] * so_far[:, -1])[:, None]).sum(axis=1)
        order = order[len(some) :]
    return drawn


def _poisson(mean: np.ndarray, uniform: np.ndarray) -> np.ndarray:
    """Poisson numbers, by inversion within 9 deviations of the mean."""
    drawn = np.zeros(len(mean), np.int64)
    spread = 9 * np.sqrt(mean) + 30
    order = np.argsort(spread)
    while len(order):
        some = order[: max(1, CELLS // (4 * int(spread[order[0]]) + 4))]
        some = some[spread[some] <= 2 * spread[order[0]]]
        k = np.maximum(0, np.floor(mean[some] - spread[some]))[:, None] + np.arange(2 * int(spread[some[-1]]) + 2)
        log_p = np.zeros(k.shape)
        with np.errstate(divide="ignore"):
            log_p[:, 1:] = np.cumsum(np.log(mean[some, None] / k[:, 1:]), axis=1)
        so_far = np.cumsum(np.exp(log_p - log_p.max(axis=1, keepdims=True)), axis=1)
        drawn[some] = k[:, 0] + (so_far < (uniform[some] * so_far[:, -1])[:, None]).sum(axis=1)
        order = order[len(some) :]
    return drawn


def discount_of(ones: float, twos: float) -> float:
    """The discount that counts of counts suggest."""
    return float(min(0.95, max(0.1, ones / (ones + 2 * twos)))) if ones else 0.5
