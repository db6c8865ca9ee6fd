"""Confidence sequences for a mean of numbers in [0, 1], as steps over arrays that move a state on.

A state is a dictionary of sums. Its parts come in levels: those of a level are sums of terms that
depend on the levels before only, so that the sums of two stretches of a stream merge. Batch scans and
streams share these steps.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

BETTING_GRID = 401
#: Rows that meet all candidate means at once.
BLOCK = 256

State = dict[str, float | np.ndarray]
#: Moves the state on by x and gives (lo, hi, failed) after each of x.
Step = Callable[[State, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Sequence:
    """step moves all of the state; levels: its keys, and what moves these at least."""

    step: Step
    levels: tuple[tuple[tuple[str, ...], Callable[[State, np.ndarray], object]], ...]
    grid: int = 0

    def zero(self) -> State:
        return {key: np.zeros((4, self.grid)) if key == "capital" else 0.0 for keys, _ in self.levels for key in keys}

    def merge(self, level: int, carry: State, own: State) -> State:
        """carry with the level's sums of a later stretch own added."""
        out = dict(carry)
        for key in self.levels[level][0]:
            out[key] = _later_capital(carry[key], own[key]) if key == "capital" else carry[key] + own[key]
        return out


def _later_capital(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows: capital bet upwards and downwards, and the most that either has been."""
    return np.stack([a[0] + b[0], a[1] + b[1], np.maximum(a[2], a[0] + b[2]), np.maximum(a[3], a[1] + b[3])])


def _before(start: float, values: np.ndarray) -> np.ndarray:
    """start plus the sum of all earlier values, at each value."""
    return start + np.concatenate(([0.0], np.cumsum(values)[:-1]))


def _count(state: State, x: np.ndarray) -> None:
    state.update(n=state["n"] + len(x), sum_x=state["sum_x"] + x.sum())


def plug_ins(state: State, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, mu, var): the mean and variance known before each of x (prior 1/2 and 1/4, weight 1)."""
    n = state["n"] + np.arange(1, len(x) + 1)
    mu = (0.5 + _before(state["sum_x"], x)) / n
    deviation = (x - mu) ** 2
    var = (0.25 + _before(state["deviation"], deviation)) / n
    _count(state, x)
    state["deviation"] += deviation.sum()
    return n, mu, var


_COUNT = (("n", "sum_x"), _count)
_PLUG_INS = (("deviation",), plug_ins)


def hoeffding(level: float = 0.05) -> Sequence:
    """Running mean plus and minus sqrt(log(2 n (n + 1) / level) / 2 n)."""

    def step(state, x):
        n = state["n"] + np.arange(1, len(x) + 1)
        mean = (state["sum_x"] + np.cumsum(x)) / n
        _count(state, x)
        eps = np.sqrt(np.log(2 * n * (n + 1) / level) / (2 * n))
        return np.maximum(mean - eps, 0.0), np.minimum(mean + eps, 1.0), np.zeros(len(x), bool)

    return Sequence(step, (_COUNT,))


def empirical_bernstein(level: float = 0.05, cap: float = 0.5) -> Sequence:
    """Bets by the plug-in mean and variance, each at most cap."""

    def step(state, x):
        n, mu, var = plug_ins(state, x)
        lam = np.minimum(np.sqrt(2 * math.log(2 / level) / (var * n * np.log(n + 1))), cap)
        bet_x = state["bet_x"] + np.cumsum(lam * x)
        bet = state["bet"] + np.cumsum(lam)
        spread = state["spread"] + np.cumsum((x - mu) ** 2 * (-np.log1p(-lam) - lam))
        state.update(bet_x=bet_x[-1], bet=bet[-1], spread=spread[-1])
        radius = (spread + math.log(2 / level)) / bet
        return np.maximum(bet_x / bet - radius, 0.0), np.minimum(bet_x / bet + radius, 1.0), np.zeros(len(x), bool)

    return Sequence(step, (_COUNT, _PLUG_INS, (("bet_x", "bet", "spread"), step)))


def betting(level: float = 0.05, cap: float = 0.5, grid: int = BETTING_GRID) -> Sequence:
    """Candidate means that a hedged bettor hasn't ruled out; a candidate once rejected stays so, and with all rejected it has failed."""
    m = np.arange(grid) / (grid - 1.0)
    most_up, most_down = cap / np.maximum(m, 1e-4), cap / np.maximum(1 - m, 1e-4)

    def step(state, x):
        up, down, top_up, top_down = state["capital"]
        _, mu, var = plug_ins(state, x)
        alive = np.empty((len(x), grid), dtype=bool)
        for start in range(0, len(x), BLOCK):
            part = slice(start, start + BLOCK)
            gap = mu[part, None] - m
            lam = gap / (var[part, None] + gap**2)
            gain = x[part, None] - m
            ups = np.cumsum(np.log1p(np.clip(lam, 0.0, most_up) * gain), axis=0) + up
            downs = np.cumsum(np.log1p(-np.clip(-lam, 0.0, most_down) * gain), axis=0) + down
            up, down = ups[-1].copy(), downs[-1].copy()
            np.maximum.accumulate(ups, axis=0, out=ups)
            np.maximum.accumulate(downs, axis=0, out=downs)
            alive[part] = np.maximum(np.maximum(ups, top_up), np.maximum(downs, top_down)) < math.log(1 / level)
            top_up, top_down = np.maximum(ups[-1], top_up), np.maximum(downs[-1], top_down)
        state["capital"] = np.stack([up, down, top_up, top_down])
        failed = ~alive.any(axis=1)
        lo = np.where(failed, 0.0, m[alive.argmax(axis=1)])
        hi = np.where(failed, 1.0, m[grid - 1 - alive[:, ::-1].argmax(axis=1)])
        return lo, hi, failed

    return Sequence(step, (_COUNT, _PLUG_INS, (("capital",), step)), grid)


#: Confidence sequences by name.
SEQUENCES: dict[str, Callable[..., Sequence]] = {"hoeffding": hoeffding, "eb": empirical_bernstein, "betting": betting}
