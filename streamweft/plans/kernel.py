"""Vectorised sampling and Runge-Kutta stepping for batches of particles in numpy."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from ..schema import STATIONARY, Integration, Order, Status

#: samples (positions, times, particle rows) -> (velocities, inside)
Sampler = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]

_RUN, _OKAY, _OUT, _CRITICAL, _FAIL, _MAX = range(6)
STATUS = [Status.RUN.value, Status.OKAY.value, Status.OUT_OF_BOUND.value, Status.CRITICAL.value, Status.FAIL.value, Status.MAX_POINTS.value]


@dataclass
class Grid:
    """Dense values (nt, nz, ny, nx, 3) and the boxes of lookups and of traces.

    With ``spread`` (same shape) every lookup draws a value: a polar pair gives
    Gaussian deviates from a counter hash of (sample key, lookup number).  ``trace`` numbers
    the lookups of each line, so a line is the same whatever is traced with it.
    """

    values: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    real_lo: np.ndarray
    real_hi: np.ndarray
    t0: float = 0.0
    spread: np.ndarray | None = None
    run_seed: int = 0
    normalize: bool = False
    real_t: tuple[float, float] | None = None
    #: Of a brick: the whole domain (lo, hi of x, y, z, t).  ``short`` gets the keys of particles of which a step asked for a place in it beyond the brick.
    domain: tuple[np.ndarray, np.ndarray] | None = None

    def __post_init__(self) -> None:
        self.lo, self.hi, self.real_lo, self.real_hi = (np.asarray(a, float) for a in (self.lo, self.hi, self.real_lo, self.real_hi))
        nt, nz, ny, nx, _ = self.values.shape
        self.dims = np.array([nx, ny, nz])
        self.spacing = np.where(self.dims > 1, (self.hi - self.lo) / np.maximum(self.dims - 1, 1), 1.0)
        self.t1 = self.t0 + nt - 1
        self.real_t = self.real_t or (self.t0, self.t1)
        self.time_varying = nt > 1
        self.calls = 0
        self.short: set[int] = set()
        self.watch = False

    def cell_size(self) -> float:
        return float(np.prod(self.spacing)) ** (1 / 3)

    def sample(self, p: np.ndarray, t: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = ((p >= self.lo) & (p <= self.hi)).all(1)
        if self.time_varying:
            ok &= (t >= self.t0) & (t <= self.t1)
        if self.watch and self.domain is not None and not ok.all():
            q = np.column_stack([p, t])
            self.short.update(row[~ok & ((q >= self.domain[0]) & (q <= self.domain[1])).all(1)].tolist())
        g = np.where(ok[:, None], (p - self.lo) / self.spacing, 0.0)
        c = np.minimum(np.floor(g).astype(np.int64), np.maximum(self.dims - 2, 0))
        f = g - c
        s = np.where(ok, t - self.t0, 0.0) if self.time_varying else np.zeros(len(p))
        low = np.floor(s).astype(np.int64)
        part = (s - low)[:, None]
        high = np.minimum(low + 1, len(self.values) - 1)
        out = self._at(self.values, low, c, f)
        if self.time_varying:
            out = out * (1 - part) + self._at(self.values, high, c, f) * part
        if self.spread is not None:
            out = out + self._at(self.spread, low, c, f) * self._gauss(row)
        if self.normalize:
            size = np.linalg.norm(out, axis=1, keepdims=True)
            out = np.divide(out, size, out=out.copy(), where=size > 0)
        return out, ok

    def _at(self, values: np.ndarray, t: np.ndarray, c: np.ndarray, f: np.ndarray) -> np.ndarray:
        i, j, k = c.T
        nx, ny, nz = self.dims
        flat = values.reshape(-1, 3)
        at = ((t * nz + k) * ny + j) * nx + i
        right, back, up = (np.where(n + 1 < m, stride, 0) for n, m, stride in zip((i, j, k), (nx, ny, nz), (1, nx, nx * ny), strict=True))
        behind, above = at + back, at + up
        over = behind + up
        a, b, d = (f[:, n, None] for n in range(3))
        na, nb = 1 - a, 1 - b
        value = lambda node: flat.take(node, axis=0)
        low = (value(at) * na + value(at + right) * a) * nb + (value(behind) * na + value(behind + right) * a) * b
        high = (value(above) * na + value(above + right) * a) * nb + (value(over) * na + value(over + right) * a) * b
        return low * (1 - d) + high * d

    def _gauss(self, row: np.ndarray) -> np.ndarray:
        self.calls += 1
        out = np.empty((len(row), 3))
        with np.errstate(over="ignore"):
            for n in range(3):
                x = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((self.calls * 6 + n * 2 + 1 + self.run_seed * 7919) & 0xFFFFFFFFFFFFFFFF)
                a, b = _mix(x), _mix(x + np.uint64(0xD1B54A32D192ED03))
                u = ((a >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)
                v = (b >> np.uint64(11)).astype(float) / (1 << 53)
                out[:, n] = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
        return out

    def in_real(self, p: np.ndarray, t: np.ndarray) -> np.ndarray:
        ok = ((p >= self.real_lo) & (p <= self.real_hi)).all(1)
        if self.time_varying:
            ok &= (t >= self.real_t[0]) & (t <= self.real_t[1])
        return ok


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# Cash-Karp: nodes, stage weights, fifth-order weights and the embedded error's
_NODES = (0.0, 1 / 5, 3 / 10, 3 / 5, 1.0, 7 / 8)
_STAGES = ((), (1 / 5,), (3 / 40, 9 / 40), (3 / 10, -9 / 10, 6 / 5), (-11 / 54, 5 / 2, -70 / 27, 35 / 27), (1631 / 55296, 175 / 512, 575 / 13824, 44275 / 110592, 253 / 4096))
_FIFTH = (37 / 378, 0.0, 250 / 621, 125 / 594, 0.0, 512 / 1771)
_FOURTH = (2825 / 27648, 0.0, 18575 / 48384, 13525 / 55296, 277 / 14336, 1 / 4)


def step(sample: Sampler, order: Order, p: np.ndarray, t: np.ndarray, h: np.ndarray, sign: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One step of signed length: new positions, whether all stages were inside, and the error norm (RK45)."""
    dt = (h * sign)[:, None]
    ok = np.ones(len(p), bool)

    def at(q: np.ndarray, share: float) -> np.ndarray:
        nonlocal ok
        v, inside = sample(q, t + dt[:, 0] * share, row)
        ok &= inside
        return v * dt

    if order is Order.SECOND:
        k1 = at(p, 0.0)
        k2 = at(p + k1, 1.0)
        return p + (k1 + k2) / 2, ok, np.zeros(len(p))
    if order is Order.FOURTH:
        k1 = at(p, 0.0)
        k2 = at(p + k1 / 2, 0.5)
        k3 = at(p + k2 / 2, 0.5)
        k4 = at(p + k3, 1.0)
        return p + (k1 + 2 * k2 + 2 * k3 + k4) / 6, ok, np.zeros(len(p))
    k: list[np.ndarray] = []
    for node, weights in zip(_NODES, _STAGES, strict=True):
        q = p + sum((w * x for w, x in zip(weights, k, strict=True)), np.zeros_like(p))
        k.append(at(q, node))
    new = p + sum(w * x for w, x in zip(_FIFTH, k, strict=True))
    error = sum((a - b) * x for a, b, x in zip(_FIFTH, _FOURTH, k, strict=True))
    return new, ok, np.linalg.norm(error, axis=1)


def _turn(before: np.ndarray, at: np.ndarray, after: np.ndarray) -> np.ndarray:
    a, b = at - before, after - at
    size = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
    cosine = np.divide((a * b).sum(1), size, out=np.ones(len(a)), where=size > 0)
    return np.degrees(np.arccos(np.clip(cosine, -1, 1)))


#: Number of the lookups before a backward line's first.
_BACK = 1 << 40


def trace(grid: Grid, seeds: np.ndarray, times: np.ndarray, sign: np.ndarray, keys: np.ndarray, options: Integration, max_points: int, carry: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trace a batch: (row, seq, position, time) of all points and each particle's status.

    Every particle has its own step and state; a batch advances until none runs.
    A steady field is sampled at the seed's time, an unsteady one at the current time.
    ``carry`` has the step ``h`` (NaN: the first one) and the ``previous`` point (NaN: none)
    of particles that go on with a line, and gets those after their last step.
    """
    n = len(seeds)
    # lookups are numbered by a line's own attempts, each direction by itself: draws don't depend on who is traced along
    base = grid.calls = _BACK if n and sign[0] < 0 else 0
    attempts, each = 0, {Order.SECOND: 2, Order.FOURTH: 4, Order.RK45: 6}[options.order] + 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 3)), np.zeros(0), np.zeros(0, np.int64)
    p, t = seeds.astype(float).copy(), times.astype(float).copy()
    state = np.full(n, _RUN)
    v, ok = grid.sample(p, t, keys)
    state[~ok] = _OUT
    state[ok & (np.abs(v) < STATIONARY).all(1)] = _CRITICAL
    live = state == _RUN
    rows, seqs, places, whens = [np.flatnonzero(live)], [np.zeros(live.sum(), np.int64)], [p[live].copy()], [t[live].copy()]
    h = np.full(n, float(options.step))
    if options.adaptive and not grid.time_varying:
        speed = np.linalg.norm(v, axis=1)
        h = np.where(speed < 1e-6, 1e-5 * options.step, options.step * grid.cell_size() / np.maximum(speed, 1e-300))
    if options.order is Order.RK45 and options.adaptive:
        h = np.clip(h, options.min_step, options.max_step)
    previous, count = p.copy(), np.ones(n, np.int64)
    if carry is not None:
        h = np.where(np.isnan(carry["h"]), h, carry["h"])
        going = ~np.isnan(carry["previous"]).any(1)
        previous[going] = carry["previous"][going]
        carry["h"], carry["previous"] = h, previous
    third_from = 2 if carry is None else np.where(going, 1, 2)
    state[live & (count >= max_points)] = _MAX
    angled = options.order is not Order.RK45 and options.adaptive
    while True:
        a = np.flatnonzero(state == _RUN)
        if not len(a):
            break
        grid.calls = base + 1 + each * attempts
        attempts += 1
        grid.watch = True
        new, ok, error = step(grid.sample, options.order, p[a], t[a], h[a], sign[a], keys[a])
        grid.watch = False
        # a stage outside: end at once, or with a tenth of the step down to the least one
        out = a[~ok]
        if len(out):
            stop = (not options.adaptive) | (h[out] <= options.min_step)
            state[out[stop]] = _OKAY
            h[out[~stop]] = np.maximum(0.1 * h[out[~stop]], options.min_step)
        new, error, a = new[ok], error[ok], a[ok]
        if not len(a):
            continue
        accept, following = np.ones(len(a), bool), h[a].copy()
        if options.order is Order.RK45 and options.adaptive:
            e = error / options.max_error
            accept = (e <= 1) | (h[a] <= options.min_step)
            safe = np.maximum(e, 1e-30)
            shrunk = np.maximum(0.9 * h[a] * safe**-0.25, 0.1 * h[a])
            grown = np.where(e > 1.89e-4, 0.9 * h[a] * safe**-0.2, 5 * h[a])
            following = np.clip(np.where(accept, grown, shrunk), options.min_step, options.max_step)
        elif angled:
            third = count[a] >= (third_from if carry is None else third_from[a])
            turn = np.where(third, _turn(previous[a], p[a], new), 0.0)
            sharp = third & (turn > options.high_angle)
            accept = ~sharp | (h[a] <= options.min_step)
            following = np.where(sharp, h[a] / 2, np.where(third & (turn < options.low_angle), h[a] * 2, h[a]))
            following = np.clip(following, options.min_step, options.max_step)
        used = h[a]
        h[a] = following
        new, used, a = new[accept], used[accept], a[accept]
        if not len(a):
            continue
        previous[a] = p[a]
        p[a] = new
        t[a] += used * sign[a]
        count[a] += 1
        rows.append(a)
        seqs.append(count[a] - 1)
        places.append(new.copy())
        whens.append(t[a].copy())
        inside = grid.in_real(new, t[a])
        v, ok = grid.sample(new, t[a], keys[a])
        still = (np.abs(v) < STATIONARY).all(1) & ok
        state[a] = np.where(~inside, _OUT, np.where(still, _CRITICAL, np.where(count[a] >= max_points, _MAX, _RUN)))
    return np.concatenate(rows), np.concatenate(seqs), np.concatenate(places), np.concatenate(whens), state


def clip_share(p: np.ndarray, q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Share of each segment p to q, p inside, up to the box."""
    d = q - p
    with np.errstate(divide="ignore", invalid="ignore"):
        s = np.where(d > 0, (hi - p) / d, np.where(d < 0, (lo - p) / d, 1.0))
    return np.clip(s.min(1), 0.0, 1.0)
