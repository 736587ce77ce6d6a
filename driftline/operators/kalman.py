"""Constant-rate Kalman filter over each series, with a chi-square test of the innovations.

A series in one block is filtered in order. A longer one is filtered block by block in
parallel: filtering steps combine associatively (Särkkä and García-Fernández, "Temporal
Parallelization of Bayesian Smoothers", 2021), so each block is first reduced to one combined
step, the combined steps carry the state to the start of every block, and then all blocks are
filtered at once from their own start.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.operators.blocks import BLOCK, Ordered
from driftline.operators.per_series import Maker, add_columns, add_columns_by_block, floats, map_groups, to_arrow
from driftline.operators.steps import with_steps
from driftline.session import join_small, materialise

_STATE = ("_x0", "_x1", "_p00", "_p01", "_p11")


def chi_square_threshold(alpha: float) -> float:
    """Quantile of the chi-square distribution with one degree of freedom."""
    return NormalDist().inv_cdf((1.0 + alpha) / 2.0) ** 2


def detect_kalman(
    series: Ordered, value: str = "sma", noise: float = 0.13, r: float = 1.0, p0: float = 1000.0,
    alpha: float = 0.997,
) -> Ordered:
    """``innovation``, ``nis``, ``rate`` (per day), ``nis_threshold`` and ``kalman_maneuver``."""
    paired = with_steps(series.map(lambda rows: rows.select(*series.keys, series.order, BLOCK, value)), [value])
    return flag_innovations(kalman_filter(paired, value, noise, r, p0), alpha)


def flag_innovations(filtered: Ordered, alpha: float) -> Ordered:
    level = chi_square_threshold(alpha)
    return filtered.with_columns({
        "nis_threshold": F.lit(level),
        "kalman_maneuver": F.coalesce(F.col("nis") > F.lit(level), F.lit(False))})


def filter_maker(noise: float, r: float, p0: float, value: str) -> Maker:
    """Filters a whole series from its first two values."""

    def make(dt, z, z_before):
        rate = (z[0] - z_before[0]) / dt[0] if dt[0] != 0 else np.nan
        return run_filter(dt, z, (z_before[0], rate, p0, 0.0, p0), noise, r)

    return Maker(("dt_days", value, "_z_before"), _OUTPUTS, make)


_OUTPUTS = {"innovation": "double", "nis": "double", "rate": "double"}


def kalman_filter(paired: Ordered, value: str, noise: float, r: float, p0: float) -> Ordered:
    """The filter over rows paired by ``with_steps`` with ``value`` carried; drops ``before``."""
    maker = filter_maker(noise, r, p0, value)
    ready = paired.with_columns({"_z_before": F.col(f"before.{value}")}).drop("before")
    return ready.map(lambda rows: add_columns(rows, list(paired.keys), paired.order, [maker]),
                     lambda rows: _filter_blocks(paired, materialise(rows, "kalman"), value, noise, r, p0)).drop("_z_before")


def run_filter(dt, z, state, noise, r):
    """Innovation, its square over its variance, and the filtered rate, step by step."""
    x0, x1, p00, p01, p11 = (float(s) for s in state)
    innovations, scores, rates = [], [], []
    for d, seen in zip(dt.tolist(), z.tolist(), strict=True):
        d2 = d * d
        m0 = x0 + d * x1
        m00 = p00 + 2.0 * d * p01 + d2 * p11 + noise * d2 * d2 / 4.0
        m01 = p01 + d * p11 + noise * d2 * d / 2.0
        m11 = p11 + noise * d2
        y = seen - m0
        s = m00 + r
        x0 = m0 + m00 / s * y
        x1 = x1 + m01 / s * y
        p00 = m00 - m00 * m00 / s
        p01 = m01 - m00 * m01 / s
        p11 = m11 - m01 * m01 / s
        innovations.append(y)
        scores.append(y * y / s)
        rates.append(x1)
    return np.array(innovations), np.array(scores), np.array(rates)


# -- series of several blocks -------------------------------------------------------------


def _filter_blocks(
    paired: Ordered, rows: DataFrame, value: str, noise: float, r: float, p0: float,
) -> DataFrame:
    keys = list(paired.keys)
    key_fields = [rows.schema[k] for k in keys]
    order = paired.order
    starts = materialise(rows.where(F.col("k") == 0).select(
        *keys, F.col("_z_before").alias("_x0"),
        F.try_divide(F.col(value) - F.col("_z_before"), F.col("dt_days")).alias("_x1")), "starts")
    combined_schema = T.StructType(
        [*key_fields, rows.schema[BLOCK], T.StructField("_step", T.ArrayType(T.DoubleType()))])

    def reduce_blocks(table: pa.Table, bounds: np.ndarray) -> pa.Table:
        steps = combine_runs(single_steps(floats(table["dt_days"]), floats(table[value]), noise, r), bounds)
        head = table.select([*keys, BLOCK]).take(pa.array(bounds[:-1]))
        return head.append_column("_step", pa.array(list(steps), pa.list_(pa.float64())))

    blocks = materialise(map_groups(
        rows.select(*keys, BLOCK, order, "dt_days", value), [*keys, BLOCK], order, combined_schema, reduce_blocks), "block-steps")
    state_schema = T.StructType([*key_fields, rows.schema[BLOCK],
                                 *[T.StructField(c, T.DoubleType()) for c in _STATE]])

    def carry_state(table: pa.Table, bounds: np.ndarray) -> pa.Table:  # one row per block of each series
        states = carried_states(floats(table["_x0"]), floats(table["_x1"]), np.array(table["_step"].to_pylist(), dtype=float), bounds, p0)
        out = table.select([*keys, BLOCK])
        for name, values in zip(_STATE, states.T, strict=True):
            out = out.append_column(name, to_arrow(values, "double"))
        return out

    states = materialise(
        map_groups(join_small(blocks, starts, keys, "inner"), keys, BLOCK, state_schema, carry_state), "block-states")

    def make(dt, z, *state):
        return run_filter(dt, z, [s[0] for s in state], noise, r)

    ready = rows.join(states, [*keys, BLOCK])
    out = add_columns_by_block(
        ready, [*keys, BLOCK], order, [Maker(("dt_days", value, *_STATE), _OUTPUTS, make)])
    return out.drop(*_STATE)


def single_steps(dt, z, noise, r):
    """Each filtering step in the form that composes: (n, 16) as A, b, C, eta, J."""
    n = len(dt)
    f = np.zeros((n, 2, 2))
    f[:, 0, 0] = f[:, 1, 1] = 1.0
    f[:, 0, 1] = dt
    q = noise * np.stack([
        np.stack([dt ** 4 / 4, dt ** 3 / 2], -1), np.stack([dt ** 3 / 2, dt ** 2], -1)], -2)
    s = q[:, 0, 0] + r
    gain = q[:, :, 0] / s[:, None]
    keep = np.tile(np.eye(2), (n, 1, 1))
    keep[:, :, 0] -= gain
    seen = f[:, 0, :]  # observation row times the transition
    return _pack(keep @ f, gain * z[:, None], keep @ q, seen * (z / s)[:, None],
                 seen[:, :, None] * seen[:, None, :] / s[:, None, None])


def _pack(a, b, c, eta, j):
    n = len(b)
    return np.concatenate([a.reshape(n, 4), b, c.reshape(n, 4), eta, j.reshape(n, 4)], axis=1)


def _unpack(steps):
    n = len(steps)
    return (steps[:, :4].reshape(n, 2, 2), steps[:, 4:6], steps[:, 6:10].reshape(n, 2, 2),
            steps[:, 10:12], steps[:, 12:].reshape(n, 2, 2))


def combine(first, second):
    """The single step equal to ``first`` followed by ``second``, for stacks of steps."""
    a1, b1, c1, e1, j1 = _unpack(first)
    a2, b2, c2, e2, j2 = _unpack(second)
    t = lambda m: np.swapaxes(m, -1, -2)
    vec = lambda m, v: np.einsum("nij,nj->ni", m, v)
    inv = np.linalg.inv(np.eye(2) + c1 @ j2)
    a2i = a2 @ inv
    back = t(a1) @ t(inv)  # (I + J2 C1)^-1 is the transpose of (I + C1 J2)^-1
    return _pack(a2i @ a1, vec(a2i, b1 + vec(c1, e2)) + b2, a2i @ c1 @ t(a2) + c2,
                 vec(back, e2 - vec(j2, b1)) + e1, back @ j2 @ a1 + j1)


def combine_all(steps):
    """The one step equal to all of them."""
    return combine_runs(steps, np.array([0, len(steps)]))[0]


def combine_runs(steps, bounds):
    """One step per run ``bounds[i]:bounds[i + 1]``; pairwise, so that rounding grows with the logarithm of the length."""
    size = np.diff(bounds)
    steps = steps.copy()
    while (size > 1).any():
        first = np.cumsum(size) - size
        at = np.arange(len(steps)) - np.repeat(first, size)
        left = np.flatnonzero((at % 2 == 0) & (at + 1 < np.repeat(size, size)))
        steps[left] = combine(steps[left], steps[left + 1])
        steps = steps[at % 2 == 0]
        size = (size + 1) // 2
    return steps


def carried_states(x0, x1, steps, bounds, p0):
    """The state before each step of each series: mean and covariance as ``_STATE``. All series go side by side."""
    states = np.empty((len(steps), len(_STATE)))
    size, first = np.diff(bounds), bounds[:-1]
    mean = np.stack([x0[first], x1[first]], axis=-1)
    cover = np.tile(np.diag([p0, p0]).astype(float), (len(first), 1, 1))
    for turn in range(int(size.max(initial=0))):
        going = size > turn
        if not going.all():
            size, first, mean, cover = size[going], first[going], mean[going], cover[going]
        at = first + turn
        states[at] = np.stack([mean[:, 0], mean[:, 1], cover[:, 0, 0], cover[:, 0, 1], cover[:, 1, 1]], axis=-1)
        mean, cover = apply_steps(mean, cover, steps[at])
    return states


def apply_steps(mean, cover, steps):
    """Each state after its step, for stacks of them."""
    a, b, c, eta, j = _unpack(steps)
    vec = lambda m, v: np.einsum("nij,nj->ni", m, v)
    ai = a @ np.linalg.inv(np.eye(2) + cover @ j)
    moved = ai @ cover @ np.swapaxes(a, -1, -2) + c
    return vec(ai, mean + vec(cover, eta)) + b, (moved + np.swapaxes(moved, -1, -2)) / 2.0


def apply_step(mean, cover, step):
    mean, cover = apply_steps(mean[None], cover[None], step[None])
    return mean[0], cover[0]
