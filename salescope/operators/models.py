"""Series models fitted to many series at once: ARMA(1,1) based ARIMA and additive Holt-Winters.

A batch of series is one matrix, months by series. The filter steps through the months with vectors over all series
and carries the derivatives along, so likelihood and exact gradient of the whole batch cost one pass; a
quasi-Newton step for each series follows. Series of other lengths are padded at their end and masked.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

_LIMIT = 0.999  # of the absolute value of an ARMA parameter
_GRID = np.array([-0.99, -0.9, -0.7, -0.4, -0.1, 0.1, 0.4, 0.7, 0.9, 0.99])  # starting points
_STARTS = 4  # low points of the grid that are followed


def _padded(series: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(months x series, lengths); zeros after a series' end."""
    lengths = np.array([len(s) for s in series])
    out = np.zeros((lengths.max(initial=0), len(series)))
    for i, s in enumerate(series):
        out[: len(s), i] = s
    return out, lengths


def _minimise(f: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], x: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Least point and value of every column of ``x`` (parameters x series) by BFGS with backtracking.

    ``f`` takes points and the numbers of their series. A series whose next step promises nothing is left out of further rounds.
    """
    size, count = x.shape
    x, live = x.copy(), np.arange(count)
    cost, slope = f(x, live)
    inverse = np.repeat(np.eye(size)[:, :, None], count, axis=2)
    for _ in range(rounds):
        step = -np.einsum("ijs,js->is", inverse[:, :, live], slope[:, live])
        downhill = (step * slope[:, live]).sum(0)
        lost = ~(downhill < 0)
        inverse[:, :, live[lost]] = np.eye(size)[:, :, None]
        step[:, lost] = -slope[:, live[lost]]
        step *= np.minimum(1, 2 / np.maximum(np.sqrt((step**2).sum(0)), 1e-300))
        downhill = (step * slope[:, live]).sum(0)
        open_ = downhill < -1e-11 * np.maximum(1, np.abs(cost[live]))
        live, step, downhill = live[open_], step[:, open_], downhill[open_]
        left, share = np.arange(len(live)), 1.0
        moved, turned = np.zeros((size, len(live))), np.zeros((size, len(live)))
        for _ in range(20):  # those without a better point so far halve their step
            if not len(left):
                break
            own = live[left]
            value, gradient = f(x[:, own] + share * step[:, left], own)
            good = value <= cost[own] + 1e-4 * share * downhill[left]
            done = own[good]
            moved[:, left[good]], turned[:, left[good]] = share * step[:, left[good]], gradient[:, good] - slope[:, done]
            x[:, done] += share * step[:, left[good]]
            cost[done], slope[:, done] = value[good], gradient[:, good]
            left, share = left[~good], share / 2
        live, moved, turned = np.delete(live, left), np.delete(moved, left, axis=1), np.delete(turned, left, axis=1)
        if not len(live):
            break
        curve = (moved * turned).sum(0)
        use = curve > 1e-14
        h, s, y, rho = inverse[:, :, live[use]], moved[:, use], turned[:, use], 1 / curve[use]
        hy = np.einsum("ijs,js->is", h, y)
        cross = np.einsum("is,js->ijs", s, hy)
        inverse[:, :, live[use]] = h + (1 + rho * (y * hy).sum(0)) * rho * np.einsum("is,js->ijs", s, s) - rho * (cross + cross.transpose(1, 0, 2))
    return x, cost


# -- ARMA(1,1)


def arma_likelihood(values: np.ndarray, lengths: np.ndarray, phi: np.ndarray, theta: np.ndarray, with_mean: bool, gradient: bool = True):
    """Concentrated -2 log-likelihood (up to a constant), its gradient, mean, variance and the next prediction.

    Exact innovations of an ARMA(1,1) for each series at its own (phi, theta); ``values`` is months x series.
    The best mean and variance for given parameters are closed forms, and the gradient needs no derivative of them.
    """
    inputs = [values, np.ones_like(values)] if with_mean else [values]
    k, s = len(inputs), values.shape[1]
    base = 1 - phi**2
    ratio = (1 + 2 * phi * theta + theta**2) / base
    d_ratio = np.array([(2 * theta * base + 2 * phi * (1 + 2 * phi * theta + theta**2)) / base**2, 2 * (phi + theta) / base])
    guess, d_guess = np.zeros((k, s)), np.zeros((k, 2, s))
    products, d_products = np.zeros((k, k, s)), np.zeros((k, k, 2, s))
    logs, d_logs, ahead = np.zeros(s), np.zeros((2, s)), np.zeros((k, s))
    for t in range(len(values)):
        live = t < lengths
        value = np.array([x[t] for x in inputs])
        error, d_error = value - guess, -d_guess
        for i in range(k):
            for j in range(i, k):
                products[i, j] += live * error[i] * error[j] / ratio
                if gradient:
                    d_products[i, j] += live * ((d_error[i] * error[j] + error[i] * d_error[j]) / ratio - error[i] * error[j] * d_ratio / ratio**2)
        logs += live * np.log(ratio)
        if gradient:
            d_logs += live * d_ratio / ratio
            d_guess = theta * (d_error / ratio - error[:, None] * d_ratio / ratio**2)
            d_guess[:, 0] += value
            d_guess[:, 1] += error / ratio
            d_ratio = theta**2 * d_ratio / ratio**2
            d_ratio[1] += 2 * theta - 2 * theta / ratio
        guess = phi * value + theta / ratio * error
        ratio = 1 + theta**2 - theta**2 / ratio
        ahead = np.where(t == lengths - 1, guess, ahead)
    mean = products[0, 1] / products[1, 1] if with_mean else np.zeros(s)
    whole, d_whole, following = products[0, 0], d_products[0, 0], ahead[0]
    if with_mean:
        whole = whole - mean * products[0, 1]
        d_whole = d_whole - 2 * mean * d_products[0, 1] + mean**2 * d_products[1, 1]
        following = following - mean * ahead[1]
    whole = np.maximum(whole, 1e-300)
    cost = lengths * np.log(whole / lengths) + logs
    return cost, lengths * d_whole / whole + d_logs, mean, whole / lengths, following


def fit_arma(values: np.ndarray, lengths: np.ndarray, with_mean: bool):
    """Maximum likelihood (phi, theta, mean, variance, next prediction) of every series, from the low points of a grid."""
    s, points = values.shape[1], np.array([(p, q) for p in _GRID for q in _GRID])

    def f(x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bent = np.tanh(x)
        cost, slope, *_ = arma_likelihood(values[:, own], lengths[own], _LIMIT * bent[0], _LIMIT * bent[1], with_mean)
        return np.where(np.isfinite(cost), cost, np.inf), slope * _LIMIT * (1 - bent**2)

    phi, theta = (np.repeat(points[:, i], s) for i in (0, 1))
    costs = arma_likelihood(np.tile(values, len(points)), np.tile(lengths, len(points)), phi, theta, with_mean, gradient=False)[0].reshape(len(points), s)
    side = len(_GRID)
    table = np.pad(np.where(np.isfinite(costs), costs, np.inf).reshape(side, side, s), ((1, 1), (1, 1), (0, 0)), constant_values=np.inf)
    inner = table[1:-1, 1:-1]
    around = np.minimum.reduce([table[:-2, 1:-1], table[2:, 1:-1], table[1:-1, :-2], table[1:-1, 2:]])
    low = np.where(inner <= around, inner, np.inf).reshape(side * side, s)
    order = np.argsort(low, axis=0)[:_STARTS]
    x, least = np.zeros((2, s)), np.full(s, np.inf)
    for rank, start in enumerate(order):
        own = np.flatnonzero(np.isfinite(low[start, np.arange(s)]) | (rank == 0))
        point, cost = _minimise(lambda at, part, own=own: f(at, own[part]), np.arctanh(points[start[own]].T / _LIMIT))
        better = cost < least[own]
        x[:, own[better]], least[own[better]] = point[:, better], cost[better]
    phi, theta = _LIMIT * np.tanh(x)
    _, _, mean, variance, ahead = arma_likelihood(values, lengths, phi, theta, with_mean)
    return phi, theta, mean, variance, ahead


def _fit_arma(series: np.ndarray, with_mean: bool):
    """The same for one series."""
    return tuple(float(x[0]) for x in fit_arma(np.asarray(series, float)[:, None], np.array([len(series)]), with_mean))


def arima_forecasts(series: Sequence[np.ndarray], steps: int, differenced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Forecasts and standard errors, series x steps: ARIMA(1,1,1) without, or ARIMA(1,0,1) with a constant.

    A series whose (differenced) values are all equal goes on in a line, without error.
    """
    series = [np.asarray(v, dtype=float) for v in series]
    inner = [np.diff(v) if differenced else v for v in series]
    last = np.array([v[-1] for v in series])
    growth = np.array([d[-1] if differenced else 0.0 for d in inner])
    path = last[:, None] + growth[:, None] * np.arange(1, steps + 1)
    error = np.zeros_like(path)
    open_ = np.flatnonzero([np.ptp(d) != 0 for d in inner])
    if not len(open_):
        return path, error
    scale = np.array([np.abs(inner[i]).max() for i in open_])
    values, lengths = _padded([inner[i] / c for i, c in zip(open_, scale)])
    phi, theta, mean, variance, ahead = fit_arma(values, lengths, with_mean=not differenced)
    powers = phi[:, None] ** np.arange(steps)
    deviations = ahead[:, None] * powers
    weights = np.concatenate([np.ones((len(open_), 1)), (phi + theta)[:, None] * powers[:, : steps - 1]], axis=1)
    if differenced:
        path[open_], weights = last[open_, None] + scale[:, None] * np.cumsum(deviations, axis=1), np.cumsum(weights, axis=1)
    else:
        path[open_] = scale[:, None] * (mean[:, None] + deviations)
    error[open_] = scale[:, None] * np.sqrt(variance[:, None] * np.cumsum(weights**2, axis=1))
    return path, error


def arima_forecast(values: np.ndarray, steps: int, differenced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Forecast and standard error of one series."""
    path, error = arima_forecasts([values], steps, differenced)
    return path[0], error[0]


# -- Holt-Winters


def _smoothing(values: np.ndarray, lengths: np.ndarray, weights: np.ndarray, season: int):
    """Squared one-step error, its gradient by the three weights, and the state after each series' end."""
    s = values.shape[1]
    first, second = values[:season].mean(0), values[season : 2 * season].mean(0)
    slope = (second - first) / season
    start = first - slope * (season + 1) / 2  # one step before the data, on the line through the two seasons' means
    seasonal = values[:season] - (start + slope * np.arange(1, season + 1)[:, None])
    level, trend, shape = start, slope, seasonal.copy()
    d_level, d_trend, d_shape = np.zeros((3, s)), np.zeros((3, s)), np.zeros((3, season, s))
    alpha, beta, gamma = weights
    cost, d_cost = np.zeros(s), np.zeros((3, s))
    for t in range(len(values)):
        live, at = t < lengths, t % season
        expected, d_expected = level + trend, d_level + d_trend
        error, d_error = values[t] - expected - shape[at], -d_expected - d_shape[:, at]
        cost += live * error**2
        d_cost += live * 2 * error * d_error
        new = expected + alpha * error
        d_new = d_expected + alpha * d_error
        d_new[0] += error
        moved, d_moved = new - level - trend, d_new - d_level - d_trend
        new_trend, d_new_trend = trend + beta * moved, d_trend + beta * d_moved
        d_new_trend[1] += moved
        new_shape, d_new_shape = shape[at] + gamma * error, d_shape[:, at] + gamma * d_error
        d_new_shape[2] += error
        level, trend = np.where(live, new, level), np.where(live, new_trend, trend)
        shape[at] = np.where(live, new_shape, shape[at])
        d_level, d_trend, d_shape[:, at] = np.where(live, d_new, d_level), np.where(live, d_new_trend, d_trend), np.where(live, d_new_shape, d_shape[:, at])
    return cost, d_cost, level, trend, shape


def holt_winters_forecasts(series: Sequence[np.ndarray], steps: int, season: int = 12) -> np.ndarray:
    """Series x steps with additive trend and season; smoothing weights minimise the squared one-step error.

    Every series needs two seasons.
    """
    series = [np.asarray(v, dtype=float) for v in series]
    scale = np.array([max(np.ptp(v), 1e-300) for v in series])
    offset = np.array([v.mean() for v in series])
    values, lengths = _padded([(v - o) / c for v, o, c in zip(series, offset, scale)])

    def f(x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weights = 1 / (1 + np.exp(-np.clip(x, -40, 40)))
        cost, slope, *_ = _smoothing(values[:, own], lengths[own], weights, season)
        return np.where(np.isfinite(cost), cost, np.inf), slope * weights * (1 - weights)

    best, least = None, None
    for point in ((-2.0, -4.0, -2.0), (1.0, -2.0, -2.0), (-4.0, -4.0, 1.0)):
        x, cost = _minimise(f, np.repeat(np.array(point)[:, None], len(series), axis=1))
        best = x if best is None else np.where(cost < least, x, best)
        least = cost if least is None else np.minimum(cost, least)
    _, _, level, trend, shape = _smoothing(values, lengths, 1 / (1 + np.exp(-np.clip(best, -40, 40))), season)
    ahead = np.arange(1, steps + 1)
    places = (lengths[:, None] + ahead - 1) % season
    path = level[:, None] + ahead * trend[:, None] + np.take_along_axis(shape.T, places, axis=1)
    return offset[:, None] + scale[:, None] * path


def holt_winters_forecast(values: np.ndarray, steps: int, season: int = 12) -> np.ndarray:
    """Forecast of one series."""
    return holt_winters_forecasts([values], steps, season)[0]
