import datetime

import numpy as np
import pytest

from salescope.operators import forecast
from salescope.operators.models import (
    _fit_arma, _padded, _smoothing, arima_forecast, arima_forecasts, arma_likelihood, fit_arma, holt_winters_forecast, holt_winters_forecasts,
)


def months(n, start=2020):
    return [datetime.date(start + i // 12, i % 12 + 1, 1) for i in range(n)]


@pytest.fixture
def series_of(spark):
    def make(**named):
        rows = [(name, m, float(v)) for name, values in named.items() for m, v in zip(months(len(values)), values)]
        return spark.createDataFrame(rows, "series string, month date, revenue double")

    return make


def test_parameters_are_recovered():
    rng = np.random.default_rng(1)
    noise, w = rng.normal(size=4000), np.zeros(4000)
    for t in range(1, 4000):
        w[t] = 0.7 * w[t - 1] + noise[t] + 0.3 * noise[t - 1]
    phi, theta, mean, variance, _ = _fit_arma(w + 5, True)
    assert phi == pytest.approx(0.7, abs=0.05) and theta == pytest.approx(0.3, abs=0.05)
    assert mean == pytest.approx(5, abs=0.2) and variance == pytest.approx(1, abs=0.1)


def test_constant_and_linear_series():
    assert list(arima_forecast(np.full(20, 5.0), 3, True)[0]) == [5, 5, 5]
    assert list(arima_forecast(np.full(20, 5.0), 3, False)[0]) == [5, 5, 5]
    assert arima_forecast(np.arange(20.0), 3, True)[0] == pytest.approx([20, 21, 22])


def test_errors_widen():
    values = 100 + np.cumsum(np.random.default_rng(2).normal(size=60))
    for differenced in (True, False):
        path, error = arima_forecast(values, 5, differenced)
        assert (np.diff(error) > 0).all() and np.isfinite(path).all()


def test_holt_winters_follows_a_clean_season():
    x = np.arange(72)
    curve = 1000 + 5 * x + 100 * np.sin(2 * np.pi * x / 12)
    assert holt_winters_forecast(curve[:60], 12) == pytest.approx(curve[60:], abs=1)


def test_bounds_and_gate(series_of):
    rng = np.random.default_rng(3)
    series = series_of(long=1000 + rng.normal(0, 50, 30), short=[1.0] * 11)
    rows = forecast.forecast_with_bounds(series).orderBy("step").collect()
    assert {r.series for r in rows} == {"long"} and [r.step for r in rows] == [1, 2, 3]
    assert all(r.lower <= r.forecast <= r.upper for r in rows)
    assert rows[0].month == datetime.date(2022, 7, 1)
    assert [tuple(r) for r in forecast.insufficient(series).collect()] == [("short", 11, "insufficient_data")]
    wide = forecast.forecast_with_bounds(series, level=0.99).orderBy("step").first()
    assert wide.upper > rows[0].upper and wide.lower < rows[0].lower


def test_ensemble_is_the_mean_of_its_methods(series_of):
    series = series_of(two_years=np.linspace(100, 400, 30), one_year=np.linspace(100, 200, 14))
    for r in forecast.ensemble_forecast(series).collect():
        parts = [v for v in (r.arima, r.moving_average, r.holt_winters) if v is not None]
        assert len(parts) == (3 if r.series == "two_years" else 2)
        assert r.ensemble == np.floor(np.mean(parts))


def test_explanation(series_of):
    row = forecast.explained_forecast(series_of(s=np.arange(1, 25) * 100.0), period="Q1").first()
    assert row.trend_direction == "increasing" and row.avg_monthly_change == 100.0
    assert row.explanation == (
        "Based on historical trends, revenue is projected to increasing by $100 per month over the next 3 months for Q1. "
        "Current monthly revenue is $2,400."
    )


def test_product_strategies(sales_of):
    def rows(name, values):
        return [(m.isoformat(), "c", name, "r", v, 0, 1.0, "paid") for m, v in zip(months(len(values), 2024), values) if v is not None]

    sales = sales_of(
        rows("short", [5, 5]) + rows("growing", [100, 110, 121]) + rows("flat", [7, 7, 7]) + rows("from_zero", [10, None, 10, 40])
        + rows("gappy", [10, 20, None, 30, 60, 90, 120]) + rows("steady", [100, 101, 99, 100, 102, 98, 100])
    )
    got = {(r.product, r.step): r for r in forecast.product_forecasts(sales).collect()}
    assert got["short", None].method == "insufficient_data" and got["short", None].forecast_sum is None
    assert [got["growing", i].forecast for i in (1, 2, 3)] == [133.0, 146.0, 161.0]
    assert got["flat", 1].forecast == 7.0 and got["flat", 1].forecast_sum == 21.0
    # Growth out of a zero month is undefined: mean of the last three months.
    assert got["from_zero", 1].forecast == 16.0 and got["from_zero", 1].method.startswith("Trend")
    assert got["gappy", 2].forecast == 90.0 and got["gappy", 2].method == "Moving Average (due to zeros)"
    assert got["steady", 1].method == "ARIMA (1,0,1)" and 97 <= got["steady", 1].forecast <= 103
    assert got["steady", 1].month_name == "August 2024"
    forecasts = forecast.product_forecasts(sales)
    assert forecast.top_product(forecasts).first().product == "growing"
    assert {r.product: r.trend for r in forecast.forecast_trends(forecasts).collect()}["short"] == "stable"


def test_queries_of_all_methods_hold_fitted_products(sales_of, monkeypatch):
    from salescope.plans import forecast_queries

    values = {"steady": [100, 101, 99, 100, 102, 98, 100], "growing": [100, 110, 121], "short": [5, 5], "gappy": [10, 20, None, 30, 60, 90, 120]}
    sales = sales_of([
        (m.isoformat(), "c", name, "r", v, 0, 1.0, "paid")
        for name, own in values.items() for m, v in zip(months(len(own), 2024), own) if v is not None
    ])
    monkeypatch.setattr(forecast_queries, "customer_years", lambda spark, sf_dir: sales)
    rows = forecast_queries.QUERIES["forecast_by_customer_year_all"](sales.sparkSession, "").collect()
    assert {(r.product, r.step) for r in rows} == {(p, i) for p in values if p != "short" for i in (1, 2, 3)} | {("short", None)}
    assert {r.method for r in rows if r.product == "steady"} == {"ARIMA (1,0,1)"}
    chart = forecast_queries.QUERIES["forecast_chart_series_all"](sales.sparkSession, "").collect()
    totals = {r.product: r.forecast_sum for r in rows if r.forecast_sum}
    assert sorted(r.forecast for r in chart) == sorted(totals.values()) and len(chart) == 3
    assert 291 <= totals["steady"] <= 309
    checked = forecast_queries.QUERIES["forecast_chart_series"](sales.sparkSession, "").collect()
    assert len(checked) == 2  # the part that SQL follows


def many_series(count, longest=72, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        n = int(rng.integers(12, longest))
        noise, (phi, theta), w = rng.normal(size=n + 1), rng.uniform(-0.9, 0.9, 2), np.zeros(n + 1)
        for t in range(1, n + 1):
            w[t] = phi * w[t - 1] + noise[t] + theta * noise[t - 1]
        out.append(w[1:] + 3 * rng.normal())
    return out


def test_gradients_are_those_of_the_likelihood_and_the_error():
    values, lengths = _padded(many_series(50))
    phi, theta = np.random.default_rng(2).uniform(-0.8, 0.8, (2, 50))
    h = 1e-6
    for with_mean in (False, True):
        slope = arma_likelihood(values, lengths, phi, theta, with_mean)[1]
        for k, (a, b) in enumerate([(h, 0), (0, h)]):
            near = [arma_likelihood(values, lengths, phi + s * a, theta + s * b, with_mean, gradient=False)[0] for s in (1, -1)]
            assert (near[0] - near[1]) / (2 * h) == pytest.approx(slope[k], rel=1e-4, abs=1e-4)
    values, lengths = _padded(many_series(20, 40, 3)[:20])
    values = np.vstack([values, values])[:40]
    lengths = np.maximum(lengths, 24)
    weights = np.random.default_rng(4).uniform(0.1, 0.9, (3, values.shape[1]))
    slope = _smoothing(values, lengths, weights, 12)[1]
    for k in range(3):
        move = h * np.eye(3)[k][:, None]
        near = [_smoothing(values, lengths, weights + s * move, 12)[0] for s in (1, -1)]
        assert (near[0] - near[1]) / (2 * h) == pytest.approx(slope[k], rel=1e-4, abs=1e-4)


def dense_likelihood(series, phi, theta, mean, variance):
    """-2 log-likelihood of a normal vector with the autocovariances of an ARMA(1,1)."""
    n = len(series)
    first = (1 + 2 * phi * theta + theta**2) / (1 - phi**2)
    second = (1 + phi * theta) * (phi + theta) / (1 - phi**2)
    lag = np.abs(np.subtract.outer(np.arange(n), np.arange(n)))
    covariance = variance * np.where(lag == 0, first, second * phi ** np.maximum(lag - 1, 0))
    error = series - mean
    return n * np.log(2 * np.pi) + np.linalg.slogdet(covariance)[1] + error @ np.linalg.solve(covariance, error)


def test_bulk_likelihood_is_that_of_each_series_alone():
    series = many_series(1_000)
    values, lengths = _padded(series)
    phi, theta = np.random.default_rng(5).uniform(-0.9, 0.9, (2, len(series)))
    cost, _, mean, variance, _ = arma_likelihood(values, lengths, phi, theta, True)
    alone = [dense_likelihood(s, p, q, m, v) for s, p, q, m, v in zip(series, phi, theta, mean, variance)]
    assert cost + lengths * (1 + np.log(2 * np.pi)) == pytest.approx(alone, abs=1e-8, rel=1e-10)


def test_fits_in_bulk_are_those_of_each_series_alone_and_no_worse_than_a_grid():
    series = many_series(60, seed=7)
    values, lengths = _padded(series)
    phi, theta, *_ = fit_arma(values, lengths, True)
    cost = arma_likelihood(values, lengths, phi, theta, True)[0]
    for i in (0, 17, 42):
        p, q, *_ = _fit_arma(series[i], True)
        assert arma_likelihood(series[i][:, None], lengths[i : i + 1], np.array([p]), np.array([q]), True)[0][0] == pytest.approx(cost[i], abs=1e-8)
    side = np.linspace(-0.95, 0.95, 20)
    best = np.min([arma_likelihood(values, lengths, np.full(60, p), np.full(60, q), True, gradient=False)[0] for p in side for q in side], axis=0)
    assert (cost <= best + 1e-6).mean() >= 0.95
    mixed = [np.full(14, 5.0), np.arange(20.0), *series[:3]]
    path, error = arima_forecasts(mixed, 3, True)
    assert path[0].tolist() == [5, 5, 5] and path[1] == pytest.approx([20, 21, 22]) and error[0].tolist() == [0, 0, 0]
    assert path[3] == pytest.approx(arima_forecast(mixed[3], 3, True)[0], abs=1e-5)


def test_seasons_of_several_lengths():
    season = np.array([5, 1, 0, 2, 8, 3, 9, 4, 7, 6, 2, 1.0])
    path = holt_winters_forecasts([np.tile(season, 3)[:n] for n in (24, 30, 36)], 4)
    for row, n in zip(path, (24, 30, 36)):
        assert row == pytest.approx([season[(n + i) % 12] for i in range(4)], abs=1e-6)


def test_explanation_counts_every_step(series_of):
    row = forecast.explained_forecast(series_of(s=np.arange(1, 25) * 100.0), steps=6).first()
    assert row.avg_monthly_change == pytest.approx((2750 - 2300) / 6) and "over the next 6 months" in row.explanation


def test_many_months_are_dealt_by_their_number(sales_of, monkeypatch):
    """A task's share of the series does not grow with the table, and the rows stay the same."""
    from salescope import session

    rng = np.random.default_rng(3)
    rows = [(m.isoformat(), "c", f"p{i}", "r", int(rng.integers(0, 50)), 0, 1.0, "paid") for i in range(40) for m in months(1 + i % 9, 2024)]
    sales = sales_of([*rows, ("2024-01-01", "c", None, "r", 5, 0, 1.0, "paid"), *rows[:30]])
    plain = forecast.product_forecasts(sales)
    monkeypatch.setattr(session, "LEFT_TO_SPARK", 10)
    monkeypatch.setattr(session, "ROWS_PER_TASK", 10)
    dealt = forecast.product_forecasts(sales)
    assert dealt.rdd.getNumPartitions() >= 18  # 196 months
    key = lambda r: (r.product, r.step or 0)
    assert sorted(dealt.collect(), key=key) == sorted(plain.collect(), key=key)
    trends = forecast.forecast_trends(dealt)
    assert trends.rdd.getNumPartitions() >= 18 and trends.count() == 40
