"""Operators over the sales table by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from salescope.operators import aggregates, anomalies, forecast, reports, timeseries

Operator = Callable[..., DataFrame]


def _over_total(operator: Operator) -> Operator:
    return lambda sales, **params: operator(forecast.total_series(sales), **params)


BUILT_IN: dict[str, Operator] = {
    "compute_kpis": aggregates.kpis,
    "revenue_by_customer": lambda sales: aggregates.revenue_by(sales, "customer"),
    "revenue_by_product": lambda sales: aggregates.revenue_by(sales, "product"),
    "revenue_by_region": lambda sales: aggregates.revenue_by(sales, "region"),
    "monthly_revenue": timeseries.monthly_revenue,
    "monthly_profit": timeseries.monthly_profit,
    "monthly_growth": timeseries.monthly_growth,
    "total_units_sold": aggregates.total_units,
    "revenue_per_unit": aggregates.revenue_per_unit,
    "revenue_by_payment_status": aggregates.revenue_by_payment_status,
    "detect_revenue_spikes": lambda sales, threshold_std=2, by_product=False: (
        anomalies.product_anomalies if by_product else anomalies.revenue_anomalies
    )(sales, threshold_std),
    "forecast_revenue": _over_total(forecast.revenue_forecast),
    "forecast_revenue_with_explanation": _over_total(forecast.explained_forecast),
    "forecast_with_confidence": _over_total(forecast.forecast_with_bounds),
    "forecast_ensemble": _over_total(forecast.ensemble_forecast),
    "detect_seasonality": anomalies.seasonality,
    "generate_summary": reports.summary_text,
    "monthly_revenue_by_customer": timeseries.monthly_revenue_by_customer,
    "monthly_revenue_by_product": timeseries.monthly_revenue_by_product,
    "monthly_revenue_by_product_full": timeseries.product_month_table,
    "forecast_revenue_by_product": forecast.product_forecasts,
}


class Registry:
    """Built-in operators plus any added by the user; registries do not share additions."""

    def __init__(self) -> None:
        self._operators = dict(BUILT_IN)

    def add(self, name: str, operator: Operator) -> None:
        self._operators[name] = operator

    def names(self) -> list[str]:
        return sorted(self._operators)

    def run(self, name: str, sales: DataFrame, **params) -> DataFrame:
        if name not in self._operators:
            raise ValueError(f"unknown operator: {name}")
        return self._operators[name](sales, **params)
