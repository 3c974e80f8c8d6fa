import datetime

import pytest

from salescope.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    yield session
    session.stop()


@pytest.fixture
def sales_of(spark):
    """Canonical sales from (date, customer, product, region, revenue, cost, quantity, status) tuples."""

    def make(rows):
        from decimal import Decimal

        typed = [
            (
                datetime.date.fromisoformat(d) if d else None, c, p, r,
                None if v is None else Decimal(str(v)), None if k is None else Decimal(str(k)), q, s,
            )
            for d, c, p, r, v, k, q, s in rows
        ]
        frame = spark.createDataFrame(
            typed,
            "date date, customer string, product string, region string, revenue decimal(18,2), cost decimal(18,2), "
            "quantity double, payment_status string",
        )
        return frame.selectExpr("*", "cast(revenue - cost as decimal(18,2)) AS profit")

    return make
