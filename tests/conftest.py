import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from vitrine.session import local_session

    session = local_session("4", "4g")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


@pytest.fixture
def tx(spark):
    """Build transactions from (customer, article, day offset, price) tuples."""

    def build(rows):
        base = dt.date(2020, 1, 1)
        data = [
            (c, a, base + dt.timedelta(days=d), float(p), f"{i:06d}")
            for i, (c, a, d, p) in enumerate(rows)
        ]
        return spark.createDataFrame(
            data, "customer_id string, article_id string, t_dat date, price double, txn_id string"
        )

    return build
