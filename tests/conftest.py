import pandas as pd
import pytest

from pricewell.plans.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("4", shuffle_partitions=4, name="tests")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session


@pytest.fixture(scope="session")
def make_panel(spark):
    """A panel from ``{(commodity, state): values}``, daily from 2020-01-01."""

    def make(series):
        parts = [
            pd.DataFrame({"commodity": c, "state": s, "y": [float(v) for v in values],
                          "date": pd.date_range("2020-01-01", periods=len(values)).date})
            for (c, s), values in series.items()
        ]
        return spark.createDataFrame(
            pd.concat(parts)[["commodity", "state", "date", "y"]],
            "commodity string, state string, date date, y double",
        )

    return make
