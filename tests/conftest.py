import os
import sys

import pytest
from build import SMALL

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sentrygrain.contracts import EVENT_SCHEMA  # noqa: E402
from sentrygrain.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, memory="6g", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def pipeline(spark):
    from sentrygrain.plans.pipeline import Pipeline

    return Pipeline.of(spark, SMALL)


@pytest.fixture(scope="session")
def make_events(spark):
    def make(rows):
        names = EVENT_SCHEMA.fieldNames()
        return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], EVENT_SCHEMA)

    return make
