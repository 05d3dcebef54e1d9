import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from faultline.session import local_session  # noqa: E402
from helpers import FOUR, feature_rows, log_frame, storm_rows  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "faultline-tests", "6g")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def four(spark):
    return log_frame(spark, FOUR)


@pytest.fixture(scope="session")
def storm(spark):
    """(lines, incidents, cases) of the 433-line log at one-minute windows."""
    from faultline.operators import clean, features, incidents
    from faultline.plans import investigate
    from faultline.sources.materialize import materialize

    raw = log_frame(spark, storm_rows())
    lines = materialize(clean.preprocess_logs(raw, "1min"), "t-lines")
    inc = materialize(incidents.number_incidents(features.create_features(lines)), "t-inc")
    cases = materialize(investigate.collect_cases(lines, inc), "t-cases")
    return lines, inc, cases


@pytest.fixture(scope="session")
def trained(spark):
    from faultline.operators import forest
    rows, ddl = feature_rows()
    table = spark.createDataFrame(rows, ddl)
    return forest.train(table), table
