import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from discourse_spark.session import local_session

    session = local_session(8, memory="8g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def facts(spark):
    from discourse_spark.plans import corpus

    return corpus.facts(spark, SF)


@pytest.fixture(scope="session")
def calendar(spark):
    from discourse_spark.plans import corpus

    return corpus.calendar(spark)
