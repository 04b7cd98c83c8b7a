import pytest

from quernel.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    yield session


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SMALL
