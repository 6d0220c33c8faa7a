import pytest

from gradeframe.session import get_spark


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", 4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
