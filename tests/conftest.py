import pytest

from tallyforge.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session
