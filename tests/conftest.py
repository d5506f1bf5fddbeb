import pytest

from fathomset.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session(4, shuffle_partitions=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
