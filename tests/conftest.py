import pytest

from emberlens.session import get_session


@pytest.fixture(scope="session")
def spark():
    return get_session("tests", 8)
