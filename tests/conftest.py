import pytest

from cartograph.local import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("8", "6g")
