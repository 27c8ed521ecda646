import pytest

from loomgrid.session import get_session


@pytest.fixture(scope="session")
def spark():
    return get_session("tests", cores=4, memory="4g")
