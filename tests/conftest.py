import pytest

from eigenloom.session import local_session, ship_package


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, **{"spark.driver.memory": "4g"})
    ship_package(session)
    yield session
    session.stop()
