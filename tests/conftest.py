import pytest

from corpusloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", 2)
    s.conf.set("spark.sql.session.timeZone", "UTC")
    return s
