import pytest

from vocalith.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", 4, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
