import pytest

from fleetlens.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g", spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")), spark__cleaner__referenceTracking__cleanCheckpoints="true",
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
