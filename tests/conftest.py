import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from weftline.session import local_session
    session = local_session(4, "weftline-tests")
    session.sparkContext.setLogLevel("ERROR")
    return session
