import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from docsift.session import local_session, ship

    session = local_session(4, 4, spark__driver__memory="6g")
    ship(session)
    yield session


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
