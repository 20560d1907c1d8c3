import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark():
    from fieldledger.session import local_session
    session = local_session("tests", cores="4", shuffle_partitions=4, memory="4g")
    yield session
    session.stop()
