import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from seqloom.session import importable_on_workers, local_session

    session = local_session(4, "seqloom-tests", "4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    importable_on_workers(session)
    yield session
    session.stop()
