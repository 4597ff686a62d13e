import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from skein.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", **{"spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    path = Path("/root/testdata/sf0.001")
    if not path.exists():
        pytest.skip("no test tables here")
    return str(path)
