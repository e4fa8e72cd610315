import pathlib
import sys
import tempfile

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from checks.compare import local_session
    from optionlake import deploy

    session = local_session("8")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield deploy.prepare(session)
    session.stop()


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="spark-")
