import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from seqspark.session import local_session

    folder = tempfile.mkdtemp(prefix="spark-")
    session = local_session(4, 4, "4g", spark__sql__warehouse__dir=f"{folder}/wh", spark__local__dir=folder)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
