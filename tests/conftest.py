import os
import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")

import textrec  # noqa: E402
from textrec.session import local_session  # noqa: E402

cloudpickle.register_pickle_by_value(textrec)


@pytest.fixture(scope="module", autouse=True)
def functions_by_value(request):
    """Python workers do not import the test modules."""
    cloudpickle.register_pickle_by_value(request.module)
    yield
    cloudpickle.unregister_pickle_by_value(request.module)


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "4")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a table as a sorted list of tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
