import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"

@pytest.fixture(scope="session")
def spark():
    from carelens.session import clear_scratch, get_spark
    s = get_spark(app="carelens-tests", cores="*", shuffle_partitions=8)
    yield s
    clear_scratch(s)
    s.stop()


def data_file(name):
    """Path of one of the repository's own hand-made files."""
    return os.path.join(ROOT, "tests", "data", name)
