import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pulsegrid.session import checkpoint_dir, get_session
    s = get_session("local[4]", app="pulsegrid-tests", shuffle_partitions=4)
    checkpoint_dir(s)
    yield s
    s.stop()
