import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from marlstone import session

    s = session.local(4, 4, "3g", **{"spark.sql.shuffle.partitions": "4"})
    yield s
    s.stop()
