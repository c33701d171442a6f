import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shopfloor.session import local_session  # noqa: E402
from shopfloor.sources.workshop_csv import read_workshop_csv  # noqa: E402

FIXTURES = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures")


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", shuffle_partitions=8, app="shopfloor-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def roles_a(spark):
    return read_workshop_csv(spark, os.path.join(FIXTURES, "edition_a"))


@pytest.fixture(scope="session")
def roles_b(spark):
    return read_workshop_csv(spark, os.path.join(FIXTURES, "edition_b"))
