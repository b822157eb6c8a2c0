import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lockstep.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "lockstep-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def weekdays():
    def make(start, count):
        day, out = start, []
        while len(out) < count:
            if day.weekday() < 5:
                out.append(day)
            day += dt.timedelta(days=1)
        return out
    return make
