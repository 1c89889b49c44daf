from __future__ import annotations

import pytest

from loupe.session import local


@pytest.fixture(scope="session")
def spark():
    s = local(8, 4)
    yield s
    s.stop()
