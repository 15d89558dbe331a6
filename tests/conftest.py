from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))



@pytest.fixture(scope="session")
def spark():
    from mailtriage.session import build_session
    s = build_session(master="local[*]", shuffle_partitions=8)
    yield s


@pytest.fixture(scope="session")
def duck():
    from oracle_check import duck_connect
    from paths import SF_SMALL
    return duck_connect(SF_SMALL)
