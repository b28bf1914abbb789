from __future__ import annotations

import os

import pytest

from tests.session import local_session

FOLDER = os.environ.get("TRIPLENS_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return local_session()


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(FOLDER):
        pytest.skip(f"no test data in {FOLDER}")
    return FOLDER


@pytest.fixture(scope="session")
def trips(spark, folder):
    from triplens.sources.derived import trips

    return trips(spark, folder)
