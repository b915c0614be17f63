import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from fleetveil.session import local_session  # noqa: E402
from fleetveil.plans.reporting import reporting_tables  # noqa: E402
from fleetveil.sources.bindings import telemetry_sources  # noqa: E402

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def sources(spark):
    return telemetry_sources(spark, FOLDER)


@pytest.fixture(scope="session")
def tables(sources):
    return reporting_tables(sources)
