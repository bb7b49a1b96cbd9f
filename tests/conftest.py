import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from wardwatch.session import local_session

    return local_session(8, memory="6g", shared=str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def tables(spark):
    from catalog.base import Tables

    return Tables(spark, "/root/testdata/sf0.001")
