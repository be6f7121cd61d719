import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from kgloom.session import local_session, ship

    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    s = local_session(4, 2, "4g")
    # many small plans: compiling each costs more than it saves
    s.conf.set("spark.sql.codegen.wholeStage", "false")
    s.conf.set("spark.sql.adaptive.enabled", "false")
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def rows():
    return lambda df: sorted((tuple(r) for r in df.collect()), key=str)
