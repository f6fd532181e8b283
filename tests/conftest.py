from __future__ import annotations

import pytest

from lexidrift.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = build_session(
        "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g", spark__sql__warehouse__dir=str(base / "warehouse"), spark__checkpoint__dir=f"file://{base}/checkpoints",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
