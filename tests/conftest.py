import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark():
    from quillmesh.session import build_session

    session = build_session(
        "local[4]", spark__sql__shuffle__partitions="2", spark__driver__memory="4g", spark__ui__showConsoleProgress="false",
        spark__sql__codegen__wholeStage="false", spark__sql__codegen__factoryMode="NO_CODEGEN",  # tiny inputs: compiling would take most of the time
    )
    yield session
    session.stop()
