import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from plumbline.session import build_session  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        spark_sql_shuffle_partitions=4,
        spark_ui_enabled="false",
        spark_driver_memory="6g",
        spark_checkpoint_dir=tempfile.mkdtemp(prefix="plumbline-tests-"),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
