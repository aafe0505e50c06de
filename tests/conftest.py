import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).absolute().parent.parent))

from corvid.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session("tests", cpus="4", **{"spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("wh"))})
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()
