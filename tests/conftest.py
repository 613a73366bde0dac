import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hirescope.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    warehouse = tempfile.mkdtemp(prefix="hs-warehouse-")
    s = local_session("*", app="hirescope-tests", **{"spark.sql.warehouse.dir": warehouse})
    yield s
    s.stop()
