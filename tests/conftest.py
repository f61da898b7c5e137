import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from corpuskiln.scratch import use_local_scratch  # noqa: E402
from corpuskiln.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    use_local_scratch(session)
    return session


@pytest.fixture
def stored_plans(monkeypatch):
    """The plans of all tables that are written while the test runs."""
    from pyspark.sql.readwriter import DataFrameWriter

    plans, write = [], DataFrameWriter.parquet

    def recorded(self, *args, **kwargs):
        plans.append(self._df._jdf.queryExecution().toString())
        return write(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", recorded)
    return plans
