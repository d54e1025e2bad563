import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from panelwright.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="panelwright-test-")
    session = build_session("tests", 4, **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": folder,
                                           "spark.sql.warehouse.dir": f"{folder}/warehouse"})
    yield session
    session.stop()


def rows(df, *columns):
    """Sorted tuples of the named columns (all if none is given)."""
    out = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(out, key=lambda r: tuple((v is None, v) for v in r))
