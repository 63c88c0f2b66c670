"""Every query for training data on empty, half-null, doubled and widened tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import edge_tables  # noqa: E402

from glyphmill.llm import queries  # noqa: E402

pytestmark = pytest.mark.skipif(not edge_tables.SOURCE.exists(), reason="no test tables")


@pytest.mark.parametrize("kind", ["empty", "null", "double"])
def test_all_queries(spark, tmp_path, kind):
    at = edge_tables.write(spark, tmp_path, kind)
    failed, rows = {}, {}
    for name, f in queries.QUERIES.items():
        try:
            rows[name] = f(spark, at).collect()
        except Exception as e:  # noqa: BLE001
            failed[name] = str(e)[:300]
    assert not failed, failed
    if kind == "empty":
        assert not any(rows[n] for n in rows if n.endswith("_found"))
    if kind == "double":
        once = {n: queries.QUERIES[n](spark, str(edge_tables.SOURCE)).collect() for n in ("p2_found", "p3_found", "p4_found")}
        assert all(set(map(tuple, once[n])) == set(map(tuple, rows[n])) for n in once)
