"""Every core query on empty, half-null, doubled and widened tables."""

import edge_tables
import pytest

from glyphmill.plans import registry

pytestmark = pytest.mark.skipif(not edge_tables.SOURCE.exists(), reason="no test tables")


@pytest.mark.parametrize("kind", ["empty", "null"])
def test_all_queries(spark, tmp_path, kind):
    at = edge_tables.write(spark, tmp_path, kind)
    failed = {}
    for name, f in registry.queries().items():
        try:
            df = f(spark, at)
            n = len(df.collect())
            assert not (kind == "empty" and n and name in ("segment_lines", "split_bands", "p5_found", "run_groups", "ocr_scored")), name
        except Exception as e:  # noqa: BLE001
            failed[name] = str(e)[:300]
    want = {"column_dir_roundtrip", "tar_roundtrip"}  # no columns and no shards are errors by definition
    assert set(failed) - want == set(), failed
