"""All core queries with their DuckDB SQL."""

from __future__ import annotations

from glyphmill.plans import archive, corpus, evaluation, vocabulary

MODULES = (archive, vocabulary, corpus, evaluation)
FLAGSHIP = "ocr_report"


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
