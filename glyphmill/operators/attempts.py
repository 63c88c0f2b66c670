"""Work that may fail on single items: each is tried again a few times, then dropped, and never fails the job."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def attempted(df: DataFrame, column: str, kernel: Callable, kind: str, tries: int = 3) -> DataFrame:
    """``df`` with ``result`` (of DDL type ``kind``), ``status``, ``tries`` and ``error``. ``kernel(value, attempt)`` is called for each
    row, with attempts from 1 on: ``ok`` if it returns a value, ``empty`` if it returns None, ``dropped`` if it raises
    in every attempt (``error`` is the last). Retries happen in the task, item by item."""
    if tries < 1:
        raise ValueError("an attempt at least")
    out = T.StructType.fromDDL(f"result {kind}, status string, tries int, error string")

    def once(value):
        error = None
        for n in range(1, tries + 1):
            try:
                got = kernel(value, n)
                return got, "ok" if got is not None else "empty", n, None
            except Exception as e:  # noqa: BLE001
                error = f"{type(e).__name__}: {e}"
        return None, "dropped", tries, error

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in out.fields]
        for b in batches:
            got = [once(v) for v in b.column(b.schema.get_field_index(column)).to_pylist()]
            new = [pa.array(c, k) for c, k in zip(zip(*got) if got else [[]] * 4, kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *out.names])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *out.fields]))
