"""Tables for edge tests: empty ones, and ones whose every second value is null."""

from pathlib import Path

from pyspark.sql import functions as F

SOURCE = Path("/root/testdata/sf0.001")


def write(spark, to, kind: str) -> str:
    """Writes all tables in one of the forms ``empty``, ``null`` (each column null in every second row,
    the columns by turns, and clashing columns added) and ``double`` (every row twice)."""
    for f in sorted(SOURCE.glob("*.parquet")):
        df = spark.read.parquet(str(f))
        if kind == "empty":
            df = df.where("false")
        elif kind == "null":
            n = F.pmod(F.hash(*df.columns), F.lit(2 * len(df.columns)))
            df = df.select(*[F.when(F.pmod(n + i, F.lit(2)) == 0, F.col(c)).alias(c) for i, c in enumerate(df.columns)])
        elif kind == "double":
            df = df.unionAll(df)
        if kind == "null":
            taken = set(df.columns)
            for c in ("key", "look", "raw", "k1", "unit", "split", "node", "component", "term", "h", "side", "words", "pos", "run", "n", "ch", "bytes", "path", "ids", "chunk", "grp", "class"):
                if c not in taken:
                    df = df.withColumn(c, F.lit("x"))
        df.coalesce(1).write.parquet(f"{to}/{f.name}")
    return str(to)
