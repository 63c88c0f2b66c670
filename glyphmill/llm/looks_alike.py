"""Pairs of keys whose values look the same but are written differently.

Values meet by the 128-bit key of their consistent form (look.py). Only looks that occur in several
spellings stay (a min and max of the spelling's hashes, pre-aggregated), so the common case of one
spelling costs one small row. Keys of such looks are paired across spellings; AQE splits a look that
holds many keys.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.look import Speller, look_list_array
from glyphmill.llm.splits import look_key, looks
from glyphmill.tables import SharedTable


def list_looks(df: DataFrame, key: str, lists: str) -> DataFrame:
    """(key, look) of rows with a key and a non-empty list."""

    def run(batches):
        s = Speller()
        for b in batches:
            a = b.column(1)
            yield pa.RecordBatch.from_arrays([b.column(0), look_list_array(a, s), raw_list_array(a)], ["key", "look", "raw"])

    some = df.where(F.col(key).isNotNull() & (F.size(lists) > 0)).select(F.col(key).alias("key"), F.col(lists).alias("lists"))
    return some.mapInArrow(run, "key string, look string, raw string")


def raw_list_array(array: pa.ListArray) -> pa.Array:
    return pa.array([None if v is None else "\x1e".join("\x00" if x is None else "\x01" + x for x in v) for v in array.to_pylist()], pa.string())


def spelled(values: DataFrame) -> DataFrame:
    """(k1, k2, key, r1, r2), distinct: the keys of looks that occur in several spellings; ``values`` has key, look and
    raw. A key with several values takes part with each."""
    v = SharedTable(values.select("key", *look_key(), F.xxhash64("raw").alias("r1"), F.xxhash64(F.lit(7), "raw").alias("r2"))).df
    extremes = [f(r).alias(f"{n}{r}") for r in ("r1", "r2") for n, f in (("lo", F.min), ("hi", F.max))]
    several = v.groupBy("k1", "k2").agg(*extremes).where("lor1 <> hir1 or lor2 <> hir2").select("k1", "k2")
    return v.join(several, ["k1", "k2"]).distinct()


def pairs(values: DataFrame) -> DataFrame:
    """(key_a, key_b) of distinct keys with the same ``look`` and different ``raw``: the pairs of all classes, as many as
    they are. ``classes`` says the same in a row a key."""
    some = spelled(values)
    a = some.select("k1", "k2", F.col("key").alias("key_a"), F.struct("r1", "r2").alias("ra"))
    b = some.select("k1", "k2", F.col("key").alias("key_b"), F.struct("r1", "r2").alias("rb"))
    return a.join(b, ["k1", "k2"]).where("key_a < key_b and ra <> rb").select("key_a", "key_b").distinct()


def classes(values: DataFrame) -> DataFrame:
    """(key, class, n_keys, n_spellings): every key of a look that occurs in several spellings, with the look's smallest
    key, its keys and its spellings. Keys of a class are linked if their spellings differ."""
    some = spelled(values)
    # first by spelling, so that a look that very many keys share is reduced before its spellings meet
    each = some.groupBy("k1", "k2", "r1", "r2").agg(F.min("key").alias("least"))
    by = each.groupBy("k1", "k2").agg(F.min("least").alias("class"), F.count("*").alias("n_spellings"))
    keys = some.select("k1", "k2", "key").distinct()
    size = keys.groupBy("k1", "k2").agg(F.count("*").alias("n_keys"))
    return keys.join(by.join(size, ["k1", "k2"]), ["k1", "k2"]).select("key", "class", "n_keys", "n_spellings")


def text_values(df: DataFrame, stock: DataFrame, key: str, text: str) -> DataFrame:
    """(key, look, raw) of texts neither null, empty nor of a stock line's look."""
    d = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("raw"))
    return looks(d, stock, "raw").select("key", "look", "raw")
