"""Filling sequences of a fixed token capacity with documents.

Method: cost-balanced packing. The cost of a document of n tokens is estimated as
``linear * n + quadratic * n * n`` (attention). Documents in descending order go each to the sequence
of lowest cost that still has room; if none has, a new sequence is opened. Documents longer than the
capacity are cut into full sequences of their own and one remainder that is packed like a document.
Packing runs in groups of a bounded number of documents (chosen by a hash of key, part and, for equal
rows, their number, so that every group has the mix of lengths of the whole and the result doesn't
depend on how the rows are partitioned), in parallel; a group starts with as many sequences as its tokens need.

Defined results: documents without tokens (null counts too) take no room; with ``empty`` they come last,
by the same rule, so they come out with a sequence and n_tokens 0, else they don't come out; repeated keys are packed as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: documents of a packing group, about
GROUP_DOCS = 20_000
#: equal rows are told apart in steps of so many
SPREAD = 10_000


def pack_group(lengths: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 4096) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each item, none longer than the capacity.

    ``open_`` is a heap by cost of the sequences with room for the current item. As items descend, a
    sequence without room waits in ``tight``, a heap by room, until an item is small enough for it; so
    the head of ``open_`` always fits, and each item costs a few heap steps."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    start = max(1, -(-int(lengths.sum()) // capacity))
    used, cost = [0] * start, [0.0] * start
    open_: list[tuple[float, int]] = [(0.0, s) for s in range(start)]
    tight: list[tuple[int, int]] = []
    for i in order.tolist():
        n = int(lengths[i])
        while tight and -tight[0][0] >= n:
            s = heapq.heappop(tight)[1]
            heapq.heappush(open_, (cost[s], s))
        if open_:
            s = heapq.heappop(open_)[1]
        else:
            s = len(used)
            used.append(0)
            cost.append(0.0)
        where[i], offset[i] = s, used[s]
        used[s] += n
        cost[s] += linear * n + quadratic * n * n
        room = capacity - used[s]
        if room >= n:
            heapq.heappush(open_, (cost[s], s))
        elif room:
            heapq.heappush(tight, (-room, s))
    return where, offset


def pack(sized: DataFrame, capacity: int, key: str = "doc_id", tokens: str = "n_tokens", linear: float = 1.0, quadratic: float = 1.0 / 4096, empty: bool = False) -> DataFrame:
    """(key, part, sequence, offset, n_tokens): where each part of each document lies. ``sequence`` is
    ``group:number``; ``part`` counts the parts of a document cut because it exceeds the capacity."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    kind = dict(sized.dtypes)[key]
    d = sized.select(F.col(key).alias("key"), F.coalesce(F.col(tokens).cast("bigint"), F.lit(0)).alias("n")).where("n >= 0" if empty else "n > 0")
    n_groups = max(1, -(-d.count() // GROUP_DOCS))
    cut = F.when(F.col("n") <= capacity, F.array(F.struct(F.lit(0).alias("part"), F.col("n").alias("n")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.ceil(F.col("n") / capacity).cast("int") - 1), lambda i: F.struct(i.alias("part"), F.least(F.lit(capacity).cast("bigint"), F.col("n") - i * F.lit(capacity).cast("bigint")).alias("n")))
    )
    parts = d.select("key", F.inline(cut))
    # groups depend on the rows' content only: on key, part and, of equal rows, the how manieth
    equal = parts.groupBy("key", "part", "n").count()
    thousands = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("count") - 1) / SPREAD))
    each = equal.withColumn("hi", F.explode(thousands)).withColumn("lo", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(SPREAD), F.col("count") - F.col("hi") * SPREAD) - 1)))
    parts = each.select("key", "part", "n", F.pmod(F.xxhash64("key", "part", F.col("hi") * SPREAD + F.col("lo")), F.lit(n_groups)).alias("grp"))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("n", "descending"), ("key", "ascending"), ("part", "ascending")])
        n = group.column("n").to_numpy()
        where, offset = pack_group(n, capacity, linear, quadratic)
        name = np.char.add(f"{group.column('grp')[0].as_py()}:", where.astype("U20"))
        return pa.table({"key": group.column("key"), "part": group.column("part"), "sequence": pa.array(name.tolist(), pa.string()), "offset": pa.array(offset), "n_tokens": group.column("n")})

    return parts.groupBy("grp").applyInArrow(run, f"key {kind}, part int, sequence string, offset bigint, n_tokens bigint").withColumnRenamed("key", key)


def packing_report(packed: DataFrame, capacity: int) -> DataFrame:
    """(sequences, tokens, fill, fewest_tokens, max_cost, mean_cost)."""
    n = F.col("n_tokens").cast("double")
    seq = packed.groupBy("sequence").agg(F.sum("n_tokens").alias("t"), F.sum(n + n * n / 4096).alias("c"))
    return seq.agg(F.count("*").alias("sequences"), F.sum("t").alias("tokens"), (F.sum("t") / (F.count("*") * F.lit(capacity))).alias("fill"), F.min("t").alias("fewest_tokens"), F.max("c").alias("max_cost"), F.avg("c").alias("mean_cost"))


def check(sized: DataFrame, packed: DataFrame, capacity: int, key: str = "doc_id", tokens: str = "n_tokens") -> DataFrame:
    """(n_documents, n_overfull, n_overlapping, n_cut, n_wrong): documents that came out; sequences beyond the
    capacity; parts that begin before their predecessor ends; documents cut though they fit; documents whose
    parts don't add up to their tokens."""
    seq = packed.groupBy("sequence").agg(F.sum("n_tokens").alias("t")).agg(F.count_if(F.col("t") > capacity).alias("n_overfull"))
    # a sequence holds few parts with tokens; empty ones can't overlap
    after = F.lead("offset").over(Window.partitionBy("sequence").orderBy("offset"))
    over = packed.where("n_tokens > 0").select((F.col("offset") + F.col("n_tokens")).alias("end"), after.alias("next")).agg(F.count_if(F.col("next") < F.col("end")).alias("n_overlapping"))
    parts = packed.groupBy(F.col(key).alias("k")).agg(F.sum("n_tokens").alias("got"), F.count("*").alias("parts"), F.count_if(F.col("part") == 0).alias("docs"))
    want = sized.groupBy(F.col(key).alias("w")).agg(F.sum(F.coalesce(F.col(tokens).cast("bigint"), F.lit(0))).alias("want"), F.max(tokens).alias("longest"))
    both = want.join(parts, F.col("w").eqNullSafe(F.col("k")), "full")
    docs = both.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n_documents"), F.count_if((F.coalesce("longest", F.lit(0)) <= capacity) & (F.col("parts") > F.col("docs"))).alias("n_cut"), F.count_if(~F.coalesce(F.col("want") == F.col("got"), F.lit(False))).alias("n_wrong"))
    return docs.join(seq).join(over).select("n_documents", "n_overfull", "n_overlapping", "n_cut", "n_wrong")  # one row each
