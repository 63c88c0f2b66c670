"""Occurrences and records of every distinct term.

Method: a first pass collects the distinct terms and numbers them without gaps: the global integer
dictionary, a table (id, term). A second pass encodes every record by it and accumulates, block by block, two
arrays over identifiers: occurrences and records. The arrays are cut into ranges of ``RANGE``
identifiers; those of a range meet in one task, where they are summed. Only numbers are shuffled in the
second pass, one array piece for each task and range, so neither a frequent term nor a huge vocabulary
needs memory in proportion. Terms are joined to the sums by identifier at the end.

Tasks hold the dictionary as long as it has at most ``HELD_TERMS`` terms of ``HELD_BYTES`` in all.
Beyond that, blocks are counted by a 128-bit hash of the terms, and the hash is exchanged for the identifier
by a join with the dictionary; the rest is the same.

Defined results: null records hold no terms; a term's case, accents and forms are kept as they stand.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.order import enumerated
from glyphmill.tables import SharedTable, shuffle_partitions

#: identifiers of a range
RANGE = 1 << 14
#: a block ends at this many distinct terms or characters read
BLOCK_TERMS, BLOCK_CHARS = 500_000, 32_000_000
#: a dictionary that tasks may hold
HELD_TERMS, HELD_BYTES = 1_000_000, 32 << 20
_WORD = re.compile(r"[^ \t\n\r]+")
_PIECE = "range bigint, ids array<bigint>, occurrences array<bigint>, records array<bigint>"


def _encode(unit: str, array: pa.Array, code) -> tuple[np.ndarray, np.ndarray]:
    """(code, record) of every term of a batch; ``code`` maps a term to its number."""
    texts = [t for t in array.to_pylist() if t]
    if unit == "word":
        rows = [_WORD.findall(t) for t in texts]
        codes = np.array([code(w) for r in rows for w in r], np.int64)
        return codes, np.repeat(np.arange(len(rows)), np.fromiter(map(len, rows), np.int64, len(rows)))
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    distinct, inverse = np.unique(points, return_inverse=True)
    codes = np.array([code(chr(c)) for c in distinct.tolist()], np.int64)
    return codes[inverse] if len(codes) else inverse, np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))


class _Counts:
    """Two arrays over identifiers: occurrences and records."""

    def __init__(self, size: int = 1024):
        self.counts = np.zeros((2, size), np.int64)

    def add(self, codes: np.ndarray, rows: np.ndarray) -> None:
        if not len(codes):
            return
        n = int(codes.max()) + 1
        if n > self.counts.shape[1]:
            self.counts = np.pad(self.counts, ((0, 0), (0, max(n, 2 * self.counts.shape[1]) - self.counts.shape[1])))
        self.counts[0, :n] += np.bincount(codes, minlength=n)
        # each term once a record
        self.counts[1, :n] += np.bincount(np.unique(rows * n + codes) % n, minlength=n)


def _terms(unit: str):
    """Distinct terms of each block."""

    def run(batches):
        seen: dict[str, None] = {}
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(dict.fromkeys(_WORD.findall(t) if unit == "word" else t))
            if len(seen) >= BLOCK_TERMS:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], ["term"])
                seen = {}
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], ["term"])

    return run


def _pieces(counts: np.ndarray) -> pa.RecordBatch:
    """The arrays cut into ranges, untouched identifiers and ranges left out."""
    ids = np.flatnonzero(counts[0])
    ranges, starts = np.unique(ids // RANGE, return_index=True)
    offsets = pa.array(np.append(starts, len(ids)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(ranges), *[pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (ids, counts[0, ids], counts[1, ids])]], ["range", "ids", "occurrences", "records"])


def _count_held(unit: str, held):
    """Counts by a dictionary that the task holds."""

    def run(batches):
        number = dict(zip(held.value.column("term").to_pylist(), held.value.column("id").to_pylist()))
        c = _Counts(len(number))
        for b in batches:
            c.add(*_encode(unit, b.column(0), number.__getitem__))
        yield _pieces(c.counts)

    return run


def _count_blocks(unit: str):
    """Counts of each block by its own numbers, with the terms."""

    def run(batches):
        def out():
            n = len(codes)
            return pa.RecordBatch.from_arrays([pa.array(list(codes), pa.string()), pa.array(c.counts[0, :n]), pa.array(c.counts[1, :n])], ["term", "occurrences", "records"])

        codes: dict[str, int] = {}
        c, chars = _Counts(), 0
        for b in batches:
            c.add(*_encode(unit, b.column(0), lambda w: codes.setdefault(w, len(codes))))
            chars += b.nbytes
            if len(codes) >= BLOCK_TERMS or chars >= BLOCK_CHARS:
                yield out()
                codes.clear()
                c, chars = _Counts(), 0
        if codes:
            yield out()

    return run


def _sum_ranges(batches):
    """Sums the array pieces of each range; the input is sorted by range."""

    def out():
        ids = np.flatnonzero(total[0])
        return pa.RecordBatch.from_arrays([pa.array(ids + now * RANGE), pa.array(total[0, ids]), pa.array(total[1, ids])], ["id", "occurrences", "records"])

    now, total = None, np.zeros((2, RANGE), np.int64)
    for b in batches:
        at = np.concatenate([[0], np.cumsum(b.column(1).value_lengths().to_numpy(zero_copy_only=False))]) if b.num_rows else [0]
        ids, occurrences, records = (b.column(i).flatten().to_numpy() for i in (1, 2, 3))
        for i, r in enumerate(b.column(0).to_pylist()):
            if r != now:
                if now is not None:
                    yield out()
                now, total = r, np.zeros((2, RANGE), np.int64)
            s = slice(at[i], at[i + 1])
            np.add.at(total[0], ids[s] - r * RANGE, occurrences[s])
            np.add.at(total[1], ids[s] - r * RANGE, records[s])
    if now is not None:
        yield out()


def _hashes() -> list[Column]:
    return [F.xxhash64("term").alias("h1"), F.xxhash64(F.lit(7), "term").alias("h2")]


def frequencies(df: DataFrame, text: str | Column, unit: str) -> DataFrame:
    """(id, term, occurrences, records) of every distinct term of a text column.

    ``unit``: ``character`` (code points) or ``word`` (longest runs without space, tab, line feed or
    carriage return). An empty table gives no rows."""
    if unit not in ("character", "word"):
        raise ValueError(f"unknown unit: {unit}")
    text = df[text] if isinstance(text, str) else text
    spark = df.sparkSession
    texts = df.select(text.alias("text")).where(F.col("text").isNotNull() & (F.col("text") != ""))
    dictionary = enumerated(texts.mapInArrow(_terms(unit), "term string").distinct(), "id")
    size = dictionary.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    if size[0] <= HELD_TERMS and size[1] <= HELD_BYTES:
        pieces = texts.mapInArrow(_count_held(unit, spark.sparkContext.broadcast(dictionary.toArrow())), _PIECE)
    else:
        blocks = texts.mapInArrow(_count_blocks(unit), "term string, occurrences bigint, records bigint").select(*_hashes(), "occurrences", "records")
        coded = blocks.join(dictionary.select(*_hashes(), "id"), ["h1", "h2"])
        pieces = coded.select(F.floor(F.col("id") / RANGE).alias("range"), *[F.array(c).alias(n) for c, n in (("id", "ids"), ("occurrences", "occurrences"), ("records", "records"))])
    summed = pieces.repartition(shuffle_partitions(spark), "range").sortWithinPartitions("range").mapInArrow(_sum_ranges, "id bigint, occurrences bigint, records bigint")
    return summed.join(dictionary, "id").select("id", "term", "occurrences", "records")


def mark_terms(freq: DataFrame, n_rows: int, rare_below: int, common_above: float) -> DataFrame:
    """Adds marks: ``rare`` with fewer than ``rare_below`` occurrences in all, ``common`` in more than
    the share ``common_above`` of ``n_rows`` records. One row a mark (in tiny tables a term can be
    both); terms without a mark keep one row with mark null."""
    rare = F.when(F.col("occurrences") < rare_below, F.lit("rare"))
    common = F.when(F.col("records") > F.lit(float(common_above)) * F.lit(n_rows), F.lit("common"))
    marks = F.filter(F.array(rare, common), lambda m: m.isNotNull())
    return freq.withColumn("mark", F.explode_outer(marks))
