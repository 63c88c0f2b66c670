import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import frequency, splits
from glyphmill.llm.look import consistent

TEXTS = ["a b a", "b\tb\nc", "", None, "  ", "x" * 5000 + " a", "  a b \U0001f338", "a b a", "\x0b"]


@pytest.mark.parametrize("held", [True, False])
@pytest.mark.parametrize("unit", ["word", "character"])
def test_against_counters(spark, monkeypatch, unit, held):
    if not held:  # a dictionary too large for the tasks, small blocks and ranges
        monkeypatch.setattr(frequency, "HELD_TERMS", 0)
        monkeypatch.setattr(frequency, "BLOCK_TERMS", 20)
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice(["hot", "cold", f"w{rng.randint(0, 99)}"]) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    df = spark.createDataFrame([(t, 1, 2) for t in texts], "text string, term int, id int").repartition(7)
    occ, rec = Counter(), Counter()
    for t in texts:
        terms = re.findall(r"[^ \t\n\r]+", t or "") if unit == "word" else list(t or "")
        occ.update(terms)
        rec.update(set(terms))
    got = frequency.frequencies(df, "text", unit).collect()
    assert {r["term"]: (r["occurrences"], r["records"]) for r in got} == {t: (occ[t], rec[t]) for t in occ} and len(got) == len(occ)
    assert sorted(r["id"] for r in got) == list(range(len(got)))


def test_pieces_by_range():
    c = frequency._Counts(4)
    c.add(np.array([1, 1, 20_000]), np.array([0, 0, 1]))
    b = frequency._pieces(c.counts)
    assert b.to_pydict() == {"range": [0, 1], "ids": [[1], [20_000]], "occurrences": [[2], [1]], "records": [[1], [1]]}
    summed = pa.Table.from_batches(frequency._sum_ranges(iter([b.slice(0, 1), b.slice(0, 1), b.slice(1, 1)]))).to_pydict()
    assert summed == {"id": [1, 20_000], "occurrences": [4, 1], "records": [2, 1]}


def test_marks(spark):
    f = spark.createDataFrame([(0, "a", 1, 1), (1, "b", 9, 2), (2, "c", 50, 3)], "id bigint, term string, occurrences bigint, records bigint")
    got = {(r["term"], r["mark"]) for r in frequency.mark_terms(f, 4, 9, 0.5).collect()}
    assert got == {("a", "rare"), ("b", None), ("c", "common")}
    both = {(r["term"], r["mark"]) for r in frequency.mark_terms(f, 1, 2, 0.5).collect()}
    assert ("a", "rare") in both and ("a", "common") in both
    empty = frequency.frequencies(spark.createDataFrame([], "text string"), "text", "word")
    assert empty.count() == 0
    with pytest.raises(ValueError):
        frequency.frequencies(f, "term", "line")


def brute_groups(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(1000 + rng.randint(0, 80), 1000 + rng.randint(0, 80)) for _ in range(60)] + [(5, 5), (7, 6), (6, 7)] + [(3000, 3000 + i) for i in range(1, 200)]
    df = spark.createDataFrame([*links, (None, 4), (9, None)], "src bigint, dst bigint")
    got = {r["node"]: r["component"] for r in splits.components(df).collect()}
    assert got == brute_groups(links)
    assert splits.components(df.where("false")).count() == 0


def meta(spark, n=600):
    rng = random.Random(3)
    rows = [(f"line_{i:08d}_v0", "Ｈead" if i % 9 == 0 else rng.choice(["Box", "Вох"]) + str(rng.randint(0, 4000)), rng.choice([77, *range(200)]) if i % 3 else 77, "s", 1) for i in range(n)]
    rows += [(None, "Box1", None, "s", 1), ("x", None, None, "s", 1), ("y", "", 5, "s", 1), ("z", "", 6, "s", 1), ("z", "", 6, "s", 1), ("n", None, 7, "s", 1)]
    return spark.createDataFrame(rows, "doc_id string, text string, src_doc bigint, split string, unit int"), spark.createDataFrame([(1, "Head")], "stock_id int, text string"), rows


def test_related_works_by_brute_force(spark):
    df, stock, rows = meta(spark)
    held = {}
    for _, t, s, *_ in rows:
        if t and s is not None and consistent(t) != "Head":
            held.setdefault(consistent(t), set()).add(s)
    want = brute_groups([(a, min(v)) for v in held.values() for a in v if len(v) > 1])
    got = {r["node"]: r["component"] for r in splits.components(splits.shared_text_edges(df, stock)).collect()}
    assert got == want and 5 not in {k for k, v in want.items() if v == 6}


def test_splits_keep_groups_and_shares(spark):
    df, stock, rows = meta(spark, 6000)
    got = splits.assign_splits(df, stock, {"train": 0.6, "val": 0.2, "test": 0.2}).select("doc_id", "src_doc", "text", "unit", "split").collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["unit"], set()).add(r["split"])
        assert r["split"] in ("train", "val", "test")
    assert all(len(v) == 1 for v in by.values())
    works = {}
    for r in got:
        if r["src_doc"] is not None:
            works.setdefault(r["src_doc"], set()).add(r["split"])
    assert all(len(v) == 1 for v in works.values())
    again = splits.assign_splits(df.repartition(3), stock, {"train": 0.6, "val": 0.2, "test": 0.2}).select("doc_id", "src_doc", "text", "unit", "split").collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    with pytest.raises(ValueError):
        splits.assign_splits(df, stock, {"train": 0.6, "val": 0.1})
    assert splits.assign_splits(df.where("false"), stock, {"train": 0.5, "val": 0.5}).count() == 0


def test_shares_and_stability(spark):
    """Without a unit that outweighs the others the shares hold; rows that are added move no unit, and the
    report says how far a heavy unit takes the shares."""
    shares = {"train": 0.5, "val": 0.25, "test": 0.25}
    empty = spark.createDataFrame([], "text string")
    df = spark.range(20_000).select(F.format_string("d%d", "id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), (F.col("id") % 4000).alias("src_doc"))
    few = splits.assign_splits(df, empty, shares)
    for r in splits.shares_of(few, shares).collect():
        assert abs(r["share"] - r["target"]) < 0.02 and r["largest_unit"] < 0.001
    heavy = spark.range(9_000).select(F.format_string("h%d", "id").alias("doc_id"), F.concat(F.lit("h"), "id").alias("text"), F.lit(7777).cast("bigint").alias("src_doc"))
    more = splits.assign_splits(df.unionAll(heavy), empty, shares)
    one, two = ({(r["unit"], r["split"]) for r in x.select("unit", "split").distinct().collect()} for x in (few, more))
    assert two - one == {x for x in two if x[0] == "work:7777"} and one < two
    got = {r["split"]: r for r in splits.shares_of(more, shares).collect()}
    assert max(r["largest_unit"] for r in got.values()) == pytest.approx(9_000 / 29_000) and sum(r["n_rows"] for r in got.values()) == 29_000
    assert {r["kind"]: r["n_torn"] for r in splits.unit_report(more).collect()} == {"work": 0}
    assert {r["n_rows"] for r in splits.shares_of(few.where("false"), shares).collect()} == {0}
