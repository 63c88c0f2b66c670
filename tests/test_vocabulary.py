import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import alphabet as A


def counts(spark, d):
    return spark.createDataFrame(list(d.items()), "ch string, n bigint")


@pytest.mark.parametrize("least", [1, 7, 1000])
def test_ids_follow_code_points(spark, least):
    """Any counts: characters that occur often enough, in code point order, whatever the order of rows."""
    rng = random.Random(least)
    d = {chr(rng.choice([0x1820, 0x41, 0x4E00, 0x1F680]) + i): rng.randint(1, 20) for i in range(60)}
    want = sorted(ch for ch, n in d.items() if n >= least)
    a = A.Alphabet.from_counts(counts(spark, d), least)
    assert list(a.chars) == want and (a.blank, a.n_classes) == (len(want), len(want) + 1)
    kept = counts(spark, {ch: d[ch] for ch in want} or {"-": 0}).where("n > 0")
    assert [tuple(r) for r in A.ids(kept.repartition(3)).orderBy("id").collect()] == list(zip(want, range(len(want))))
    if want:
        assert A.sha(kept).first()["sha256"] == a.sha256 == hashlib.sha256("".join(want).encode()).hexdigest()


def test_too_many_characters(spark):
    with pytest.raises(ValueError):
        A.Alphabet.from_counts(spark.range(A.MAX_CHARS + 1).selectExpr("cast(id as string) as ch", "1L as n"))
    # the largest vocabulary still encodes
    a = A.Alphabet(tuple(map(chr, [*range(0x100, 0xD800), *range(0xE000, 0x2B900)]))[: A.MAX_CHARS])
    assert len(a.chars) == A.MAX_CHARS and ord(chr(0xF0000 + A.MAX_CHARS - 1)) <= 0x10FFFF


def test_cover_encode_decode(spark):
    a = A.Alphabet(("\n", "]", "a", "b", "c", "\U0001f60a"))
    df = spark.createDataFrame([("abc",), ("abz",), ("",), (None,), ("\n]\U0001f60a",), ("abc\n",)], "t string")
    rows = df.select("t", a.covers(F.col("t")).alias("c"), a.encode(F.col("t")).alias("e"), a.decode(a.encode(F.col("t"))).alias("d")).collect()
    by = {r["t"]: r for r in rows}
    assert by["abc"]["c"] and not by["abz"]["c"] and by[""]["c"] and by[None]["c"] is None and by["abc\n"]["c"]
    assert by["abz"]["e"] == [2, 3] and by["\n]\U0001f60a"]["e"] == [0, 1, 5] and by[""]["e"] == [] and by[None]["e"] is None
    assert by["abz"]["d"] == "ab" and by["\n]\U0001f60a"]["d"] == "\n]\U0001f60a"
    empty = A.Alphabet(())
    assert [tuple(r) for r in df.select(empty.covers(F.col("t")), empty.encode(F.col("t"))).collect()][2] == (True, [])


def test_files(spark, tmp_path):
    a, at = A.Alphabet(("a", "b")), str(tmp_path / "alphabet.json")
    a.save(at, "here", 3, 9, 1)
    assert A.Alphabet.load(at) == a
    d = json.loads((tmp_path / "alphabet.json").read_text())
    assert not any("count" in k and k != "min_count" for k in d)
    d["chars"] = ["a", "z"]
    (tmp_path / "bad.json").write_text(json.dumps(d))
    with pytest.raises(ValueError):
        A.Alphabet.load(str(tmp_path / "bad.json"))
    with pytest.raises(ValueError):
        a.require_same(A.Alphabet(("a",)))
    c = counts(spark, {"b": 2, "a": 2, "ᠠ": 5})
    A.save_counts(c, str(tmp_path / "counts.json"))
    assert list(json.loads((tmp_path / "counts.json").read_text()))[0] == "U+1820"
    assert {tuple(r) for r in A.load_counts(spark, str(tmp_path / "counts.json")).collect()} == {("b", 2), ("a", 2), ("ᠠ", 5)}


def test_histogram_and_curation(spark):
    df = spark.createDataFrame([("ab",), ("bc",), ("",), (None,)], "text string")
    h = A.histogram(df)
    assert {tuple(r) for r in h.collect()} == {("a", 1), ("b", 2), ("c", 1)}
    assert A.curation(h, 2).first().asDict() == {"kept": 1, "dropped": 2, "dropped_occurrences": 2, "code_points": 4}
    assert [r["ch"] for r in A.dropped_top(h, 2).collect()] == ["a", "c"]
    assert A.curation(A.histogram(df.where("false")), 2).first()["code_points"] == 0
