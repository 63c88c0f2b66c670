import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import bpe, packing

PIECES = ["a", "b", " ", "  ", "'s", "\n", "\t", "\x1c", "\x85", " ", "᠎", "᠋", "ᠠᠡ", "ᠰᠥᠷᠯᠦ", "12", "Ө", "ё", "é", "<|endoftext|>", "the", " The", "eeeee", "...", "--", "\U0001f338", "　", "\xa0", "²", "𐍈"]


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def texts(n):
    rng = random.Random(7)
    return ["", None, " ", "a" * 20_000, "ab" * 9_999, " x" * 5000] + ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_against_the_public_library(reference):
    e, t = bpe.Encoder(bpe.Merges(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.json")), texts(3000)
    assert e.encode(t).to_pylist() == reference(t)
    assert e.lengths(t).tolist() == [len(x) for x in reference(t)]


def test_memory_of_pieces_is_bounded(reference, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_PIECES", 5)
    e = bpe.Encoder(bpe.Merges(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.json"))
    for t in (texts(30), texts(50)):
        assert e.encode(t).to_pylist() == reference(t)


def test_frame(spark, reference):
    t = texts(50)
    df = spark.createDataFrame([(i, x, 5, "k") for i, x in enumerate(t)], "doc_id bigint, text string, ids int, key string")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(df).collect()}
    assert [got[i] for i in range(len(t))] == reference(t) and got[0] == [] and got[1] == []
    n = {r["doc_id"]: r["n_tokens"] for r in bpe.token_counts(df).collect()}
    assert n == {i: len(x) for i, x in got.items()}
    assert bpe.encode(df.where("false")).count() == 0


def brute_pack(lengths, capacity, linear=1.0, quadratic=1 / 4096):
    start = max(1, -(-sum(lengths) // capacity))
    used, cost, where = [0] * start, [0.0] * start, [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        able = [(cost[s], s) for s in range(len(used)) if used[s] + lengths[i] <= capacity]
        if not able:
            used.append(0)
            cost.append(0.0)
            able = [(0.0, len(used) - 1)]
        s = min(able)[1]
        where[i] = s
        used[s] += lengths[i]
        cost[s] += linear * lengths[i] + quadratic * lengths[i] * lengths[i]
    return where


def test_pack_group_is_the_rule():
    rng = random.Random(8)
    for _ in range(60):
        n = [rng.randint(1, 50) for _ in range(rng.randint(0, 80))]
        where, _ = packing.pack_group(np.array(n, np.int64), 60)
        assert where.tolist() == brute_pack(n, 60)


def check(rows, capacity):
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence"], []).append((r["offset"], r["n_tokens"]))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return sum(r["n_tokens"] for r in rows) / (len(seqs) * capacity)


@pytest.mark.parametrize("group", [100, 20_000])
def test_pack(spark, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP_DOCS", group)
    rng = random.Random(9)
    rows = [(i, rng.randint(1, 300), "s", 0) for i in range(1000)] + [(5000, 2500, "s", 0), (5001, 0, "s", 0), (5002, None, "s", 0), (5003, 1000, "s", 0), (7, 11, "s", 0), (7, 11, "s", 0), (None, 3, "s", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, sequence string, part int")
    got = packing.pack(df, 1000).collect()
    assert check(got, 1000) > (0.9 if group == 100 else 0.97)
    assert sorted(r["n_tokens"] for r in got if r["doc_id"] == 5000) == [500, 1000, 1000] and {r["part"] for r in got if r["doc_id"] == 5000} == {0, 1, 2}
    assert not {5001, 5002} & {r["doc_id"] for r in got} and len([r for r in got if r["doc_id"] == 5003]) == 1
    assert sum(r["n_tokens"] for r in got) == sum(r[1] or 0 for r in rows) and len([r for r in got if r["doc_id"] == 7]) == 3
    assert packing.pack(df.where("false"), 10).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, 0)
    assert packing.packing_report(packing.pack(df, 1000), 1000).first()["tokens"] == sum(r[1] or 0 for r in rows)
    assert packing.pack(df.withColumn("n_tokens", F.lit(1000)), 1000).groupBy("sequence").count().where("count > 1").count() == 0


def test_documents_without_tokens_come_out_of_p7_packed(spark, tmp_path):
    from glyphmill.llm import queries

    rows = [(1, "one text"), (2, ""), (3, None), (4, "another text")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.p7_packed(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3, 4} and {got[i]["n_tokens"] for i in (2, 3)} == {0} and got[1]["n_tokens"] > 0
    assert all(r["part"] == 0 and r["sequence"] == "0:0" for r in got.values())
    assert queries.p7_report(spark, str(tmp_path)).first()["sequences"] == 1
    full = spark.createDataFrame([(i, 10 if i < 5 else 0) for i in range(8)], "doc_id bigint, n_tokens bigint")
    assert {r["doc_id"] for r in packing.pack(full, 10, empty=True).collect()} == set(range(8))


def test_packing_depends_on_the_rows_only(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_DOCS", 100)
    rows = [(i, (i * 37) % 900) for i in range(700)] + [(5, 300)] * 40 + [(None, 10), (7, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")
    one, two = (sorted(map(str, packing.pack(d, 1000, empty=True).collect())) for d in (df.repartition(3), df.orderBy(F.desc("n_tokens")).repartition(5)))
    assert one == two and len(one) == len(rows)
    monkeypatch.setattr(packing, "SPREAD", 7)
    assert packing.pack(df, 1000, empty=True).count() == len(rows)
    got = packing.check(df, packing.pack(df, 250, empty=True), 250).first()
    assert got["n_documents"] == len(rows) and not any(got[c] for c in ("n_overfull", "n_overlapping", "n_cut", "n_wrong"))
    lost = packing.pack(df, 1000, empty=True).where("n_tokens < 500")
    assert packing.check(df, lost, 200).first()["n_wrong"] > 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Merges(f"{bpe.TOKENIZER_DIR}/word_bpe_49k.json")
