import itertools

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import looks_alike
from glyphmill.llm.look import LOOKALIKES, Speller, consistent, corrected, corrected_column, kind_of_token, look_column, token_scripts

SAME = [
    ("Ｔｙｐｅ １２．", "Type 12."), ("Café", "Café"), ("Müren", "Müren"), ("й", "й"), ("a​b", "ab"), ("a b", "a b"), ("a b", "a b"), ("a b", "a b"), ("ᠠ᠋", "ᠠ"),
    ("Вох", "Box"), ("Τуре", "Type"), ("Оﬁсе", "Ofice"), ("ﬂax", "flax"), ("8‐2", "8-2"), ("8‑2", "8-2"), ("Ноһ", "Hoh"), ("ё", "ё"), ("ëx", "ёx"), ("соp", "сор"),
]
OTHER = [("70m²", "70m2"), ("ᠣ", "ᠤ"), ("a", "A"), ("l", "1"), ("O", "0"), ("ү", "у"), ("─", "━"), ("a b", "ab"), ("a.", "a,"), ("№", "No"), ("①", "1"), ("ö", "o"), ("У", "Ү"), ("𝟏", "1"), ("ı", "i"), ("ⅷ", "viii")]


@pytest.mark.parametrize("a,b", SAME)
def test_equal_looks_compare_equal(a, b):
    assert consistent(a) == consistent(b)


@pytest.mark.parametrize("a,b", OTHER)
def test_visible_differences_stay(a, b):
    assert consistent(a) != consistent(b)


def test_script_is_chosen_by_intersection():
    assert token_scripts("сор")[0] == {"Latin", "Cyrillic", "Coptic"} and kind_of_token("сор") == "whole"
    assert kind_of_token("Bох") == "mixed" and consistent("Bох") == "Box"
    assert consistent("нaр") == "нар" and kind_of_token("нaр") == "mixed"  # н is Cyrillic only
    assert kind_of_token("дж") == "plain" and consistent("дж") == "дж"
    assert consistent("12") == "12" and consistent(None) is None and consistent("") == "" and consistent("​") == ""


def test_idempotent_and_consistent_over_all_spellings():
    rows = [r.split() for r in LOOKALIKES.split("\n") if r]
    for row in rows:
        forms = {consistent(c) for c in row if c != "."}
        assert len(forms) == 1
    for a, b in itertools.product(["Bo", "дo", "sp"], ["x", "х", "ﬁ", "é"]):
        assert consistent(consistent(a + b)) == consistent(a + b)


@pytest.mark.parametrize("text,want", [("роса нaр сор", "роса нар сор"), ("the cор and Вох", "the cop and Box"), ("сор", "сор"), ("the сор here", "the cop here"), ("Bох", "Вох"), ("ооp", "оор"), (None, None), ("", ""), ("ａ​б", "аб"), ("plain", "plain"), ("ᠠ᠋ сор ᠡ", "ᠠ сор ᠡ")])
def test_corrected_text_keeps_the_script_of_its_neighbours(text, want):
    """Genuine words stay; confusables follow the text; the form for comparing is the same before and after."""
    assert corrected(text) == want and consistent(corrected(text)) == consistent(text)


def test_bounded_memory():
    s = Speller(10)
    assert [s.text(f"t{i} Вох") for i in range(50)][-1] == "t49 Box" and len(s.seen) <= 10


def test_column_and_pairs(spark):
    df = spark.createDataFrame([("k1", "Box", 1), ("k2", "Вох", 2), ("k3", "Box", 3), ("k3", "Box", 3), ("k4", None, 4), ("k5", "", 5), (None, "Вох", 6), ("k6", "Ｈead", 7), ("k7", "Head", 8)], "doc_id string, text string, look int")
    assert look_column(df, "text", "form").columns == ["doc_id", "text", "look", "form"]
    stock = spark.createDataFrame([(1, "Head"), (2, None)], "stock_id int, text string")
    v = looks_alike.text_values(df, stock, "doc_id", "text")
    assert {tuple(r) for r in looks_alike.pairs(v).collect()} == {("k1", "k2"), ("k2", "k3")}
    assert {tuple(r) for r in looks_alike.classes(v).collect()} == {("k1", "k1", 3, 2), ("k2", "k1", 3, 2), ("k3", "k1", 3, 2)}
    assert [r["c"] for r in corrected_column(df.where("doc_id = 'k6'"), "text", "c").collect()] == ["Head"]
    lists = spark.createDataFrame([("c1", ["a", None]), ("c2", ["а", None]), ("c3", ["a", ""]), ("c4", []), ("c5", None), ("c6", ["a", None]), ("c7", ["a​", ""])], "column_key string, line_texts array<string>")
    got = {tuple(r) for r in looks_alike.pairs(looks_alike.list_looks(lists, "column_key", "line_texts")).collect()}
    assert got == {("c1", "c2"), ("c2", "c6"), ("c3", "c7")}
    assert looks_alike.pairs(looks_alike.text_values(df.where("false"), stock, "doc_id", "text")).count() == 0


def test_hot_look(spark):
    """A third of all rows share one look, in two spellings."""
    df = spark.range(900).select(F.format_string("k%04d", "id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), "id")).when(F.col("id") == 0, "Вох").otherwise("Box").alias("text"))
    v = looks_alike.text_values(df, spark.createDataFrame([], "text string"), "doc_id", "text")
    assert looks_alike.pairs(v).count() == 299
    c = looks_alike.classes(v).collect()
    assert len(c) == 300 and {(r["class"], r["n_keys"], r["n_spellings"]) for r in c} == {("k0000", 300, 2)}
